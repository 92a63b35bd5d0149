"""The same results as SQL over the given tables, where SQL can express them."""

from __future__ import annotations

_WORDS7 = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
b AS (SELECT item_id, {_WORDS7} AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)
),
met AS (SELECT doc_id, item_id, k, n FROM places JOIN grams USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM met) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SPLIT6 = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FORM6 = r"trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g'))"

def quality_sql(min_documents: int = 20, host_share: float = 0.01) -> str:
    """The verdicts under given limits for a line: distinct texts and their share of the host's."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, dense_rank() OVER (ORDER BY coalesce(text, '')) AS key, {_SPLIT6.format("coalesce(text, '')")} AS w FROM documents),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d
),
physical AS (SELECT doc_id, host, key, unnest(string_split(t, chr(10))) AS line FROM d),
shaped AS (SELECT doc_id, host, key, line, {_FORM6.format("line")} AS form FROM physical),
dup AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM shaped WHERE form <> '' GROUP BY ALL) GROUP BY doc_id
),
windows AS (SELECT doc_id, k, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
often AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
again AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM windows JOIN often USING (doc_id, g)) GROUP BY doc_id
),
forms AS (SELECT DISTINCT host, form, key FROM shaped WHERE form <> ''),
hosts AS (SELECT host, count(DISTINCT key) AS n_host FROM forms GROUP BY host),
held AS (
  SELECT host, form, key, n_host FROM forms JOIN hosts USING (host)
  WHERE (host, form) IN (
    SELECT (host, form) FROM forms JOIN hosts USING (host) GROUP BY host, form HAVING count(*) > {min_documents} AND count(*) > {host_share} * any_value(n_host))
),
pairs AS (
  SELECT DISTINCT key, unnest(CASE WHEN len(w) < 2 THEN [t] ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS pair
  FROM d WHERE key IN (SELECT key FROM held)
),
own AS (
  SELECT key FROM (SELECT key, count(*) OVER (PARTITION BY pair) AS holders FROM pairs) GROUP BY key
  HAVING 100 * count(*) FILTER (holders = 1) >= 10 * count(*)
),
above AS (
  SELECT host, form FROM (
    SELECT host, form, any_value(n_host) AS n_host, count(own.key) + max(CASE WHEN own.key IS NULL THEN 1 ELSE 0 END) AS n
    FROM held LEFT JOIN own ON own.key = held.key GROUP BY host, form)
  WHERE n > {min_documents} AND n > {host_share} * n_host
),
gone AS (
  SELECT doc_id, sum(len(string_split(form, ' ')))::BIGINT AS n_frequent_words FROM shaped JOIN above USING (host, form) GROUP BY doc_id
)
SELECT base.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
  coalesce(n_frequent_words, 0) AS n_frequent_words,
  NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND n_words - coalesce(n_frequent_words, 0) >= 0.3 * n_words AS kept
FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id)
"""


OP6 = quality_sql()

OP10 = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3 :] ELSE '' END AS rest FROM pages
),
u AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest[len(regexp_extract(rest, '^[^/?#]*')) + 1 :], '^[^?#]*') AS path FROM p
),
s AS (
  SELECT r, host, k - 1 AS depth, l[k] AS value
  FROM (SELECT r, host, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT r, host, list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM u))
),
kept AS (
  SELECT host, depth, value FROM s GROUP BY ALL HAVING count(*) >= 5
),
t AS (
  SELECT u.r, u.page_id, u.host, u.path, coalesce(string_agg(CASE WHEN kept.value IS NULL AND s.r IS NOT NULL THEN '*' ELSE s.value END, '/' ORDER BY s.depth), '') AS template
  FROM u LEFT JOIN s ON u.r = s.r LEFT JOIN kept ON s.host = kept.host AND s.depth = kept.depth AND s.value = kept.value GROUP BY ALL
),
known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY ALL
),
overall AS (SELECT (sum(bad) + 1) / (count(*) + 2) AS o FROM known),
c AS (SELECT host, template, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM t LEFT JOIN known USING (page_id) GROUP BY ALL),
nodes AS (
  SELECT host, template, labelled, bad, level, array_to_string(string_split(template, '/')[1 : level], '/') AS node
  FROM (SELECT *, unnest(range(0, len(string_split(template, '/')) + 1)) AS level FROM c)
),
stats AS (
  SELECT host, level, node, sum(labelled) AS n, sum(bad) AS b,
    CASE WHEN level > 0 THEN CASE WHEN contains(node, '/') THEN regexp_extract(node, '^(.*)/[^/]*$', 1) ELSE '' END END AS parent
  FROM nodes GROUP BY host, level, node
),
wide AS (
  SELECT a.*, coalesce(a.level > 0 AND
    abs((a.b + 1) / (a.n + 2) - (q.b - a.b + 1) / (q.n - a.n + 2))
    < 1.96 * sqrt((q.b + 1) / (q.n + 2) * (1 - (q.b + 1) / (q.n + 2)) * (1 / (a.n + 2) + 1 / (q.n - a.n + 2))), false) AS alike
  FROM stats a LEFT JOIN stats q ON a.host = q.host AND a.level = q.level + 1 AND a.parent = q.node
),
merged AS (SELECT host, level, parent, sum(n) AS mn, sum(b) AS mb FROM wide WHERE alike GROUP BY ALL),
final AS (
  SELECT host, level, node, CASE WHEN alike THEN mn ELSE n END AS n, CASE WHEN alike THEN mb ELSE b END AS b
  FROM wide LEFT JOIN merged USING (host, level, parent)
),
line AS (SELECT host, template, list(struct_pack(n := n, b := b) ORDER BY level) AS l FROM nodes JOIN final USING (host, level, node) GROUP BY ALL),
blocked AS (
  SELECT host, template, true AS blocked FROM line, overall
  WHERE 1 - list_reduce(list_prepend(o::DOUBLE, list_transform(l, lambda x: 0.0)), lambda p, x, k: CASE WHEN k > 2 AND l[k - 1].n = l[k - 2].n AND l[k - 1].b = l[k - 2].b THEN p ELSE (l[k - 1].b + 10.0 * p) / (l[k - 1].n + 10.0) END) < 0.5
),
rules AS (
  SELECT * FROM (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')) v(act, rule, h, begins)
),
ruled AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
  FROM t JOIN rules ON (t.host = h OR ends_with(t.host, '.' || h)) AND starts_with(t.path, begins) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN ruled USING (r) LEFT JOIN blocked USING (host, template)
"""


def _field11(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _leaf11(text: str) -> str:
    return "sha256(" + " || ".join(map(_field11, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree11(name: str, base: str, by: str, levels: int) -> str:
    """CTEs: level tables of one kind of tree, then per row of ``base`` its left and right siblings on each level."""
    parts = [f"{name}0 AS ({base})"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS (SELECT {by}, idx // 16 AS idx, (m + 15) // 16 AS m, "
            f"CASE WHEN m > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest "
            f"FROM {name}{k} GROUP BY {by}, idx // 16, m)"
        )
        frame = f"PARTITION BY {by}, idx // 16 ORDER BY idx ROWS BETWEEN"
        parts.append(
            f"{name}s{k} AS (SELECT {by}, idx, m > 1 AS step, "
            f"coalesce(string_agg(digest, '') OVER ({frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(digest, '') OVER ({frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
    return ",\n".join(parts)


# Eight levels of 16 hold four thousand million leaves a source, and four hold 65,536 sources.
_LEVELS11, _TOP11 = 8, 4
# The checksum of an id's digits, bit by bit.
_CRC11 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda x: list_transform(range(0, 8), lambda j: (ascii(x) >> j::INTEGER) & 1)))), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b::BIGINT) & 1))))"""


def _fold11() -> str:
    """The folds of the changed leaf, level by level, through both trees."""
    steps, value = [], "changed"
    for name, levels in (("n", _LEVELS11), ("t", _TOP11)):
        for k in range(levels):
            steps.append(
                f"f{name}{k} AS (SELECT f.* EXCLUDE (fold, sib), CASE WHEN step THEN sha256(l || fold || r) ELSE fold END AS fold, "
                f"CASE WHEN step THEN sib || l || r ELSE sib END AS sib FROM {value} f JOIN {name}s{k} s "
                + (f"ON f.host = s.host AND f.idx // {16**k} = s.idx)" if name == "n" else f"ON f.place // {16**k} = s.idx)")
            )
            value = f"f{name}{k}"
    return ",\n".join(steps)


OP11 = f"""
WITH d AS (
  SELECT doc_id, source, {_leaf11("text")} AS leaf,
    {_leaf11(f"CASE WHEN {_CRC11} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS fold
  FROM documents
),
placed AS (
  SELECT *, coalesce('+' || source, '') AS host, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS m, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM d
),
{_tree11("n", "SELECT host, idx, m, leaf AS digest FROM placed", "host", _LEVELS11)},
subroots AS (SELECT place, digest FROM n{_LEVELS11} JOIN (SELECT DISTINCT host, place FROM placed) USING (host)),
{_tree11("t", "SELECT 0 AS one, place AS idx, (SELECT count(*) FROM subroots) AS m, digest FROM subroots", "one", _TOP11)},
changed AS (SELECT doc_id, leaf, host, idx, place, fold, '' AS sib FROM placed),
{_fold11()}
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = t.digest AS verified
FROM ft{_TOP11 - 1} JOIN subroots s USING (place), t{_TOP11} t
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT r, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)
),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
judged AS (SELECT r, pos, line, key IN (SELECT key FROM frequent) AS gone FROM lines)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged JOIN d USING (r) GROUP BY r, doc_id
"""

OP13 = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike,
    CAST(list_sum(list_transform(range(1, least(len(a.q), len(r.q)) + 1), lambda k: a.q[k] * r.q[k])) AS BIGINT) AS score
  FROM valid a JOIN valid r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, coalesce(score, 0) AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {
    "op6_quality_rules": OP6, "op7_decontamination": OP7, "op10_url_filters": OP10, "op11_merkle_manifest": OP11,
    "op12_line_dedup": OP12, "op13_hard_negatives": OP13,
}
