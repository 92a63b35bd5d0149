"""SQL of the queries on stored index tables, written from the definitions."""

from __future__ import annotations

from paperloom.plans.oracle import CORPUS, KINDS, NON_WORD, ORACLE as PLAIN, two_field_ranking


def both_fields(corpus: str = "corpus") -> str:
    """CTEs over content and comments of a corpus table: token rows, frequencies and weights per field."""
    return rf"""
texts AS (
  SELECT doc_id, doc_type, 'content' AS field, content AS text FROM {corpus}
  UNION ALL
  SELECT doc_id, doc_type, 'comments', string_agg(text, ' ' ORDER BY turn)
  FROM {corpus} JOIN conversations ON conv_id = doc_id GROUP BY doc_id, doc_type),
lists AS (
  SELECT doc_id, doc_type, field, list_filter(string_split_regex(lower(text), '{NON_WORD}'), lambda t: t <> '') AS l FROM texts),
toks AS (
  SELECT doc_id, doc_type, field, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos, len(l) AS dl FROM lists),
tf AS (
  SELECT doc_id, doc_type, field, term, count(*) AS tf, min(dl) AS dl, string_agg(CAST(pos AS VARCHAR), '|' ORDER BY pos) AS positions
  FROM toks GROUP BY doc_id, doc_type, field, term)"""


def weighted(where: str = "TRUE") -> str:
    """CTEs: sizes of the fields and weights of the terms over the chosen documents."""
    return f"""
stats AS (SELECT field, count(*) AS n, avg(len(l)) AS avgdl FROM lists WHERE len(l) > 0 AND {where} GROUP BY field),
weights AS (
  SELECT field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl
  FROM (SELECT field, term, count(*) AS df FROM tf WHERE {where} GROUP BY field, term) JOIN stats USING (field))"""


SATURATION = "tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


def term_parts(terms: list[str], where: str = "TRUE") -> str:
    chosen = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT doc_id, term, idf * {SATURATION} AS part
FROM tf JOIN weights USING (field, term) WHERE term IN ({chosen}) AND {where}"""


def first_hits(k: int) -> str:
    return f"""SELECT id, doc_type, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank
FROM (SELECT doc_id, round(sum(part), 6) AS score FROM parts GROUP BY doc_id) JOIN corpus USING (doc_id)
QUALIFY rank <= {k}"""


CHANGED = f"""{CORPUS},
changed AS (
  SELECT doc_id, id, doc_type, CASE WHEN doc_id % 7 = 0 THEN content || ' elle added' ELSE content END AS content
  FROM corpus WHERE doc_id % 11 <> 0)"""

ORACLE: dict[str, str] = {
    "search_block_max": f"""WITH {CORPUS},{both_fields()},{weighted()},
parts AS ({term_parts(['la', 'elle', 'the'])})
{first_hits(25)}""",
    "search_block_max_all": f"""WITH {CORPUS},{both_fields()},{weighted()},
parts AS (
  SELECT * FROM ({term_parts(['with', 'the'])})
  WHERE doc_id IN (SELECT doc_id FROM tf WHERE term IN ('with', 'the') GROUP BY doc_id HAVING count(DISTINCT term) = 2))
{first_hits(25)}""",
    "search_index_everything": f"WITH {CORPUS} SELECT id, doc_type, CAST(1 AS DOUBLE) AS score FROM corpus",
    "search_index_postings": f"""WITH {CORPUS},{both_fields()},{weighted("doc_type IN ('word', 'pdf', 'eml')")},
parts AS ({term_parts(['elle', 'the'], "doc_type IN ('word', 'pdf', 'eml')")})
SELECT id, doc_type, round(sum(part), 6) AS score FROM parts JOIN corpus USING (doc_id) GROUP BY id, doc_type""",
    "search_combined": f"""WITH {CORPUS},{both_fields()},{weighted()},
phrases AS (
  SELECT a.doc_id, a.field, count(*) AS tf, min(a.dl) AS dl
  FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1
  WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id, a.field),
parts AS (
  SELECT doc_id, part FROM ({term_parts(['elle'])})
  UNION ALL
  SELECT doc_id, idf * {SATURATION} FROM phrases
  JOIN (SELECT field, sum(idf) AS idf, any_value(avgdl) AS avgdl FROM weights WHERE term IN ('of', 'the') GROUP BY field) USING (field)
  UNION ALL
  SELECT DISTINCT doc_id, 1.0 FROM tf WHERE regexp_full_match(term, 'er.*at'))
SELECT id, doc_type, round(sum(part), 6) AS score FROM parts JOIN corpus USING (doc_id)
WHERE NOT (doc_id IN (SELECT doc_id FROM tf WHERE term = 'queue')
  AND doc_id IN (SELECT doc_id FROM tf WHERE starts_with(term, 'thi')))
GROUP BY id, doc_type""",
    "search_wildcard": f"""WITH {CORPUS},{both_fields()}
SELECT id, doc_type, CAST(1 AS DOUBLE) AS score FROM corpus
WHERE doc_id IN (SELECT doc_id FROM tf WHERE regexp_full_match(term, 'er.*at'))""",
    "search_index_prefix": f"""WITH {CORPUS},{both_fields()}
SELECT id, doc_type, CAST(1 AS DOUBLE) AS score FROM corpus
WHERE doc_id IN (SELECT doc_id FROM tf WHERE starts_with(term, 'erth'))""",
    "wildcard_terms": f"""WITH {CORPUS},{both_fields()}
SELECT DISTINCT term FROM tf WHERE regexp_full_match(term, '.*th.t.*')""",
    "search_deep_page": f"""WITH {two_field_ranking(['the', 'elle'])}
SELECT c.id, c.doc_type, score, row_number() OVER (ORDER BY score DESC, c.id) AS rank, count(*) OVER () AS total
FROM ranked JOIN corpus c USING (doc_id) QUALIFY rank > 500 AND rank <= 510""",
    "suggest_prefix_table": PLAIN["suggest"],
    "index_delta": f"""WITH {CHANGED},{both_fields('changed')},
freq AS (SELECT doc_type, field, term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM tf GROUP BY doc_type, field, term),
sizes AS (SELECT doc_type, field, count(*) AS n_docs, sum(len(l))::BIGINT AS sum_dl FROM lists WHERE len(l) > 0 GROUP BY doc_type, field)
SELECT id, doc_type, field, term, tf, dl::BIGINT AS dl, positions, df, total_tf, n_docs, sum_dl
FROM tf JOIN freq USING (doc_type, field, term) JOIN sizes USING (doc_type, field) JOIN (SELECT doc_id, id FROM corpus) USING (doc_id)""",
    "index_delta_search": f"""WITH {CHANGED},{both_fields('changed')},{weighted()},
parts AS ({term_parts(['elle', 'added', 'the'])})
{first_hits(25)}""",
}
