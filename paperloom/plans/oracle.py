"""The same results in plain SQL, written independently of the Spark expressions."""

from __future__ import annotations

KINDS = "['word','excel','powerpoint','pdf','eml','msg']"
EXTENSIONS = "['docx','xlsx','pptx','pdf','eml','msg']"
NON_WORD = r"[^\p{L}\p{N}_]+"
EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
TIME = "'%Y-%m-%d %H:%M:%S'"


def clean_office(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\r\n?|\n', '', 'g'), '[ ]{{2,}}', ' ', 'g')"


def clean_mail(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '&nbsp;', ' ', 'g'), "
        r"'[^a-zA-ZäöüßÄÜÖ@.0-9]', ' ', 'g'), '\n', ' ', 'g'), '[ ]{2,}', ' ', 'g')"
    )


def html_to_text(html: str) -> str:
    return (
        rf"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g')"
    )


def stamp(column: str) -> str:
    return f"strftime({column}, {TIME})"


PATH = f"'/scan/' || source || '/' || doc_id || '.' || {EXTENSIONS}[doc_id % 6 + 1]"
KEYWORDS_RAW = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'k' || (doc_id % 5) || ',' || lang END"

CORPUS = f"""
corpus AS (
  SELECT doc_id, sha256(path) AS id, doc_type, path AS original_file_path,
         replace(replace(path, '/scan/', 'https://repo.example/'), chr(92), '/') AS uri_file_path,
         content, lang AS creator, source AS subject, content AS title, ext AS content_type,
         keywords_raw,
         CASE WHEN doc_id % 7 = 0 THEN {EPOCH}
              ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END AS created,
         TIMESTAMP '2024-06-01 00:00:00' AS process_time
  FROM (SELECT doc_id, lang, source, {clean_office('text')} AS content, {PATH} AS path,
               {KINDS}[doc_id % 6 + 1] AS doc_type, {EXTENSIONS}[doc_id % 6 + 1] AS ext,
               {KEYWORDS_RAW} AS keywords_raw
        FROM documents))"""

WORD_LISTS = """
first_words AS (
  SELECT conv_id, word, min(turn * 4294967296 + pos) AS first_at
  FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))
  GROUP BY conv_id, word)"""

HASHED = f"""{CORPUS},{WORD_LISTS},
words AS (
  SELECT conv_id, string_agg(word, '' ORDER BY first_at) AS words
  FROM first_words GROUP BY conv_id),
hashed AS (
  SELECT c.*,
    CASE WHEN doc_type IN ('eml', 'msg') THEN sha256(content || creator || title || 'msg')
         WHEN doc_type = 'pdf' THEN sha256(content || creator || replace(keywords_raw, ',', '') || title || subject || 'pdf')
         ELSE sha256('' || {stamp('created')} || content || creator || '' || '' || keywords_raw || ''
                     || '1970-01-01 00:00:00' || '' || subject || title || '' || '' || content_type
                     || '1970-01-01 00:00:00' || '' || coalesce(words, ''))
    END AS content_hash
  FROM corpus c LEFT JOIN words w ON w.conv_id = c.doc_id)"""

STATE = f"""{HASHED},
state AS (
  SELECT id AS path_hash, CASE WHEN doc_id % 10 = 1 THEN 'old' || content_hash ELSE content_hash END AS content_hash,
         original_file_path AS original_path, doc_type
  FROM hashed WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT sha256('/scan/gone/' || doc_id || '.docx'), 'gone', '/scan/gone/' || doc_id || '.docx', 'word'
  FROM hashed WHERE doc_id % 20 = 0),
labelled AS (
  SELECT h.*, CASE WHEN s.path_hash IS NULL THEN 'new' WHEN s.content_hash <> h.content_hash THEN 'changed'
              ELSE 'unchanged' END AS label
  FROM hashed h LEFT JOIN state s ON s.path_hash = h.id)"""

PATH_STATE = f"""
listing AS (SELECT sha256({PATH}) AS path_hash FROM documents),
state AS (
  SELECT sha256({PATH}) AS path_hash, {PATH} AS original_path, {KINDS}[doc_id % 6 + 1] AS doc_type
  FROM documents WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT sha256('/scan/gone/' || doc_id || '.docx'), '/scan/gone/' || doc_id || '.docx', 'word'
  FROM documents WHERE doc_id % 20 = 0)"""


def token_cte(name: str, source: str, text: str, keys: str) -> str:
    """Token rows of a table: keys, pos from 0, term."""
    return rf"""
{name}_lists AS (
  SELECT {keys}, list_filter(string_split_regex(lower({text}), '{NON_WORD}'), lambda t: t <> '') AS l FROM {source}),
{name} AS (
  SELECT {keys}, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos, len(l) AS dl FROM {name}_lists)"""


def bm25_field(prefix: str, token_table: str, list_table: str, terms: list[str], where: str = "TRUE") -> str:
    """CTE <prefix>_scores(doc_id, term, part) over the documents of one field."""
    chosen = ", ".join(f"'{t}'" for t in terms)
    return f"""
{prefix}_stats AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM {list_table} WHERE len(l) > 0 AND {where}),
{prefix}_tf AS (
  SELECT doc_id, term, count(*) AS tf, min(dl) AS dl FROM {token_table}
  WHERE term IN ({chosen}) AND {where} GROUP BY doc_id, term),
{prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term),
{prefix}_scores AS (
  SELECT doc_id, term,
         ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part
  FROM {prefix}_tf JOIN {prefix}_df USING (term), {prefix}_stats)"""


CONTENT_TOKENS = CORPUS + "," + token_cte("tok", "corpus", "content", "doc_id, doc_type")


def content_ranking(terms: list[str], where: str = "TRUE") -> str:
    return f"""{CONTENT_TOKENS},{bm25_field('c', 'tok', 'tok_lists', terms, where)},
ranked AS (
  SELECT doc_id, doc_type, round(sum(part), 6) AS score
  FROM c_scores JOIN corpus USING (doc_id) GROUP BY doc_id, doc_type)"""


def two_field_ranking(terms: list[str]) -> str:
    return f"""{CONTENT_TOKENS},
comment_texts AS (
  SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
{token_cte('ctok', 'comment_texts', 'text', 'doc_id')},
{bm25_field('c', 'tok', 'tok_lists', terms)},{bm25_field('n', 'ctok', 'ctok_lists', terms)},
ranked AS (
  SELECT doc_id, doc_type, round(sum(part), 6) AS score
  FROM (SELECT * FROM c_scores UNION ALL SELECT * FROM n_scores) JOIN corpus USING (doc_id)
  GROUP BY doc_id, doc_type)"""


def escape_html(text: str) -> str:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"),
                         ("/", "&#x2F;")):
        text = f"replace({text}, '{raw}', '{escaped}')"
    return text


START = '<span class="hilightText"><strong>'
END = "</strong></span>"


def fragments(text: str, terms: list[str], var: str) -> str:
    """List of highlighted fragments of a text expression; ``var`` keeps lambda names apart."""
    space = r"\x09-\x0D\x20"
    piece = rf"(?s)[^{space}](?:.{{0,498}}[^{space}])?(?:[{space}]|\z)|[^{space}]+"
    clean = f"translate(regexp_replace({var}i, '[{space}]+\\z', ''), chr(1) || chr(2) || chr(3) || chr(4), '')"
    words = rf"regexp_replace({clean}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    marked = (
        f"replace(replace(regexp_replace({words}, '(?i)' || chr(1) || '({'|'.join(terms)})' || chr(2), "
        rf"chr(3) || '\1' || chr(4), 'g'), chr(1), ''), chr(2), '')"
    )
    blocks = f"list_transform(regexp_extract_all({text}, '{piece}'), lambda {var}i: {marked})"
    kept = f"list_slice(list_filter({blocks}, lambda {var}b: contains({var}b, chr(3))), 1, 5)"
    tagged = f"replace(replace({escape_html(var + 'c')}, chr(3), '{START}'), chr(4), '{END}')"
    return f"list_transform({kept}, lambda {var}c: {tagged})"


def first_distinct(rows: str, key: str) -> str:
    """CTEs over rows (key, l): distinct words longer than two letters with their first index."""
    return f"""
word_rows AS (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM ({rows})),
firsts AS (SELECT {key}, w, min(i) AS i FROM word_rows WHERE length(w) > 2 GROUP BY {key}, w)"""


def terms_query(rows: str) -> str:
    return f"""WITH {first_distinct(rows, 'doc_id')}
SELECT d.doc_id, coalesce(terms, '') AS terms FROM documents d LEFT JOIN
  (SELECT doc_id, string_agg(w, '|' ORDER BY i) AS terms FROM firsts GROUP BY doc_id) f ON f.doc_id = d.doc_id"""


OFFICE_WORDS = "string_split(lower(regexp_replace({0}, '[^a-zA-Z äöüÄÖÜß]', '', 'g')), ' ')"
PDF_WORDS = "string_split(lower(regexp_replace({0}, '[^a-zA-Zäöüß]', ' ', 'g')), ' ')"
MAIL_WORDS = (
    "list_transform(string_split(lower({0}), ' '), lambda w: regexp_replace(w, '[^a-zäöüß@.]', '', 'g'))"
)

KIND_TERMS = f"""
kind_terms AS (
  SELECT DISTINCT doc_type, term FROM (
    SELECT doc_type, unnest(CASE WHEN doc_type IN ('eml', 'msg') THEN {MAIL_WORDS.format('content')}
                                 WHEN doc_type = 'pdf' THEN {PDF_WORDS.format('content')}
                                 ELSE {OFFICE_WORDS.format('content')} END) AS term
    FROM texts) WHERE length(term) > 2)"""

RUNS = """
runs AS (
  SELECT CASE event_type WHEN 'view' THEN 'word' WHEN 'click' THEN 'excel' WHEN 'signup' THEN 'powerpoint'
              WHEN 'purchase' THEN 'pdf' WHEN 'error' THEN 'msg' END AS model,
         CAST(event_id AS VARCHAR) AS id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS entire_doc_count,
         user_id % 50 AS indexed_doc_count,
         CAST(event_type = 'error' AS BIGINT) AS processing_error,
         ts - to_microseconds(CAST(round(value * 1000) AS BIGINT) * 1000) AS start_job, ts AS end_job,
         CAST(round(value * 1000) AS BIGINT) AS elapsed_time_millis
  FROM events),
latest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY model ORDER BY end_job DESC, id DESC) = 1),
states AS (
  SELECT model, CASE WHEN entire_doc_count % 2 = 0 THEN 'Running' ELSE 'Stopped' END AS job_state
  FROM latest WHERE model IN ('word', 'excel', 'msg')),
processors AS (
  SELECT DISTINCT doc_type AS model, upper(doc_type[1]) || doc_type[2:] AS short_name
  FROM (SELECT ['word','excel','powerpoint','pdf','eml','msg'][doc_id % 6 + 1] AS doc_type FROM documents))"""

RUN_COLUMNS = f"""id, entire_doc_count, indexed_doc_count, processing_error,
  {stamp('start_job')} AS start_job, {stamp('end_job')} AS end_job, elapsed_time_millis"""

DETAIL = f"""
SELECT id, creator, {stamp(f"CASE WHEN office THEN created ELSE {EPOCH} END")} AS created, '' AS last_modified_by,
       '1970-01-01 00:00:00' AS modified, title, subject, '' AS version, '' AS revision,
       '1970-01-01 00:00:00' AS last_printed, regexp_extract(uri_file_path, '[^/]*$') AS file_name,
       {stamp('process_time')} AS process_time
FROM (SELECT *, doc_type IN ('word', 'excel', 'powerpoint') AS office FROM corpus)"""

TYPE_OR_SOURCE = f"CASE WHEN doc_id % 7 = 0 THEN source ELSE {EXTENSIONS}[doc_id % 6 + 1] END"

BENCH_BATCH = rf"""WITH
q AS (
  SELECT DISTINCT item_id AS query_id, term
  FROM (SELECT item_id, unnest(string_split_regex(lower(text), '{NON_WORD}')) AS term FROM benchmark)
  WHERE term <> ''),
{token_cte('tok', 'documents', 'text', 'doc_id')},
stats AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM tok_lists WHERE len(l) > 0),
tf AS (
  SELECT doc_id, term, count(*) AS tf, min(dl) AS dl FROM tok
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
  SELECT query_id, doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM scores QUALIFY rank <= 10"""

HITS_TERMS = ["la", "elle", "the"]



def comment_highlights(where: str) -> str:
    """CTE comments(conv_id, text): the first five highlighted fragments with their origin."""
    return f"""
marked AS (
  SELECT conv_id, turn, role, unnest(f) AS fragment, generate_subscripts(f, 1) AS i
  FROM (SELECT conv_id, turn, role, {fragments('text', HITS_TERMS, 'n')} AS f FROM conversations WHERE {where})),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS n FROM marked QUALIFY n <= 5),
comment_rows AS (
  SELECT conv_id, n, concat_ws('|', fragment, role, '1970-01-01 00:00:00', CAST(turn AS VARCHAR), upper(role[1])) AS text
  FROM kept),
comments AS (
  SELECT conv_id, string_agg(text, chr(10) || '~' || chr(10) ORDER BY n) AS text FROM comment_rows GROUP BY conv_id)"""


ORACLE: dict[str, str] = {
    "page_assembly": """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content, count(*) AS page_count
FROM conversations GROUP BY conv_id""",
    "page_assembly_parts": """
SELECT conv_id, CAST(turn // 2 AS BIGINT) AS part, string_agg(text, ' ' ORDER BY turn) AS content, count(*) AS page_count
FROM conversations GROUP BY ALL""",
    "mail_documents": rf"""
WITH m AS (
  SELECT page_id, '/mail/' || page_id || '.msg' AS path,
         {clean_mail(f"CASE WHEN page_id % 9 <> 0 THEN {html_to_text('html')} ELSE url END")} AS content,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         'info@' || regexp_extract(url, '^https?://([^/]+)', 1) AS sender
  FROM pages)
SELECT sha256(path) AS id, sha256(content || sender || title || 'msg') AS content_hash,
       replace(path, '/mail/', 'https://repo.example/') AS uri_file_path, content, sender AS creator, title,
       'msg' AS content_type,
       array_to_string(list_transform(range(0, page_id % 3 + 1), lambda i: 'user' || (page_id + i) || '@example.org'), '|') AS receiver,
       (SELECT count(DISTINCT w) FROM (SELECT unnest({MAIL_WORDS.format('content')}) AS w) WHERE length(w) > 2) AS n_terms
FROM m""",
    "state_parse": """
SELECT source AS path_hash, lang AS content_hash, text AS original_path
FROM documents WHERE doc_id % 13 <> 0 AND NOT contains(text, ';')""",
    "corpus_upsert": f"""WITH {CORPUS},
base AS (SELECT doc_id, id, doc_type, title, length(content) AS n, process_time FROM corpus),
batch AS (
  SELECT id, doc_type, title, n, 'first' AS content_hash, process_time + INTERVAL 1 HOUR AS written FROM base WHERE doc_id % 4 = 0
  UNION ALL
  SELECT id, doc_type, title, n, 'second', process_time + INTERVAL 2 HOUR FROM base WHERE doc_id % 8 = 0
  UNION ALL
  SELECT id || '-copy', doc_type, title, n, 'fresh', process_time FROM base WHERE doc_id % 16 = 0),
last AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY written DESC, content_hash) = 1)
SELECT id, doc_type, title, n, content_hash, {stamp('written')} AS written FROM (
  SELECT id, doc_type, title, n, 'base' AS content_hash, process_time AS written FROM base WHERE id NOT IN (SELECT id FROM last)
  UNION ALL SELECT * FROM last)""",
    "corpus_delete": f"""WITH {CORPUS}
SELECT id, doc_type, title FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "full_refresh": f"""WITH {CORPUS}
SELECT id, doc_type, length(content) AS n, CASE WHEN doc_type = 'pdf' THEN 'rescanned' ELSE 'base' END AS content_hash
FROM corpus WHERE doc_type <> 'pdf' OR doc_id % 18 <> 3""",
    "index_list": f"""
SELECT DISTINCT 'officedocuments-' || {KINDS}[doc_id % 6 + 1] AS index_name FROM documents""",
    "run_json_roundtrip": f"""WITH {RUNS}
SELECT model, id, entire_doc_count, indexed_doc_count, processing_error, {stamp('end_job')} AS ended, elapsed_time_millis
FROM runs WHERE CAST(id AS BIGINT) % 10 NOT IN (3, 7)""",
    "metadata_defaults": """
SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '') AS category,
       CASE WHEN toxic = 1 THEN lang ELSE '' END AS description,
       CASE WHEN quality = 1 THEN '2024-02-03 04:05:06' ELSE '1970-01-01 00:00:00' END AS created
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "uri_rewrite": """SELECT page_id, replace(url, 'https:', 'ftp:') AS uri FROM pages""",
    "path_hash": f"SELECT doc_id, sha256({PATH}) AS id FROM documents",
    "content_hash_office": f"""WITH {HASHED}
SELECT doc_id, content_hash FROM hashed WHERE doc_type IN ('word', 'excel', 'powerpoint')""",
    "content_hash_pdf": f"WITH {HASHED} SELECT doc_id, content_hash FROM hashed WHERE doc_type = 'pdf'",
    "content_hash_mail": f"WITH {HASHED} SELECT doc_id, content_hash FROM hashed WHERE doc_type IN ('eml', 'msg')",
    "keywords_office": f"""
SELECT doc_id, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ',')) END AS n, replace(k, ',', '|') AS keywords
FROM (SELECT doc_id, {KEYWORDS_RAW} AS k FROM documents)""",
    "keywords_pdf": """
SELECT doc_id, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END AS n, replace(k, ' ', '|') AS keywords
FROM (SELECT doc_id, CASE WHEN doc_id % 11 IN (0, 1) THEN '' ELSE text END AS k FROM documents)""",
    "regex_chain": r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[aeiou]{2}', '*', 'g'), '\*+', '+', 'g'), '[0-9]', '#', 'g') AS text
FROM documents""",
    "clean_office": f"SELECT doc_id, {clean_office('text')} AS content FROM documents",
    "clean_mail": f"SELECT doc_id, {clean_mail('text')} AS content FROM documents",
    "html_to_text": f"SELECT page_id, {html_to_text('html')} AS text FROM pages",
    "html_to_text_plain": """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', chr(10), 'g') AS text
FROM pages""",
    "comments_text": """
SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "comment_words": f"""WITH {WORD_LISTS}
SELECT conv_id, string_agg(word, '|' ORDER BY first_at) AS words FROM first_words GROUP BY conv_id""",
    "suggest_text": f"""WITH {CORPUS},
c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT doc_id, regexp_replace(coalesce(text, '') || ' ' || content, '[^a-zA-Z äöüÄÖÜß]', '', 'g') AS text
FROM corpus LEFT JOIN c ON conv_id = doc_id""",
    "suggest_terms_office": terms_query(f"SELECT doc_id, {OFFICE_WORDS.format('text')} AS l FROM documents"),
    "suggest_terms_pdf": terms_query(f"SELECT doc_id, {PDF_WORDS.format('text')} AS l FROM documents"),
    "suggest_terms_mail": terms_query(
        f"SELECT doc_id, {MAIL_WORDS.format(clean_mail('text'))} AS l FROM documents"
    ),
    "mime_type": f"""
SELECT doc_id, CASE t
  WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
  WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
  WHEN 'pdf' THEN 'application/pdf' ELSE t END AS mime
FROM (SELECT doc_id, {TYPE_OR_SOURCE} AS t FROM documents)""",
    "program_icon": f"""
SELECT doc_id, './images/' || CASE t WHEN 'docx' THEN 'word' WHEN 'xlsx' THEN 'excel' WHEN 'pptx' THEN 'powerpoint'
  WHEN 'pdf' THEN 'pdf' WHEN 'msg' THEN 'outlook' WHEN 'eml' THEN 'eml' ELSE 'unknown' END || '.svg' AS icon
FROM (SELECT doc_id, {TYPE_OR_SOURCE} AS t FROM documents)""",
    "file_name": "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages",
    "download_name": r"""
SELECT doc_id, replace(replace(replace(url_encode(regexp_extract(p, '[^/]*$')), '%20', '+'), '~', '%7E'), '%2A', '*') AS name
FROM (SELECT doc_id, regexp_replace(source || '/' || text, '[\r\n]', ' ', 'g') AS p FROM documents)""",
    "comment_json": """
SELECT conv_id, turn, '{"commentText":' || CAST(to_json(text) AS VARCHAR)
  || CASE WHEN turn % 2 = 0 THEN ',"author":"' || role || '"' ELSE '' END
  || CASE WHEN turn % 3 = 0 THEN ',"date":"1986-12-05T10:31:22"' ELSE '' END
  || ',"id":"' || turn || '"'
  || CASE WHEN turn % 2 = 0 THEN ',"initials":"' || upper(role[1]) || '"' ELSE '' END || '}' AS json
FROM conversations""",
    "props_from_json": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "exclude_filter": "SELECT page_id, url FROM pages WHERE NOT contains(url, '?page=')",
    "search_type_filter": f"""WITH {content_ranking(['the', 'elle'], "doc_type IN ('word', 'pdf', 'eml')")}
SELECT * FROM ranked""",
    "search_match_all": f"SELECT doc_id, {KINDS}[doc_id % 6 + 1] AS doc_type, CAST(1 AS DOUBLE) AS score FROM documents",
    "type_availability": f"""
WITH cfg AS (
  SELECT k AS kind, CASE k WHEN 'word' THEN 'word' WHEN 'excel' THEN 'excel' WHEN 'eml' THEN 'eml' WHEN 'pdf' THEN 'gone' END AS suffix,
         k IN ('word', 'pdf') AS asked
  FROM (SELECT unnest({KINDS}) AS k)),
existing AS (SELECT DISTINCT {KINDS}[doc_id % 6 + 1] AS t FROM documents)
SELECT kind, t IS NOT NULL AS active, t IS NOT NULL AND asked AS filter
FROM cfg LEFT JOIN existing ON t = suffix""",
    "change_detect": f"""WITH {STATE}
SELECT doc_id, id, doc_type, content_hash, label FROM labelled WHERE label <> 'unchanged'""",
    "change_next_state": f"""WITH {STATE}
SELECT id AS path_hash, content_hash, original_file_path AS original_path, doc_type FROM hashed
UNION ALL
SELECT path_hash, content_hash, original_path, doc_type FROM state WHERE path_hash NOT IN (SELECT id FROM hashed)""",
    "cleanup_orphans": f"""WITH {PATH_STATE}
SELECT * FROM state WHERE path_hash NOT IN (SELECT path_hash FROM listing)""",
    "cleanup_apply": f"""WITH {PATH_STATE}
SELECT * FROM state WHERE path_hash IN (SELECT path_hash FROM listing)""",
    "cleanup_counters": f"""WITH {PATH_STATE}
SELECT count(*) AS all_files,
       count(*) FILTER (WHERE path_hash NOT IN (SELECT path_hash FROM listing)) AS removed_files
FROM state""",
    "ingest_counters": f"""WITH {STATE}
SELECT count(*) AS entire_doc_count,
       count(*) FILTER (WHERE creator <> 'fr' AND label <> 'unchanged') AS indexed_doc_count,
       count(*) FILTER (WHERE creator = 'fr') AS processing_error
FROM labelled""",
    "tokens": f"""WITH {token_cte('tok', 'documents', 'text', 'doc_id')}
SELECT doc_id, pos, term FROM tok""",
    "postings": f"""WITH {token_cte('tok', 'documents', 'text', 'doc_id')}
SELECT doc_id, term, count(*) AS tf, min(dl) AS dl, string_agg(CAST(pos AS VARCHAR), '|' ORDER BY pos) AS positions
FROM tok GROUP BY doc_id, term""",
    "doc_freq": f"""WITH {token_cte('tok', 'documents', 'text', 'doc_id')}
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total_tf FROM tok GROUP BY term""",
    "vocabulary_size": f"""WITH {CORPUS}, texts AS (SELECT doc_type, content FROM corpus),{KIND_TERMS}
SELECT doc_type, count(*) AS terms FROM kind_terms GROUP BY doc_type""",
    "search_bm25": f"WITH {content_ranking(['the', 'elle'])} SELECT * FROM ranked",
    "search_all_terms": f"""WITH {content_ranking(['the', 'with'])}
SELECT * FROM ranked WHERE doc_id IN (SELECT doc_id FROM c_tf GROUP BY doc_id HAVING count(*) = 2)""",
    "search_must_not": f"""WITH {content_ranking(['der', 'und'])}
SELECT * FROM ranked WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'with')""",
    "search_phrase": f"""WITH {CONTENT_TOKENS}
SELECT a.doc_id, a.doc_type, count(*) AS phrase_freq
FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id, a.doc_type""",
    "search_phrase_postings": f"""WITH {CONTENT_TOKENS}
SELECT a.doc_id, a.doc_type, count(*) AS phrase_freq
FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN tok c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
WHERE a.term = 'in' AND b.term = 'the' AND c.term = 'the' GROUP BY a.doc_id, a.doc_type""",
    "search_prefix": f"""WITH {CONTENT_TOKENS}
SELECT DISTINCT doc_id, doc_type, CAST(1 AS DOUBLE) AS score FROM tok WHERE starts_with(term, 'erth')""",
    "search_two_fields": f"WITH {two_field_ranking(HITS_TERMS)} SELECT * FROM ranked",
    "search_page": f"""WITH {content_ranking(['the', 'elle'])}
SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 10 OFFSET 20""",
    "search_total": f"""WITH {content_ranking(['the', 'elle'])}
SELECT CAST(20 AS BIGINT) AS "from", CAST(10 AS BIGINT) AS size, count(*) AS total, 'the elle' AS search_phrase FROM ranked""",
    "search_highlight": f"""WITH {content_ranking(['the', 'elle'])},
top AS (SELECT doc_id FROM ranked ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, array_to_string({fragments('content', ['the', 'elle'], 'f')}, chr(10) || '~' || chr(10)) AS fragments
FROM corpus WHERE doc_id IN (SELECT doc_id FROM top)""",
    "snippet_fallback": f"""WITH {CORPUS}
SELECT doc_id, CASE WHEN length(content) > 512 THEN substring(content, 1, 512) || ' ...' ELSE content END AS snippet
FROM corpus""",
    "comment_match": """
WITH last AS (SELECT conv_id, arg_max(text, turn) AS fragment FROM conversations GROUP BY conv_id)
SELECT l.conv_id AS doc_id, fragment, CAST(min(turn) AS VARCHAR) AS comment_id, arg_min(role, turn) AS author
FROM last l JOIN conversations c ON c.conv_id = l.conv_id AND contains(c.text, fragment) GROUP BY l.conv_id, fragment""",
    "comment_highlights": f"""WITH {comment_highlights('TRUE')}
SELECT conv_id AS doc_id, text AS comments FROM comments""",
    "search_hits": f"""WITH {two_field_ranking(HITS_TERMS)},
top AS (SELECT doc_id, score FROM ranked ORDER BY score DESC, doc_id LIMIT 25),
{comment_highlights('conv_id IN (SELECT doc_id FROM top)')}
SELECT uri_file_path AS relative_url, id, {stamp('process_time')} AS process_time, original_file_path AS absolute_url,
       content_type AS document_type, 'officedocuments-' || doc_type AS index_name,
       CASE WHEN len(f) > 0 THEN array_to_string(f, chr(10) || '~' || chr(10))
            WHEN length(content) > 512 THEN substring(content, 1, 512) || ' ...' ELSE content END AS contents,
       coalesce(c.text, '') AS comments, score AS relevance,
       './images/' || CASE doc_type WHEN 'msg' THEN 'outlook' ELSE doc_type END || '.svg' AS program_icon
FROM (SELECT *, {fragments('content', HITS_TERMS, 'f')} AS f FROM corpus) JOIN top USING (doc_id)
LEFT JOIN comments c ON c.conv_id = doc_id""",
    "search_batch": BENCH_BATCH,
    "suggest": f"""WITH {CORPUS},
texts AS (
  SELECT doc_type, content FROM corpus
  UNION ALL SELECT {KINDS}[conv_id % 6 + 1], text FROM conversations WHERE conv_id % 6 < 3),{KIND_TERMS},
offered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY term) AS n, list_position({KINDS}, doc_type) AS r
  FROM kind_terms WHERE starts_with(term, 'er') QUALIFY n <= 10)
SELECT term AS label, string_agg('officedocuments-' || doc_type, '|' ORDER BY r) AS index_names
FROM offered GROUP BY term ORDER BY min(r * 100 + n) LIMIT 10""",
    "document_details": f"WITH {CORPUS} {DETAIL}",
    "document_detail": f"""WITH {CORPUS} {DETAIL}
WHERE id = (SELECT arg_max(id, doc_id) FROM corpus WHERE doc_type = 'word')""",
    "document_detail_missing": """
SELECT '' AS id, '' AS creator, '1970-01-01 00:00:00' AS created, '' AS last_modified_by,
       '1970-01-01 00:00:00' AS modified, '' AS title, '' AS subject, '' AS version, '' AS revision,
       '1970-01-01 00:00:00' AS last_printed, '' AS file_name, '1970-01-01 00:00:00' AS process_time""",
    "index_statistics": f"""WITH {CORPUS}
SELECT 'officedocuments-' || doc_type AS index_name, count(*) AS doc_count, CAST(sum(strlen(content)) AS DOUBLE) AS size_in_bytes
FROM corpus GROUP BY doc_type""",
    "index_statistics_total": f"""WITH {CORPUS}
SELECT 'officedocuments-' || doc_type AS index_name, count(*) AS doc_count, CAST(sum(strlen(content)) AS DOUBLE) AS size_in_bytes
FROM corpus GROUP BY doc_type
UNION ALL SELECT 'total', count(*), CAST(sum(strlen(content)) AS DOUBLE) FROM corpus""",
    "index_activity": f"""WITH {CORPUS},
log AS (
  SELECT 'officedocuments-' || {KINDS}[user_id % 6 + 1] AS index_name, event_type, CAST(round(value * 1000) AS BIGINT) AS ms FROM events),
counts AS (
  SELECT index_name,
    sum(ms) FILTER (event_type = 'view') AS fetch_time_ms, count(*) FILTER (event_type = 'view') AS fetch_total,
    sum(ms) FILTER (event_type = 'click') AS query_time_ms, count(*) FILTER (event_type = 'click') AS query_total,
    sum(ms) FILTER (event_type = 'purchase') AS suggest_time_ms, count(*) FILTER (event_type = 'purchase') AS suggest_total
  FROM log GROUP BY index_name),
sizes AS (
  SELECT 'officedocuments-' || doc_type AS index_name, count(*) AS doc_count, CAST(sum(strlen(content)) AS DOUBLE) AS size_in_bytes
  FROM corpus GROUP BY doc_type)
SELECT index_name, doc_count, size_in_bytes, coalesce(fetch_time_ms, 0)::BIGINT AS fetch_time_ms, coalesce(fetch_total, 0) AS fetch_total,
  coalesce(query_time_ms, 0)::BIGINT AS query_time_ms, coalesce(query_total, 0) AS query_total,
  coalesce(suggest_time_ms, 0)::BIGINT AS suggest_time_ms, coalesce(suggest_total, 0) AS suggest_total
FROM sizes LEFT JOIN counts USING (index_name)""",
    "activity_counters": """
SELECT event_type AS operation, count(*) AS total, CAST(sum(round(value * 1000)) AS BIGINT) AS time_ms
FROM events GROUP BY event_type""",
    "latest_run": f"WITH {RUNS} SELECT model, {RUN_COLUMNS} FROM latest",
    "runtime_statistics": f"""WITH {RUNS}
SELECT short_name, {RUN_COLUMNS}, job_state FROM processors JOIN latest USING (model) JOIN states USING (model)""",
    "job_state_report": f"""WITH {RUNS}
SELECT group_name, model, coalesce(job_state, 'Undefined') AS job_state
FROM processors CROSS JOIN (VALUES ('processing'), ('cleanup')) g(group_name) LEFT JOIN states USING (model)""",
    "runs_tagged_union": f"""WITH {RUNS}
SELECT model, id, elapsed_time_millis, CASE WHEN CAST(id AS BIGINT) % 2 = 1 THEN 'cleanup' ELSE 'processing' END AS group_name
FROM runs""",
}
