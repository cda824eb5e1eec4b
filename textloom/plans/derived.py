"""Rows from the driver's tables for queries that also keep a few literal rows as edge cases.

Each entry is a SELECT in the SQL that Spark and DuckDB share; ``{name}`` stands for a
table and ``LIST(...)`` for an array.
"""

from __future__ import annotations

TURN = "'c' || CAST({0}conv_id AS STRING) || '-' || CAST({0}turn AS STRING)"
PAIR = "{conversations} u LEFT JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'"
WORD = "split_part({0}, ' ', {1})"
TWO = "split_part({0}, ' ', {1}) || ' ' || split_part({0}, ' ', {2})"
PLAIN = "replace(replace(replace(text, '\"', ''), chr(92), ''), chr(10), ' ')"
ARTICLE = "split_part(split_part(html, '<article>', 2), '</article>', 1)"


def braced(inner: str) -> str:
    return f"chr(123) || {inner} || chr(125)"


def times(tag: str, of: str = "html") -> str:
    """How often a tag begins."""
    return f"CAST((length({of}) - length(replace({of}, '<{tag}', ''))) / {len(tag) + 1} AS BIGINT)"


PAGE_NODE = f"""SELECT page_id + 100 AS node, length(html) AS text_len, length({ARTICLE}) AS readable, {times("a ")} AS links, 10 * {times("a ")} AS link_len, 'article' AS tag, '' AS role,
CASE WHEN page_id % 3 = 0 THEN 'post-content' ELSE 'sidebar' END AS class, {times("p>")} AS children, 2 + page_id % 8 AS depth, length(html) AS body_len, length({ARTICLE}) AS sibling_max, 2 * length({ARTICLE}) AS sibling_sum, 1 + page_id % 5 AS siblings FROM {{pages}}"""
PAGE_CANDIDATE = f"""SELECT page_id + 100 AS page, p.provider, length(html) AS text_len, length({ARTICLE}) + 1 AS readable, 10 * {times("a ")} AS link_len, 20 * {times("li")} AS noise_len, {times("h1")} AS h1, {times("h2")} AS h2, {times("p>")} AS paragraphs,
p.provider = 'selector' AS named, 0.0 AS prior, CASE WHEN p.provider = 'readability' THEN 0.9 ELSE NULL END AS mapping, CASE WHEN p.provider = 'readability' THEN 0.8 ELSE NULL END AS coverage FROM {{pages}} CROSS JOIN (SELECT 'selector' AS provider UNION ALL SELECT 'density' UNION ALL SELECT 'readability') p"""
#: Answers of a model: a turn's text under its own id, the next one's under a wrong id.
ANSWER = braced("'\"translations\":[' || chr(123) || '\"id\":\"b' || CAST(turn AS STRING) || '\",\"translated_text\":\"' || " + PLAIN + " || '\"' || chr(125) || ',' || chr(123) || '\"id\":\"x\",\"text\":\"extra\"' || chr(125) || ']'")

AMOUNTS = "SELECT doc_id + 100 AS line_id, text FROM {documents}"
SCORED = "SELECT p_name AS term, CAST(p_size AS BIGINT) AS n FROM {part}"
FULL_NAMES = f"SELECT {TWO.format('text', 1, 2)} AS name FROM {{benchmark}}"
NOISE = f"SELECT lower({WORD.format('text', 3)}) AS term, CAST(length(text) % 3 AS BIGINT) AS total, item_id % 2 = 0 AS at_start FROM {{benchmark}} UNION ALL SELECT {WORD.format('text', 1)}, 1, true FROM {{conversations}}"
COMPATIBLE = f"SELECT {TWO.format('text', 1, 2)} AS source, {WORD.format('text', 2)} AS alias FROM {{benchmark}}"
ENTITIES = f"""SELECT 'b' || CAST(item_id AS STRING) AS node, LIST({TWO.format('text', 1, 2)}, {TWO.format('text', 3, 4)}) AS names, {WORD.format('text', 5)} AS target,
CASE WHEN item_id % 3 = 0 THEN 'candidate' ELSE 'confirmed' END AS status FROM {{benchmark}}"""
EVIDENCE = "SELECT item_id + 100 AS fact, item_id + item_id % 3 AS item_id, substr(text, 5, 12) AS quote FROM {benchmark}"
#: A text put into another script letter by letter, so that what a translation must keep and must change is known.
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上个国和也子时道说出得心"
DRAFT = f"translate(lower(text), '{LETTERS}', '{SIGNS}')"
#: Revisions with planted faults, dealt by a hash of the text and its place: none, blank, wrong numbers, a rest in the source's words, the source itself, other wording.
REVISED = f"""CASE substr(md5(concat(text, '-', CAST(doc_id AS STRING))), 1, 1) WHEN '0' THEN NULL WHEN '1' THEN ' ' WHEN '2' THEN translate({DRAFT}, '0123456789', '1234567890')
WHEN '3' THEN concat({DRAFT}, ' ', text) WHEN '4' THEN text WHEN '5' THEN translate({DRAFT}, '的', '地') ELSE {DRAFT} END"""
BOOK = f"SELECT 'd' || CAST(doc_id AS STRING) AS segment, doc_id + 100 AS ordinal, text, {REVISED} AS translation FROM {{documents}}"
ALIASES = "SELECT 'p' || CAST(p_partkey AS STRING) AS node, LIST(p_name, p_brand) AS names FROM {part}"
USAGE = "SELECT event_id + 10 AS turn, CAST(user_id AS BIGINT) AS input, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS output, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS cost FROM {events}"
CHECKS = "SELECT 'd' || CAST(doc_id AS STRING) AS run, CAST(quality AS DOUBLE) AS required, CAST(1 - toxic AS DOUBLE) AS terms, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.5 END AS repeated, CAST(toxic AS DOUBLE) AS spoilers, 0.75 AS numeric_ok FROM {labels}"
PAYLOADS = "SELECT event_id + 100 AS event_id, " + braced("'\"batchIndex\":' || CAST(user_id AS STRING) || ',\"duplicateCount\":' || CAST(event_id % 3 AS STRING) || ',\"unexpectedCount\":' || CAST(user_id % 2 AS STRING) || ',\"malformedRowCount\":0'") + " AS payload FROM {events}"
USAGES = "SELECT event_id + 100 AS turn_id, " + braced("'\"input\":' || CAST(value AS STRING) || ',\"output\":' || CAST(user_id AS STRING)") + " AS raw FROM {events}"
SETTINGS = "SELECT 'c' || CAST(c_custkey AS STRING) AS name, CAST(c_nationkey AS STRING) AS segs, CAST(c_acctbal AS STRING) AS chars FROM {customer}"
CONFIGS = "SELECT 'p' || CAST(p_partkey AS STRING) AS file, '[' || " + braced("'\"id\":\"' || p_brand || '\",\"credits\":\"x' || CAST(p_size AS STRING) || ' credits\"'") + " || ']' AS raw FROM {part}"
WINDOWS = "SELECT 'p' || CAST(p_partkey AS STRING) AS model, LIST(CAST(p_size AS BIGINT), CAST(p_size * 2 AS BIGINT), CAST(p_size AS BIGINT)) AS sizes, CAST(p_size AS BIGINT) AS default_size FROM {part}"
GATES = "SELECT 'o' || CAST(o_orderkey AS STRING) AS graph, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status, CAST(2 + o_custkey % 2 AS BIGINT) AS revision, 'v2' AS version, 'en' AS source, 'zh' AS target FROM {orders}"
GLOSSARY = f"SELECT item_id + 1000 AS entry, CASE WHEN item_id % 2 = 0 THEN {TWO.format('text', 1, 2)} ELSE NULL END AS term, {TWO.format('text', 6, 7)} AS source, {WORD.format('text', 3)} AS target, CASE WHEN item_id % 5 = 0 THEN 'rejected' ELSE NULL END AS state FROM {{benchmark}}"
DELTAS = f"SELECT conv_id + 10 AS batch, conv_id * 100 + turn + 100 AS first_ordinal, {WORD.format('text', 1)} AS name, {WORD.format('text', 2)} AS target, LIST('c' || CAST(conv_id AS STRING), {TURN.format('')}) AS segments FROM {{conversations}}"
#: Each document must have a translation that keeps its first number and not its second word.
ASKED = f"""SELECT 'r' || CAST(doc_id AS STRING) AS check_id, 'required' AS kind, 'd' || CAST(doc_id AS STRING) AS segment, '' AS expected FROM {{documents}}
UNION ALL SELECT 't' || CAST(doc_id AS STRING), 'term', 'd' || CAST(doc_id AS STRING), regexp_extract(text, '[0-9]+', 0) FROM {{documents}} WHERE regexp_extract(text, '[0-9]+', 0) <> ''
UNION ALL SELECT 'f' || CAST(doc_id AS STRING), 'forbidden', 'd' || CAST(doc_id AS STRING), {WORD.format('text', 2)} FROM {{documents}}"""
FINDINGS = "SELECT 'd' || CAST(doc_id AS STRING) AS finding, quality > 0 AS repairable, LIST('d' || CAST(doc_id AS STRING), 's77') AS segments, toxic = 0 AS chosen FROM {labels}"
MENTIONS = f"SELECT {TURN.format('')} AS segment, lower({WORD.format('text', 1)}) AS entity, {TWO.format('text', 1, 2)} AS surface FROM {{conversations}}"
CUES = "SELECT conv_id + 10 AS file_id, CAST(turn + 1 AS BIGINT) AS cue, '00:00:0' || CAST(turn % 9 AS STRING) || '.000' AS start_at, '00:00:0' || CAST(turn % 9 AS STRING) || '.900' AS end_at, text, CASE WHEN role = 'user' THEN NULL ELSE 'In other words: ' || text END AS translated FROM {conversations}"
TITLES = "SELECT c_name || '/' || c_mktsegment || '?' AS title, CASE WHEN c_custkey % 2 = 0 THEN 'txt' ELSE 'srt' END AS ending FROM {customer}"
N = PAGE_NODE
C = PAGE_CANDIDATE
PAGE_STYLES = "SELECT page_id + 100 AS node, 'height:' || CAST(length(html) AS STRING) || 'px; position: absolute; color: red' AS style FROM {pages}"
PATHS = "SELECT page_id + 10 AS page, 1 AS anchor, LIST('html', 'body', split_part(url, '/', 3), split_part(url, '/', 4), 'p') AS path FROM {pages} UNION ALL SELECT page_id + 10, 2, LIST('html', 'body', split_part(url, '/', 3), 'aside') FROM {pages}"
REGIONS = "SELECT page_id + 10 AS page, r.region, CAST(length(split_part(html, '</p>', r.region)) AS BIGINT) AS n_chars FROM {pages} CROSS JOIN (SELECT 1 AS region UNION ALL SELECT 2 UNION ALL SELECT 3) r"
FOUND = "SELECT page_id + 10 AS page, 'b' || CAST(page_id AS STRING) AS block, url AS path FROM {pages}"
LIVE = "SELECT page_id + 10 AS page, CASE WHEN page_id % 2 = 0 THEN 'b' || CAST(page_id AS STRING) ELSE NULL END AS dom_id, url AS path, page_id AS node FROM {pages} WHERE page_id % 5 > 0"
MEMORY = "SELECT item_id + 10 AS doc, " + braced("'\"entities\":[' || chr(123) || '\"source\":\"' || " + WORD.format(PLAIN, 1) + " || '\",\"target\":\"' || " + WORD.format(PLAIN, 2) + " || '\"' || chr(125) || ']'") + " AS raw FROM {benchmark}"
KEYS = "SELECT doc_id + 100 AS key_id, text AS content, lang AS source, 'zh' AS target, source AS provider, NULL AS style, CASE WHEN doc_id % 2 = 0 THEN 'literary' ELSE NULL END AS mode, NULL AS terms FROM {documents}"
PAIRS = f"SELECT doc_id + 1000 AS pair_id, text AS original, {REVISED} AS translated FROM {{documents}}"
TERMS = f"SELECT doc_id + 100 AS term_id, {WORD.format('text', 2)} AS term FROM {{documents}}"
PRODUCTS = "SELECT p_partkey + 100 AS line_id, 'Acme ' || p_type || ' and Globex ' || p_brand AS text FROM {part}"
ANSWERS = "SELECT conv_id * 100 + turn + 1000 AS answer_id, '<think>' || role || '</think>' || text AS raw FROM {conversations}"
RESULTS = f"SELECT conv_id + 10 AS chunk_id, {ANSWER} AS raw FROM {{conversations}} WHERE turn = 0"
BLOCKS = f"SELECT conv_id + 10 AS chunk_id, 'b' || CAST(turn AS STRING) AS id, CASE WHEN conv_id % 2 = 0 THEN {PLAIN} ELSE text END AS source FROM {{conversations}}"
AGENTS = "SELECT event_id + 100 AS agent_id, 'Mozilla/5.0 (' || CASE user_id % 3 WHEN 0 THEN 'Windows NT 10.0' WHEN 1 THEN 'X11; Linux x86_64' ELSE 'iPhone' END || ') Chrome/' || CAST(user_id AS STRING) || '.0 Safari/537.36' AS agent FROM {events}"
ADDRESSES = "SELECT page_id + 5000 AS url_id, url FROM {pages}"
CREDITS = "SELECT p_brand || CAST(p_partkey AS STRING) AS model, 'x' || CAST(p_size AS STRING) || '.5 credits' AS label FROM {part}"
BUDGETS = "SELECT CAST(p_size AS BIGINT) AS pool, CAST(p_partkey % 7 AS BIGINT) AS runs, CAST(p_size % 11 AS BIGINT) AS wanted FROM {part}"
PROSE = f"SELECT doc_id + 100 AS text_id, {TWO.format('text', 1, 2)} AS text FROM {{documents}} UNION ALL SELECT page_id + 1000000, url FROM {{pages}}"
NAMES = f"SELECT doc_id + 100 AS name_id, text, {WORD.format('text', 3)} AS name FROM {{documents}}"
STYLES = "SELECT CASE WHEN doc_id % 2 = 0 THEN 'default' ELSE NULL END AS style, lang AS language, 'zh' AS target FROM {documents}"
FILES = "SELECT source || '.' || lang AS name, NULL AS media FROM {documents} UNION ALL SELECT url, 'text/html' FROM {pages}"
SRT = "SELECT conv_id * 100 + turn + 1000 AS file_id, '1' || chr(10) || '00:00:01,000 --> 00:00:02,500' || chr(10) || text AS text FROM {conversations}"
VTT = "SELECT conv_id * 100 + turn + 1000 AS file_id, 'WEBVTT' || chr(10) || chr(10) || '00:01.000 --> 00:02.000' || chr(10) || text AS text FROM {conversations}"
CATALOG = "SELECT 1 + p_partkey % 3 AS layer, p_brand AS model, CAST(min(p_retailprice) AS DOUBLE) AS credits, min(p_type) AS label FROM {part} GROUP BY 1 + p_partkey % 3, p_brand"
JSONS = "SELECT conv_id * 100 + turn + 1000 AS row_id, 'Sure: ' || " + braced("'\"t\":\"' || " + PLAIN + " || '\"'") + " || ' done' AS raw FROM {conversations} UNION ALL SELECT conv_id * 100 + turn + 1000000, chr(123) || '\"t\":[\"' || " + PLAIN + " FROM {conversations}"
SPACED = "SELECT p_partkey + 100 AS row_id, 'A B C D ' || p_name AS text FROM {part}"
