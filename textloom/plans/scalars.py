"""Queries over scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules, text as T
from textloom.functions.text import SPACE
from textloom.operators import passages
from textloom.plans import derived
from textloom.plans.base import Literal, query, table


def n_of(expr: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({expr}, '{pattern.replace(chr(39), chr(39) * 2)}')), 0)"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def strip_sql(x: str, inner: str = SPACE) -> str:
    return f"regexp_replace({x}, '^[{inner}]+|[{inner}]+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'), ' ')"


SCRIPTS = Literal(
    "text_id long, text string, tag string",
    (
        (1, "これは日本語の文章です。とても長い文章を書いています。" * 4, "ja"), (2, "这是一个中文句子，用来测试语言检测。" * 8, None), (3, "한국어 문장을 시험합니다. 언어를 찾습니다. " * 8, "ko"),
        (4, "Plain English prose that goes on for a while, long enough to be judged by its letters alone, surely.", "en"), (5, "short", "en"), (6, "Русский текст " * 20, "ru"),
        (7, "漢字カナ混じり", "ja-JP"), (8, "日本語テスト" * 20, "ja-JP"), (9, "mixed 中文 and English words here with more Latin letters than anything else in the whole line, yes really so", None), (10, "", None),
    ),
)
LANG_INPUT = f"(SELECT text_id, text, tag FROM {SCRIPTS.sql()} s UNION ALL SELECT 1000 + doc_id, text, lang FROM documents)"


def lang_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SCRIPTS.df(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("text_id"), "text", F.col("lang").alias("tag")))


@query(
    "scl01_detect_language",
    f"""WITH c AS (SELECT text_id, tag, {n_of("left(text, 20000)", T.HIRAGANA)} + {n_of("left(text, 20000)", T.KATAKANA)} AS kana, {n_of("left(text, 20000)", T.HANGUL)} AS hangul,
{n_of("left(text, 20000)", T.CJK)} AS cjk, {n_of("left(text, 20000)", T.LATIN)} AS latin FROM {LANG_INPUT} i),
m AS (SELECT *, kana + hangul + cjk + latin AS n FROM c),
l AS (SELECT *, CASE WHEN n < 80 THEN 'unknown' WHEN kana >= 5 AND kana / n >= 0.03 THEN 'ja' WHEN hangul >= 5 AND hangul / n >= 0.15 THEN 'ko' WHEN cjk >= 5 AND kana = 0 AND cjk / n >= 0.25 THEN 'zh' WHEN latin / n >= 0.5 THEN 'en' ELSE 'unknown' END AS language FROM m)
SELECT text_id, n AS meaningful, language, CASE WHEN n = 0 THEN 0.0 ELSE round(kana / n, 6) END AS kana_ratio, CASE WHEN n = 0 THEN 0.0 ELSE round(cjk / n, 6) END AS kanji_ratio,
round(CASE language WHEN 'ja' THEN least(1.0, 0.7 + least(kana / n, 0.3) + CASE WHEN regexp_matches(lower(tag), '^ja($|[^a-z0-9_])') THEN 0.1 ELSE 0 END) WHEN 'ko' THEN 0.9 WHEN 'zh' THEN 0.9 WHEN 'en' THEN 0.8 ELSE 0 END, 6) AS confidence FROM l""",
)
def scl01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.language_evidence(F.col("text"))
    c = lang_input(spark, sf_dir).select("text_id", "tag", (e["hiragana"] + e["katakana"]).alias("kana"), e["hangul"].alias("hangul"), e["cjk"].alias("cjk"), e["latin"].alias("latin"))
    m = c.withColumn("n", F.col("kana") + F.col("hangul") + F.col("cjk") + F.col("latin")).withColumn("language", T.language_label(F.col("kana"), F.col("hangul"), F.col("cjk"), F.col("latin")))
    ratio = lambda k: F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide(F.col(k), F.col("n")))
    tagged = F.coalesce(F.lower("tag").rlike("^ja($|[^a-z0-9_])"), F.lit(False))
    return m.select(
        "text_id", F.col("n").alias("meaningful"), "language", F.round(ratio("kana"), 6).alias("kana_ratio"), F.round(ratio("cjk"), 6).alias("kanji_ratio"),
        F.round(T.language_confidence(F.col("language"), ratio("kana"), tagged), 6).alias("confidence"),
    )


WIDE_N = n_of("text", T.WIDE)


@query("scl02_estimate_tokens", f"SELECT text_id, CAST(ceil({WIDE_N} * 0.5 + (length(text) - {WIDE_N}) * 0.25) AS BIGINT) AS tokens, CAST(least(131072, greatest(2048, ceil(length(text) / 2) * 6)) AS BIGINT) AS max_tokens FROM {LANG_INPUT} i")
def scl02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_input(spark, sf_dir).select("text_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.estimate_output_tokens(F.col("text")).alias("max_tokens"))


def rolling_sql(x: str) -> str:
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 2147483647)"


@query("scl04_rolling_hash", f"SELECT item_id, {rolling_sql('text')} AS hash FROM benchmark")
def scl04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.rolling_hash(F.col("text")).alias("hash"))


KEYS = Literal(
    "key_id long, content string, source string, target string, provider string, style string, mode string, terms string",
    ((1, '[{"id":"b1","text":"Hello"}]', "en", "zh", None, None, None, None), (2, '[{"id":"b1","text":"Hello"}]', "en", "zh", "p", "s", None, None), (3, "x" * 300, "en", "ja", None, "s", "literary", "[\"a\"]"), (4, "", "auto", "zh", None, None, None, None), (5, "é中文", "fr", "zh", "p", None, "m", None)),
    more=derived.KEYS,
)
EXTRA = "'v5|' || CASE WHEN provider IS NULL AND style IS NULL THEN '' ELSE coalesce(provider, '') || ':' || coalesce(style, '') END || CASE WHEN terms IS NULL THEN '' ELSE '|g' || CAST({terms} AS VARCHAR) END || CASE WHEN mode IS NULL THEN '' ELSE '|m' || mode END"


@query(
    "scl05_cache_key",
    f"WITH e AS (SELECT *, {EXTRA.format(terms=rolling_sql('terms'))} AS extra FROM {KEYS.sql()} k) SELECT key_id, 'translation_' || source || '_' || target || '_' || CAST({rolling_sql('content || extra')} AS VARCHAR) || '_' || CAST({rolling_sql('left(content, 200) || extra')} AS VARCHAR) AS cache_key FROM e",
)
def scl05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    named = F.when(c("provider").isNull() & c("style").isNull(), "").otherwise(F.concat(F.coalesce("provider", F.lit("")), F.lit(":"), F.coalesce("style", F.lit(""))))
    terms = F.when(c("terms").isNull(), "").otherwise(F.concat(F.lit("|g"), T.rolling_hash(c("terms")).cast("string")))
    extra = F.concat(F.lit("v5|"), named, terms, F.when(c("mode").isNull(), "").otherwise(F.concat(F.lit("|m"), "mode")))
    e = KEYS.df(spark, sf_dir).withColumn("extra", extra)
    hashed = lambda x: T.rolling_hash(F.concat(x, "extra")).cast("string")
    return e.select("key_id", F.concat_ws("_", F.lit("translation"), "source", "target", hashed("content"), hashed(F.substring("content", 1, 200))).alias("cache_key"))


@query(
    "scl06_page_fingerprint",
    f"SELECT page_id, 'page:' || md5(html) || ':' || CAST({rolling_sql(chr(39) + 'provider|default|technical|' + chr(39) + ' || url')} AS VARCHAR) AS fingerprint FROM pages",
)
def scl06(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = T.rolling_hash(F.concat(F.lit("provider|default|technical|"), "url")).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page:"), F.md5(F.col("html").cast("binary")), F.lit(":"), context).alias("fingerprint"))


FNV = "lpad(format('{{:x}}', list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')"


@query("scl07_finding_ids", "SELECT doc_id, 'qf_' || " + FNV.format(x="'missing:' || CAST(doc_id AS VARCHAR) || ':' || lang") + " AS finding_id FROM documents")
def scl07(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("missing:"), F.col("doc_id").cast("string"), F.lit(":"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("qf_"), T.fnv_hex(name)).alias("finding_id"))


@query("scl08_content_hashes", "SELECT doc_id, sha256(text) AS text_hash, left(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 32) AS node_id FROM documents")
def scl08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.substring(F.sha2(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")), 256), 1, 32).alias("node_id"))


@query("scl09_run_fingerprint", "SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority, ';' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY o_custkey")
def scl09(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["row"]), ";"), 256).alias("fingerprint"))


@query("scl10_normal_forms", f"SELECT item_id, {collapse_sql('lower(text)')} AS folded, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS words FROM benchmark")
def scl10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.collapse(F.lower("text")).alias("folded"), T.bare_words(F.col("text")).alias("words"))


PAIRS = Literal(
    "pair_id long, original string, translated string",
    (
        (1, "Short title", "一个很长的译文。" * 12), (2, "A normal sentence. And another one here.", "一句正常的话。还有一句。"), (3, "", "有译文"), (4, None, None), (5, "One. Two. Three. Four.", "一句"),
        (6, "A long original text that keeps going well past forty characters so that shortness counts.", "短"), (7, "Heading", "一。二。三。四。"), (8, "1. 2. 3.", "!!!"), (9, "Line one\nline two\nline three", "一行"), (10, "Same length here", "same length there"),
    ),
    more=derived.PAIRS,
)


def sentences_sql(x: str) -> str:
    return f"len(list_filter(string_split_regex(regexp_replace(coalesce({x}, ''), '[\\n\\r]+', '。', 'g'), '[.!?;。！？；]+'), lambda p: regexp_matches(p, '[\\x{{4e00}}-\\x{{9fff}}a-zA-Z]')))"


SOLID = f"length(regexp_replace(coalesce({{0}}, ''), '[{SPACE.replace('{', '{{').replace('}', '}}')}]', '', 'g'))"


@query("scl11_sentence_counts", f"SELECT doc_id, {sentences_sql('text')} AS n_sentences, {SOLID.format('text')} AS n_solid FROM documents")
def scl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.count_sentences(F.col("text")).alias("n_sentences"), T.solid_length(F.col("text")).alias("n_solid"))


@query(
    "scl12_mapping_verdicts",
    f"""WITH m AS (SELECT pair_id, {SOLID.format("original")} AS o, {SOLID.format("translated")} AS t, {sentences_sql("original")} AS so, {sentences_sql("translated")} AS st FROM {PAIRS.sql()} p),
r AS (SELECT *, CASE WHEN o = 0 THEN CASE WHEN t = 0 THEN 1.0 ELSE CAST('inf' AS DOUBLE) END ELSE t / o END AS cr, CASE WHEN so = 0 THEN CASE WHEN st = 0 THEN 1.0 ELSE CAST('inf' AS DOUBLE) END ELSE st / so END AS sr FROM m)
SELECT pair_id, o AS orig_chars, t AS trans_chars, so AS orig_sentences, st AS trans_sentences, round(cr, 6) AS char_ratio, round(sr, 6) AS sentence_ratio,
array_to_string(list_filter([CASE WHEN o = 0 AND t > 0 THEN 'empty-source' END, CASE WHEN abs(t - o) >= 25 AND o > 0 AND cr > 3.5 THEN 'too-long' END, CASE WHEN abs(t - o) >= 25 AND o > 40 AND cr < 0.2 THEN 'too-short' END,
CASE WHEN so >= 1 AND st >= 1 AND sr > 2.5 THEN 'more-sentences' END, CASE WHEN so >= 1 AND st >= 1 AND sr < 0.34 THEN 'fewer-sentences' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
)
def scl12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the counts become rows before they are used: an expression that stands in several others would run for each
    pairs = PAIRS.df(spark, sf_dir).select("pair_id", F.explode(F.array(F.struct("original", "translated"))).alias("p")).select("pair_id", "p.*")
    counted = pairs.select("pair_id", F.struct(*[v.alias(k) for k, v in rules.mapping_counts(F.col("original"), F.col("translated")).items()]).alias("n"))
    rows = counted.select("pair_id", F.explode(F.array("n")).alias("n")).select("pair_id", "n.*")
    chars, sentences = rules.mapping_ratios()
    return rows.select(
        "pair_id", "orig_chars", "trans_chars", "orig_sentences", "trans_sentences", F.round(chars, 6).alias("char_ratio"), F.round(sentences, 6).alias("sentence_ratio"),
        F.array_join(rules.mapping_reasons(), ",").alias("reasons"),
    )


@query("scl13_quotations", "SELECT doc_id, pos, quotation FROM (SELECT doc_id, generate_subscripts(qs, 1) AS pos, unnest(qs) AS quotation FROM (SELECT doc_id, regexp_extract_all(text, '\"([^\"]{1,1000})\"', 1) AS qs FROM documents))")
def scl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.posexplode(F.regexp_extract_all("text", F.lit('"([^"]{1,1000})"'), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", quoted.alias("pos", "quotation")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "quotation")


@query(
    "scl16_digit_sequences",
    r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+(?:[,.][0-9]+)*'), lambda x: replace(x, ',', '')), ',') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')",
)
def scl16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[0-9]+(?:[,.][0-9]+)*"), F.lit(0))
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.array_join(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))), ",").alias("numbers"))


TERMS = Literal("term_id long, term string", ((1, "  'quoted' "), (2, "OpenGL's"), (3, "(Model)"), (4, "…dots…"), (5, "plain"), (6, "it’s"), (7, "--dash--"), (8, "James’"), (9, "\"double\",")), more=derived.TERMS)
EDGE = r"""[\s"'“”‘’`.,;:!?()\[\]{}<>…—–-]+"""


@query("scl20_clean_terms", f"SELECT term_id, regexp_replace(regexp_replace(term, '^{EDGE.replace(chr(39), chr(39) * 2)}|{EDGE.replace(chr(39), chr(39) * 2)}$', '', 'g'), '[''’]s$', '') AS cleaned FROM {TERMS.sql()} t")
def scl20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TERMS.df(spark, sf_dir).select("term_id", F.regexp_replace(F.regexp_replace("term", f"^{EDGE}|{EDGE}$", ""), "['’]s$", "").alias("cleaned"))


PRODUCTS = Literal("line_id long, text string", ((1, "We use Acme Turbo 9 and Acme Rocket daily"), (2, "Globex Cloud X1 beats Initech"), (3, "nothing here"), (4, "Globex Cloud X1, again Globex Cloud X1")), more=derived.PRODUCTS)
VENDOR = r"(?:Acme|Globex|Initech)(?: [A-Z0-9][A-Za-z0-9]*){0,3}"


@query("scl21_product_names", f"SELECT line_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '{VENDOR}'), lambda x: length(x) >= 3))), '|') AS products FROM {PRODUCTS.sql()} p")
def scl21(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.regexp_extract_all("text", F.lit(VENDOR), F.lit(0)), lambda x: F.char_length(x) >= 3)
    return PRODUCTS.df(spark, sf_dir).select("line_id", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("products"))


ANSWERS = Literal(
    "answer_id long, raw string",
    ((1, "<think>hm\nhm</think>\n```json\n{\"a\": 1}\n```"), (2, "plain [1,2]"), (3, "```\ntext\n```"), (4, "<thinking>x</thinking>{\"b\":\"c\"}"), (5, "  {\"d\": 2}  ")),
    more=derived.ANSWERS,
)


@query("scl22_strip_wrappers", f"SELECT answer_id, trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?is)<think(ing)?>.*?</think(ing)?>', '', 'g'), '(?i)^\\s*```[a-z]*\\s*', ''), '\\s*```\\s*$', ''), ' ' || chr(10)) AS body FROM {ANSWERS.sql()} a")
def scl22(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("raw", "(?is)<think(ing)?>.*?</think(ing)?>", "")
    return ANSWERS.df(spark, sf_dir).select("answer_id", F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^\s*```[a-z]*\s*", ""), r"\s*```\s*$", ""), F.lit(" \n")).alias("body"))


RESULTS = Literal(
    "chunk_id long, raw string",
    (
        (1, '{"translations":[{"id":"b1","translated_text":"eins"},{"id":"b2","text":"zwei"},{"id":"b2","translated_text":"again"},{"id":"x9","translated_text":"extra"},{"id":"b4","translated_text":"  "}]}'),
        (2, '{"translations":[{"id":"b1","translation":"same"},{"id":"b3","translated_text":"drei","text":"no"}]}'),
        (3, '{"translations":[]}'),
    ),
    more=derived.RESULTS,
)
BLOCKS = Literal("chunk_id long, id string, source string", ((1, "b1", "one"), (1, "b2", "two"), (1, "b3", "three"), (1, "b4", "four"), (2, "b1", "same"), (2, "b3", "three"), (3, "b1", "one")), more=derived.BLOCKS)
ANSWER_ROWS = f"""(SELECT chunk_id, generate_subscripts(rs, 1) AS pos, unnest(rs) AS r FROM (SELECT chunk_id, CAST(json_extract(raw, '$.translations') AS JSON[]) AS rs FROM {RESULTS.sql()} a))"""


@query(
    "scl24_translation_results",
    f"""WITH a AS (SELECT chunk_id, pos, json_extract_string(r, '$.id') AS id, coalesce(json_extract_string(r, '$.translated_text'), json_extract_string(r, '$.text'), json_extract_string(r, '$.translation')) AS text FROM {ANSWER_ROWS}),
f AS (SELECT * FROM a WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY chunk_id, id ORDER BY pos) = 1)
SELECT coalesce(b.chunk_id, f.chunk_id) AS chunk_id, coalesce(b.id, f.id) AS id, f.text, CASE WHEN b.id IS NULL THEN 'extra' WHEN f.id IS NULL THEN 'missing' WHEN f.text = b.source THEN 'unchanged' ELSE 'ok' END AS verdict
FROM {BLOCKS.sql()} b FULL JOIN f ON b.chunk_id = f.chunk_id AND b.id = f.id""",
)
def scl24(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.results import answer_rows, judge_answers

    return judge_answers(BLOCKS.df(spark, sf_dir), answer_rows(RESULTS.df(spark, sf_dir), "chunk_id", "raw"), "chunk_id")


AGENTS = Literal(
    "agent_id long, agent string",
    (
        (1, "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.1"), (2, "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15"),
        (3, "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1"), (4, "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0"),
        (5, "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Mobile Safari/537.36"), (6, "curl/8.4.0"), (7, ""),
    ),
    more=derived.AGENTS,
)


@query(
    "scl25_user_agents",
    f"""SELECT agent_id, CASE WHEN agent LIKE '%Edg/%' THEN 'Edge' WHEN agent LIKE '%Firefox/%' THEN 'Firefox' WHEN agent LIKE '%Chrome/%' THEN 'Chrome' WHEN agent LIKE '%Version/%' AND agent LIKE '%Safari/%' THEN 'Safari' ELSE 'unknown' END AS browser,
regexp_extract(agent, '(?:Edg|Firefox|Version)/(\\d+)', 1) AS version, CASE WHEN agent LIKE '%iPhone%' OR agent LIKE '%iPad%' THEN 'iOS' WHEN agent LIKE '%Android%' THEN 'Android' WHEN agent LIKE '%Windows%' THEN 'Windows' WHEN agent LIKE '%Mac OS X%' THEN 'macOS' WHEN agent LIKE '%Linux%' THEN 'Linux' ELSE 'unknown' END AS os,
CASE WHEN regexp_matches(agent, 'iPad|Tablet') THEN 'tablet' WHEN regexp_matches(agent, 'Mobi|iPhone|Android') THEN 'mobile' ELSE 'desktop' END AS device FROM {AGENTS.sql()} a""",
)
def scl25(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("agent")
    has = a.contains
    browser = F.when(has("Edg/"), "Edge").when(has("Firefox/"), "Firefox").when(has("Chrome/"), "Chrome").when(has("Version/") & has("Safari/"), "Safari").otherwise("unknown")
    os = F.when(has("iPhone") | has("iPad"), "iOS").when(has("Android"), "Android").when(has("Windows"), "Windows").when(has("Mac OS X"), "macOS").when(has("Linux"), "Linux").otherwise("unknown")
    device = F.when(a.rlike("iPad|Tablet"), "tablet").when(a.rlike("Mobi|iPhone|Android"), "mobile").otherwise("desktop")
    return AGENTS.df(spark, sf_dir).select("agent_id", browser.alias("browser"), F.regexp_extract(a, r"(?:Edg|Firefox|Version)/(\d+)", 1).alias("version"), os.alias("os"), device.alias("device"))


ADDRESSES = Literal(
    "url_id long, url string",
    tuple(enumerate(["https://example.com/a", "http://localhost/x", "ftp://example.com", "https://10.0.0.1/", "http://172.16.5.4", "http://172.32.0.1", "https://example.com:8080/", "https://example.com:443/", "http://printer.local/", "http://x.internal", "http://169.254.169.254/latest", "nonsense", "http://192.0.2.9", "http://8.8.8.8", "https://user:pw@192.168.1.1/", "http://999.1.1.1", "http://localhost./", "https:///nohost", "http://100.100.1.1", "http://224.0.0.1"])),
    more=derived.ADDRESSES,
)
URL_SQL = """WITH u AS (SELECT url_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', '') AS authority FROM {0}),
h AS (SELECT *, regexp_extract(authority, ':(\\d+)$', 1) AS port, regexp_replace(lower(regexp_replace(authority, ':\\d+$', '')), '\\.$', '') AS host FROM u),
o AS (SELECT *, TRY_CAST(string_split(host, '.')[1] AS INT) AS a, TRY_CAST(string_split(host, '.')[2] AS INT) AS b, TRY_CAST(string_split(host, '.')[3] AS INT) AS c, TRY_CAST(string_split(host, '.')[4] AS INT) AS d FROM h)
SELECT url_id, CASE WHEN scheme = '' THEN 'invalid' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN port NOT IN ('', '80', '443') THEN 'port' WHEN host = 'localhost' OR ends_with(host, '.localhost') THEN 'localhost'
WHEN ends_with(host, '.internal') OR ends_with(host, '.local') THEN 'internal' WHEN regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') AND (greatest(a, b, c, d) > 255 OR a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)
OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224) THEN 'private' END AS refusal FROM o"""


@query("flt04_public_url", URL_SQL.format(f"(SELECT * FROM {ADDRESSES.sql()} x UNION ALL SELECT 1000 + page_id AS url_id, url FROM pages)"))
def flt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ADDRESSES.df(spark, sf_dir).unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("url_id"), "url"))
    return urls.select("url_id", rules.url_refusal(F.col("url")).alias("refusal"))


@query("scl26_normalize_url", f"WITH n AS (SELECT url_id, url, regexp_replace(url, '(?i)^https?://', '') AS bare FROM {ADDRESSES.sql()} a) SELECT url_id, CASE WHEN regexp_extract(bare, '^([^/]*)', 1) <> '' AND NOT contains(regexp_extract(bare, '^([^/]*)', 1), '.') THEN regexp_extract(bare, '^([^/]*)', 1) || '.com' || bare[length(regexp_extract(bare, '^([^/]*)', 1)) + 1:] ELSE bare END AS url FROM n")
def scl26(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "(?i)^https?://", "")
    host = F.regexp_extract(bare, "^([^/]*)", 1)
    dotted = F.when((host != "") & ~host.contains("."), F.concat(host, F.lit(".com"), F.regexp_replace(bare, "^[^/]*", ""))).otherwise(bare)
    return ADDRESSES.df(spark, sf_dir).select("url_id", dotted.alias("url"))


CREDITS = Literal("model string, label string", (("a", "x0.11 credits"), ("b", "X2 credits"), ("c", "free"), ("d", None), ("e", "x1.5x credits"), ("f", "0.3 credits")), more=derived.CREDITS)


@query("scl27_parse_credits", f"SELECT model, TRY_CAST(regexp_extract(label, '(?i)^x?([0-9]+(?:\\.[0-9]+)?)\\s*credits?$', 1) AS DOUBLE) AS credits FROM {CREDITS.sql()} c")
def scl27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CREDITS.df(spark, sf_dir).select("model", F.regexp_extract("label", r"(?i)^x?([0-9]+(?:\.[0-9]+)?)\s*credits?$", 1).try_cast("double").alias("credits"))


@query("scl28_extractive_summary", """WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT conv_id, max(n) AS n, left(string_agg(text, ' ' ORDER BY p) FILTER (WHERE p <= 3), 420) AS head, max(CASE WHEN p = n THEN left(text, 140) END) AS tail FROM r GROUP BY conv_id)
SELECT conv_id, left(CASE WHEN n > 5 AND NOT contains(head, tail) THEN head || ' … ' || tail ELSE head END, 600) AS summary FROM s""")
def scl28(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.segments import extractive_summary

    return extractive_summary(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"])


@query("scl29_stable_ids", "SELECT doc_id, regexp_replace(lower(source || '/' || lang), '[^a-z0-9]+', '-', 'g') || '-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS stable_id FROM documents")
def scl29(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_replace(F.lower(F.concat("source", F.lit("/"), "lang")), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(slug, F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("stable_id"))


@query("scl30_marker_counts", "SELECT item_id, (length(masked) - length(replace(masked, '__TERM_', ''))) // 7 AS markers FROM (SELECT item_id, replace(replace(lower(text), ' the ', ' __TERM_001__ '), ' de ', ' __TERM_002__ ') AS masked FROM benchmark)")
def scl30(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.replace(F.replace(F.lower("text"), F.lit(" the "), F.lit(" __TERM_001__ ")), F.lit(" de "), F.lit(" __TERM_002__ "))
    gone = F.replace(masked, F.lit("__TERM_"), F.lit(""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.floor((F.char_length(masked) - F.char_length(gone)) / 7).cast("long").alias("markers"))


@query("scl32_time_arithmetic", "SELECT event_id, epoch_us(ts) // 1000 AS at_ms, epoch_us(ts) // 1000 + 604800000 AS expires_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def scl32(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", at.alias("at_ms"), (at + 604800000).alias("expires_ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


BUDGETS = Literal("pool long, runs long, wanted long", ((8, 1, 4), (8, 3, 4), (2, 5, 4), (0, 1, 1), (16, 2, 100), (7, 2, 0)), more=derived.BUDGETS)


@query("scl35_concurrency_budget", f"SELECT pool, runs, wanted, greatest(1, least(greatest(wanted, 1), greatest(pool, 1) // greatest(runs, 1))) AS workers FROM {BUDGETS.sql()} b")
def scl35(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.floor(F.greatest("pool", F.lit(1)) / F.greatest("runs", F.lit(1))).cast("long")
    return BUDGETS.df(spark, sf_dir).withColumn("workers", F.greatest(F.lit(1).cast("long"), F.least(F.greatest("wanted", F.lit(1)), share)))


VALID = Literal(
    "text_id long, text string",
    ((1, "EMAIL"), (2, "2024"), (3, "ok"), (4, "  Fine text "), (5, None), (6, "['a', 1] " * 9), (7, "A" * 250), (8, "SUBSCRIBE TO OUR NEWSLETTER NOW"), (9, "x" * 100000), (10, "\u200bab\u200b"), (11, "['a', 1] " * 7)),
)


@query(
    "flt01_valid_text",
    f"WITH t AS (SELECT text_id, {strip_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS s FROM (SELECT * FROM {VALID.sql()} v UNION ALL SELECT 1000 + doc_id, text FROM documents) i) SELECT text_id, length(s) >= 3 AND length(s) < 100000 AND NOT (length(s) < 25 AND {matches('s', '^[A-Z0-9' + chr(92) + 's]+$')} AND NOT {matches('s', '^[0-9' + chr(92) + 's]+$')}) AND {n_of('s', rules.TUPLE_RE)} < 8 AND NOT {matches('s', '^[A-Za-z0-9+/=_-]{200,}$')} AS valid FROM t",
)
def flt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = VALID.df(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("text_id"), "text"))
    return rows.select("text_id", rules.is_valid_text(F.col("text")).alias("valid"))


@query("flt02_trim_invisible", f"SELECT text_id, {strip_sql('text', T.INVISIBLE)} AS text FROM {VALID.sql()} v")
def flt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VALID.df(spark, sf_dir).select("text_id", T.strip(F.col("text"), T.INVISIBLE).alias("text"))


PROSE = Literal("text_id long, text string", tuple(enumerate(["https://a.b/c", "me@example.com", "deadbeefdeadbeef00", "2024-01-02 10:00", "#fff", "Real words", "12345", "日本", "  #abcdef  ", "a", "---"])), more=derived.PROSE)


@query("flt03_prose_strings", f"WITH t AS (SELECT text_id, {strip_sql('text')} AS s FROM {PROSE.sql()} p) SELECT text_id, length(s) >= 1 AND {matches('s', chr(92) + 'p{L}')}" + "".join(f" AND NOT {matches('s', p)}" for p in rules.NOT_PROSE) + " AS prose FROM t")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PROSE.df(spark, sf_dir).select("text_id", rules.is_prose(F.col("text")).alias("prose"))


PARKED = Literal(
    "page_id long, html string",
    (
        (1, "<html><title>example.com - cheap cars Resources and Information.</title><body>x</body></html>"), (2, "<title>Shop</title><body><p>This domain is for sale! Buy it.</p></body>"), (3, "<title>News</title><script>this domain is for sale</script><p>Regular article text.</p>"),
        (4, "<title>a</title><p>Related Searches</p><a>Privacy Policy</a>"), (5, "<!-- buy this domain --><p>ok</p>"), (6, "<p>Related searches</p>" + "word " * 1200 + "privacy policy"),
    ),
)
STRONG_SQL = "(?s)" + rules.STRONG


@query(
    "flt05_parking_pages",
    f"""WITH p AS (SELECT page_id, {collapse_sql("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g')")} AS title,
{collapse_sql(f"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '{STRONG_SQL}', ' ', 'g'), '<[^>]+>', ' ', 'g')")} AS body FROM (SELECT * FROM {PARKED.sql()} k UNION ALL SELECT 1000 + page_id, html FROM pages) i)
SELECT page_id, CASE WHEN {matches("title", rules.PARKED_TITLE)} THEN 'title' WHEN length(body) < 20000 AND {matches("body", rules.PARKED_BODY)} THEN 'body'
WHEN length(body) < 5000 AND regexp_matches(body, '(?i)(^|\\W)related searches(\\W|$)') AND regexp_matches(body, '(?i)(^|\\W)privacy policy(\\W|$)') THEN 'template' END AS reason FROM p""",
)
def flt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PARKED.df(spark, sf_dir).unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("page_id"), "html"))
    return rows.select("page_id", rules.parking_reason(rules.page_title(F.col("html")), rules.page_words(F.col("html"))).alias("reason"))


@query("flt09_dialogue", f"SELECT doc_id, {n_of('text', '[“”「」『』' + chr(34) + ']')} AS quotes, {n_of('text', '[“”「」『』' + chr(34) + ']')} >= 2 OR {matches('text', rules.DASH_RE)} OR {matches('text', rules.SPEECH_RE)} AS dialogue FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -line_id, line FROM (VALUES (1, '“Hi,” she said.'), (2, '— Who goes there'), (3, 'He told no one'), (4, 'untold story')) v(line_id, line))")
def flt09(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, "“Hi,” she said."), (-2, "— Who goes there"), (-3, "He told no one"), (-4, "untold story")], "doc_id long, text string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    return rows.select("doc_id", T.quote_count(F.col("text")).alias("quotes"), rules.is_dialogue(F.col("text")).alias("dialogue"))


NAMES = Literal("name_id long, text string, name string", ((1, "The King Rat spoke.", "king rat"), (2, "Ratking", "rat"), (3, "孙悟空来了", "悟空"), (4, "O'Neil said", "o'neil"), (5, "x y", "z"), (6, "anything", ""), (7, "A b c", "a"), (8, "Jean-Luc came", "jean luc")), more=derived.NAMES)
PAD = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ') || ' '"
CONTAINS = f"""CASE WHEN trim(name) = '' THEN false WHEN regexp_matches(name, '(?i)^[a-z0-9 ._''’-]+$') THEN length({PAD.format("name")}) >= 4 AND contains({PAD.format("text")}, {PAD.format("name")}) ELSE contains({collapse_sql("lower(text)")}, {collapse_sql("lower(name)")}) END"""


@query("flt11_name_containment", f"SELECT name_id, {CONTAINS} AS contained FROM {NAMES.sql()} n")
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("name_id", rules.contains_name(F.col("text"), F.col("name")).alias("contained"))


@query("flt12_target_present", f"""SELECT name_id, CASE WHEN regexp_matches(name, '(?i)^[a-z0-9 ._''’-]+$') THEN {PAD.format("name")} = '  ' OR contains({PAD.format("text")}, {PAD.format("name")}) ELSE contains(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) END AS present FROM {NAMES.sql()} n""")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("name_id", rules.target_present(F.col("text"), F.col("name")).alias("present"))


@query("flt13_grounded_quotes", "SELECT b.item_id, count(d.doc_id) > 0 AS grounded, count(d.doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 4 GROUP BY b.item_id")
def flt13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote against every document."""
    quotes = table(spark, sf_dir, "benchmark").where(F.char_length("text") >= 4)
    found = passages.holding(table(spark, sf_dir, "documents"), "doc_id", quotes, "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return quotes.join(found, "item_id", "left").select("item_id", (n > 0).alias("grounded"), n.alias("documents"))


@query("flt18_retry_missing", "SELECT o_orderkey % 7 AS missing, o_orderstatus = 'F' AS is_retry, count(*) AS n, bool_and(o_orderkey % 7 > 0 AND o_orderstatus <> 'F') AS should_retry FROM orders GROUP BY 1, 2")
def flt18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("missing"), (F.col("o_orderstatus") == "F").alias("is_retry"))
    return rows.groupBy("missing", "is_retry").agg(F.count(F.lit(1)).alias("n"), F.every((F.col("missing") > 0) & ~F.col("is_retry")).alias("should_retry"))


STYLES = Literal("style string, language string, target string", ((None, "ja", "zh"), ("default", "ja", "zh-CN"), ("formal", "ja", "zh"), (None, "en", "zh"), ("default", "ja", "ja-JP"), ("", "ja", "EN")), more=derived.STYLES)


@query("flt19_source_style", f"SELECT style, language, target, coalesce(style, '') IN ('', 'default') AND language = 'ja' AND NOT starts_with(lower(target), 'ja') AS switched FROM {STYLES.sql()} s")
def flt19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STYLES.df(spark, sf_dir).withColumn("switched", F.coalesce("style", F.lit("")).isin("", "default") & (F.col("language") == "ja") & ~F.lower("target").startswith("ja"))


HOSTS = Literal("rule_id long, host string, path string", ((1, "*.example.com", "^/p"), (2, "example.com", None), (3, "*.example.com", None), (4, "other.org", None), (5, "*", "never")))


@query(
    "flt08_site_rules",
    f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages),
r AS (SELECT CASE WHEN rule_id = 1 THEN '*.' ELSE '' END || domain AS pattern, rule_id, path_re FROM (SELECT DISTINCT regexp_replace(host, '^www\\.', '') AS domain FROM u) d, (VALUES (1, '[02468]'), (2, CAST(NULL AS VARCHAR))) v(rule_id, path_re))
SELECT page_id, min(rule_id) AS rule_id FROM u JOIN r ON (u.host = r.pattern OR (starts_with(r.pattern, '*.') AND ends_with(u.host, r.pattern[2:])) OR u.host = regexp_replace(r.pattern, '^\\*\\.', '')) AND (path_re IS NULL OR regexp_matches(u.path, path_re)) GROUP BY page_id""",
)
def flt08(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    rules_ = u.select(F.regexp_replace("host", r"^www\.", "").alias("domain")).distinct().withColumn("rule", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("rule_id"), F.lit("[02468]").alias("path_re")), F.struct(F.lit(2).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("path_re")))))
    # a host and its parent domains are the only names that a rule can match: equi join, no theta join
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = u.withColumn("domain", F.explode(names)).join(rules_.select("domain", "rule.*"), "domain")
    fits = (F.col("domain") == F.col("host")) | (F.col("rule_id") == 1)
    return found.where(fits & (F.col("path_re").isNull() | F.expr("path rlike path_re"))).groupBy("page_id").agg(F.min("rule_id").alias("rule_id"))


MARKED = Literal(
    "page_id long, html string, expected long",
    tuple(
        (i, h, e)
        for i, (h, e) in enumerate([
            ("<html>" + "x" * 120 + "</html>", None), ("<!doctype html>" + '<span class="bi-translation">text</span><span class="bi-original">o</span>' * 4, 4), ("<!doctype html>" + '<span class="bi-translation"></span>' * 6, None),
            ("short", None), ("<p>" + "y" * 200, None), ("<html>" + '<span class="a bi-inline-translation b">t</span>' * 3 + "z" * 50, 10),
        ])
    ),
)


@query(
    "flt07_complete_pages",
    f"""WITH c AS (SELECT page_id, html, expected, {n_of("html", "bi-(?:inline-)?translation")} AS t, {n_of("html", "bi-(?:inline-)?original")} AS o, regexp_extract_all(html, 'class="[^"]*bi-(?:inline-)?translation[^"]*"[^>]*>([^<]*)<', 1) AS spans FROM {MARKED.sql()} m),
d AS (SELECT *, len(spans) AS total, len(list_filter(spans, lambda x: trim(x) <> '')) AS filled FROM c)
SELECT page_id, greatest(t, o) AS blocks, CASE WHEN length(html) < 100 THEN 'short' WHEN NOT regexp_matches(html, '(?i)<!doctype html|<html') THEN 'root' WHEN t + o = 0 THEN 'markers' WHEN expected > 0 AND t < floor(expected * 0.9) THEN 'incomplete' WHEN total > 0 AND filled / total < 0.5 THEN 'empty' ELSE 'healthy' END AS verdict FROM d""",
)
def flt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    t, o = T.count_of(h, "bi-(?:inline-)?translation"), T.count_of(h, "bi-(?:inline-)?original")
    spans = F.regexp_extract_all(h, F.lit('class="[^"]*bi-(?:inline-)?translation[^"]*"[^>]*>([^<]*)<'), F.lit(1))
    c = MARKED.df(spark, sf_dir).withColumns({"t": t, "o": o, "total": F.size(spans), "filled": F.size(F.filter(spans, lambda x: F.btrim(x) != ""))})
    verdict = (
        F.when(F.char_length(h) < 100, "short").when(~h.rlike("(?i)<!doctype html|<html"), "root").when(F.col("t") + F.col("o") == 0, "markers")
        .when((F.col("expected") > 0) & (F.col("t") < F.floor(F.col("expected") * 0.9)), "incomplete").when((F.col("total") > 0) & (F.col("filled") < 0.5 * F.col("total")), "empty").otherwise("healthy")
    )
    return c.select("page_id", F.greatest("t", "o").alias("blocks"), verdict.alias("verdict"))


@query(
    "flt06_healthy_pages",
    """SELECT page_id, regexp_matches(html, '(?i)<!doctype html|<html') AS has_root, regexp_matches(html, '(?i)<link[^>]*rel\\s*=\\s*["'']stylesheet["'']') OR regexp_matches(html, '(?is)<style[^>]*>') AS has_style,
regexp_matches(html, '(?is)<head[^>]*>.*<link[^>]*rel\\s*=\\s*["'']stylesheet["''][^>]*href\\s*=\\s*["'']/.*<base') AS base_late FROM pages""",
)
def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        h.rlike("(?i)<!doctype html|<html").alias("has_root"),
        (h.rlike(r"""(?i)<link[^>]*rel\s*=\s*["']stylesheet["']""") | h.rlike("(?is)<style[^>]*>")).alias("has_style"),
        h.rlike(r"""(?is)<head[^>]*>.*<link[^>]*rel\s*=\s*["']stylesheet["'][^>]*href\s*=\s*["']/.*<base""").alias("base_late"),
    )
