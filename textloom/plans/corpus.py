"""Queries over corpus features: names, passages, glossary, graph, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import rules, text as T
from textloom.operators import book, graph, ledger, passages
from textloom.plans import derived
from textloom.plans.base import Literal, query, table
from textloom.plans.scalars import CONTAINS, PAD, matches, n_of, strip_sql

DIALOGUE = f"({n_of('text', '[“”「」『』' + chr(34) + ']')} >= 2 OR {matches('text', rules.DASH_RE)} OR {matches('text', rules.SPEECH_RE)})"
Q = chr(39)


def q(pattern: str) -> str:
    return pattern.replace(Q, Q + Q)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment"), F.col("source").alias("chapter"), "text")


SEG = "(SELECT doc_id AS segment, source AS chapter, text FROM documents)"
NAME_ROWS = f"""(SELECT segment, chapter, dialogue, name FROM (SELECT segment, chapter, {DIALOGUE} AS dialogue, unnest(list_distinct(list_filter(regexp_extract_all(text, '{q(book.TOKEN)}'), lambda t: regexp_full_match(t, '{q(book.NAME)}')))) AS name FROM {SEG})
WHERE lower(name) NOT IN ({", ".join(Q + w + Q for w in book.NAME_STOPS)}))"""


@query("gen01_name_mentions", f"SELECT segment, chapter, dialogue, name FROM {NAME_ROWS}")
def gen01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.name_mentions(segments(spark, sf_dir))


@query("gen01_compound_names", f"SELECT segment, name, count(*) AS n FROM (SELECT segment, unnest(regexp_extract_all(text, '{book.COMPOUND}')) AS name FROM {SEG}) GROUP BY 1, 2")
def gen01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments(spark, sf_dir).select("segment", F.explode(F.regexp_extract_all("text", F.lit(book.COMPOUND), F.lit(0))).alias("name"))
    return found.groupBy("segment", "name").agg(F.count(F.lit(1)).alias("n"))


SENTENCES = f"""(SELECT segment, chapter, position, {strip_sql("s")} AS sentence, trim(regexp_replace(lower({strip_sql("s")}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS words FROM (SELECT segment, chapter, generate_subscripts(ss, 1) - 1 AS position, unnest(ss) AS s FROM (SELECT segment, chapter, regexp_extract_all(text, '[^.!?。！？\\n]+[.!?。！？]?') AS ss FROM {SEG})) WHERE length(trim(regexp_replace(lower({strip_sql("s")}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) >= 3)"""


@query("gen02_sentence_units", f"SELECT segment, count(*) AS sentences, sum(length(sentence)) AS n_chars, md5(string_agg(words, '|' ORDER BY position)) AS words_md5 FROM {SENTENCES} GROUP BY segment")
def gen02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book.sentences(segments(spark, sf_dir))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "words"))), lambda x: x["words"]), "|")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.char_length("sentence")).alias("n_chars"), F.md5(ordered.cast("binary")).alias("words_md5"))


@query("gen03_dialogue_index", f"SELECT segment, least(10, {n_of('text', '[“”「」『』' + chr(34) + ']')}) + CASE WHEN {matches('text', rules.SPEECH_RE)} THEN 2 ELSE 0 END + CASE WHEN {matches('text', rules.DASH_RE)} THEN 2 ELSE 0 END AS score FROM {SEG}")
def gen03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("segment", rules.dialogue_score(F.col("text")).alias("score"))


AMOUNTS = Literal(
    "line_id long, text string",
    ((1, "He walked 12 miles and 3 hours."), (2, "two feet, ten pounds"), (3, "跑了三公里，用了20分钟"), (4, "no amounts"), (5, "1,500 kilometers in 2.5 days; 7 degrees"), (6, "房间宽五米，重10公斤")),
    more=derived.AMOUNTS,
)
UNITS = Literal(
    "word string, unit string, family string",
    (
        ("inch", "inch", "length"), ("inches", "inch", "length"), ("foot", "foot", "length"), ("feet", "foot", "length"), ("mile", "mile", "length"), ("miles", "mile", "length"), ("kilometers", "kilometer", "length"),
        ("meters", "meter", "length"), ("hours", "hour", "time"), ("minutes", "minute", "time"), ("days", "day", "time"), ("pounds", "pound", "weight"), ("degrees", "degree", "angle"),
        ("公里", "kilometer", "length"), ("米", "meter", "length"), ("分钟", "minute", "time"), ("公斤", "kilogram", "weight"),
    ),
)
AMOUNT_RE = r"(?:[0-9]+(?:[,.][0-9]+)*|one|two|three|four|five|six|seven|eight|nine|ten|[零〇一二两三四五六七八九十百千万亿]+)[ -]?(inches|inch|feet|foot|miles|mile|kilometers|meters|hours|minutes|days|pounds|degrees|公里|分钟|公斤|米)"


@query("gen04_quantities", f"SELECT line_id, m.surface, u.unit, u.family FROM (SELECT line_id, unnest(regexp_extract_all(text, '{AMOUNT_RE}')) AS surface, unnest(regexp_extract_all(text, '{AMOUNT_RE}', 1)) AS word FROM {AMOUNTS.sql()} a) m JOIN {UNITS.sql()} u ON u.word = m.word")
def gen04(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(AMOUNT_RE), F.lit(0)).alias("surface"), F.regexp_extract_all("text", F.lit(AMOUNT_RE), F.lit(1)).alias("word"))
    found = AMOUNTS.df(spark, sf_dir).select("line_id", F.inline(F.transform(pairs, lambda p: F.struct(p["surface"].alias("surface"), p["word"].alias("word")))))
    return found.join(F.broadcast(UNITS.df(spark, sf_dir)), "word").select("line_id", "surface", "unit", "family")  # a fixed unit list


@query("agg01_chapters", f"""WITH r AS (SELECT *, {DIALOGUE} AS d, row_number() OVER (PARTITION BY chapter ORDER BY segment) AS i, count(*) OVER (PARTITION BY chapter) AS k FROM {SEG}) SELECT chapter, count(*) AS segments, sum(length(text)) AS n_chars, count(*) FILTER (WHERE d) AS dialogues, min(segment) AS first, max(CASE WHEN i = (k - 1) // 2 + 1 THEN segment END) AS middle, max(segment) AS last FROM r GROUP BY chapter""")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.chapters(segments(spark, sf_dir))


@query(
    "agg02_name_candidates",
    f"""WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents), m AS (SELECT n.*, (segment - lo) / greatest(1, hi - lo) AS p FROM {NAME_ROWS} n, b),
c AS (SELECT name, count(*) AS mentions, count(DISTINCT chapter) AS chapters, count(*) FILTER (WHERE dialogue) AS dialogues, count(DISTINCT CASE WHEN p < 1/3 THEN 0 WHEN p > 2/3 THEN 2 ELSE 1 END) AS regions FROM m GROUP BY name)
SELECT *, floor((log2(mentions + 1) + chapters * 1.8 + dialogues * 1.4 + regions * 2.5) * 100 + 0.5) / 100 AS score FROM c WHERE mentions >= 2 OR dialogues > 0 ORDER BY score DESC, mentions DESC, name LIMIT 160""",
)
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    ends = s.agg(F.min("segment").alias("lo"), F.max("segment").alias("hi"))
    mentions = book.name_mentions(s).join(F.broadcast(ends))  # a single row
    return book.name_scores(mentions, F.col("lo"), F.col("hi")).orderBy(F.col("score").desc(), F.col("mentions").desc(), "name").limit(160)


@query(
    "win04_representatives",
    f"""WITH b AS (SELECT min(doc_id) AS lo, greatest(1, max(doc_id) - min(doc_id)) AS span FROM documents), m AS (SELECT n.*, lo, span, (segment - lo) / span AS p FROM {NAME_ROWS} n, b WHERE name IN (SELECT name FROM {NAME_ROWS} GROUP BY name HAVING count(*) BETWEEN 2 AND 60)),
t AS (SELECT * FROM m, (VALUES ('early', 0.12), ('middle', 0.5), ('late', 0.88)) v(region, target)),
r AS (SELECT name, region, segment, row_number() OVER (PARTITION BY name, region ORDER BY CASE WHEN (region = 'early' AND p < 1/3) OR (region = 'late' AND p > 2/3) OR (region = 'middle' AND p BETWEEN 1/3 AND 2/3) THEN 0 ELSE 1 END, CASE WHEN dialogue THEN 0 ELSE 1 END, abs(segment - (lo + span * target)), segment) AS n FROM t)
SELECT name, region, segment FROM r WHERE n = 1""",
)
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    ends = s.agg(F.min("segment").alias("lo"), F.greatest(F.lit(1), F.max("segment") - F.min("segment")).alias("span"))
    m = book.name_mentions(s)
    used = m.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k BETWEEN 2 AND 60").select("name")
    p = (F.col("segment") - F.col("lo")) / F.col("span")
    targets = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(t).alias("target")) for r, t in (("early", 0.12), ("middle", 0.5), ("late", 0.88))])
    t = m.join(used, "name").join(F.broadcast(ends)).withColumn("p", p).withColumn("t", F.explode(targets))
    region = F.col("t.region")
    inside = ((region == "early") & (F.col("p") < 1 / 3)) | ((region == "late") & (F.col("p") > 2 / 3)) | ((region == "middle") & F.col("p").between(1 / 3, 2 / 3))
    order = F.struct(F.when(inside, 0).otherwise(1).alias("a"), F.when(F.col("dialogue"), 0).otherwise(1).alias("b"), F.abs(F.col("segment") - (F.col("lo") + F.col("span") * F.col("t.target"))).alias("c"), F.col("segment").alias("s"))
    return t.groupBy("name", region.alias("region")).agg(F.min_by("segment", order).alias("segment"))


REPEATED = f"""WITH u AS (SELECT DISTINCT words, segment, chapter FROM {SENTENCES} WHERE length(words) >= 12 AND len(string_split(words, ' ')) >= 3),
c AS (SELECT words, count(*) AS n, count(DISTINCT chapter) AS chapters, min(segment) AS first, max(segment) AS last, array_to_string(list_sort(list(segment))[1:16], ',') AS segments FROM u GROUP BY words HAVING count(*) > 1)
SELECT * FROM c ORDER BY n DESC, chapters DESC, words LIMIT """


@query("agg03_repeated_passages", REPEATED + "80")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.repeated_passages(segments(spark, sf_dir))


@query("agg04_repeated_index", REPEATED + "300")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.repeated_passages(segments(spark, sf_dir), 300)


ACRONYM = "[A-Z][A-Z0-9]+"
NOT_ACRONYMS = ["OK", "AM", "PM", "TV", "US"]


@query("agg05_acronyms", f"SELECT segment, word, count(*) AS n FROM (SELECT segment, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: regexp_full_match(t, '{ACRONYM}'))) AS word FROM {SEG}) WHERE word NOT IN ('OK', 'AM', 'PM', 'TV', 'US') GROUP BY 1, 2 HAVING NOT regexp_full_match(word, '[A-Z]{{5,}}') OR count(*) >= 2")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: t.rlike(f"^{ACRONYM}$"))
    by = segments(spark, sf_dir).select("segment", F.explode(words).alias("word")).where(~F.col("word").isin(*NOT_ACRONYMS)).groupBy("segment", "word").agg(F.count(F.lit(1)).alias("n"))
    return by.where(~F.col("word").rlike("^[A-Z]{5,}$") | (F.col("n") >= 2))


@query("agg06_frequent_terms", f"WITH w AS (SELECT chapter, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ')) AS word FROM {SEG}) SELECT chapter, regexp_replace(word, 's$', '') AS term, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY 1, 2 HAVING count(*) >= 3")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = segments(spark, sf_dir).select("chapter", F.explode(F.split(T.bare_words(F.col("text")), " ")).alias("word")).where(F.char_length("word") >= 6)
    return w.groupBy("chapter", F.regexp_replace("word", "s$", "").alias("term")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


SCORE = "CASE WHEN regexp_full_match(term, '[A-Z]{2,6}') THEN 1000 + length(term) * 10 WHEN regexp_matches(term, '[A-Z]') THEN 500 + length(term) * 10 ELSE n + length(term) END"


@query(
    "agg07_local_glossary",
    f"""WITH a AS (SELECT segment, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: regexp_full_match(t, '[A-Z]{{2,6}}'))) AS term FROM {SEG} UNION ALL SELECT segment, unnest(regexp_extract_all(text, '{book.COMPOUND}')) FROM {SEG}),
c AS (SELECT segment, min(term) AS term, count(*) AS n FROM a GROUP BY segment, lower(term)) SELECT segment, term, n, {SCORE} AS score FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY {SCORE} DESC, term) <= 50""",
)
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    caps = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: t.rlike("^[A-Z]{2,6}$"))
    a = s.select("segment", F.explode(F.concat(caps, F.regexp_extract_all("text", F.lit(book.COMPOUND), F.lit(0)))).alias("t"))
    c = a.groupBy("segment", F.lower("t").alias("k")).agg(F.min("t").alias("term"), F.count(F.lit(1)).alias("n")).drop("k")
    return c.withColumn("score", term_score(F.col("term"), F.col("n"))).withColumn("r", F.row_number().over(W.partitionBy("segment").orderBy(F.col("score").desc(), "term"))).where("r <= 50").drop("r")


def term_score(term, n):
    size = F.char_length(term)
    return F.when(term.rlike("^[A-Z]{2,6}$"), 1000 + size * 10).when(term.rlike("[A-Z]"), 500 + size * 10).otherwise(n + size).cast("long")


SCORED = Literal("term string, n long", (("API", 1), ("HTTPS", 3), ("OpenSearch", 2), ("large model", 7), ("iPhone", 1), ("x", 1), ("TOOLONGX", 2)), more=derived.SCORED)


@query("top12_term_scores", f"SELECT term, {SCORE} AS score FROM {SCORED.sql()} s")
def top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SCORED.df(spark, sf_dir).select("term", term_score(F.col("term"), F.col("n")).alias("score"))


FULL_NAMES = Literal("name string", (("The King Rat",), ("Mr. Smith",), ("Dr Miss Lee",), ("And Then",), ("Al Bo",), ("Captain",), ("Anna",), ("The",), ("Lord Of",)), more=derived.FULL_NAMES)


@query(
    "flt10_allowed_names",
    f"""WITH w AS (SELECT name, string_split(name, ' ') AS ws FROM {FULL_NAMES.sql()} f), p AS (SELECT *, list_transform(ws, lambda x: lower(replace(x, '.', ''))) AS pl FROM w),
t AS (SELECT *, CASE WHEN len(pl) > 1 AND pl[1] IN ('the', 'a', 'an') THEN 1 ELSE least(len(pl) - 1, coalesce(list_position(list_transform(pl, lambda x: x IN ({", ".join(Q + t + Q for t in book.TITLES)})), false) - 1, len(pl))) END AS lead FROM p)
SELECT name, array_to_string(ws[lead + 1:], ' ') AS core, len(list_filter(pl[lead + 1:], lambda x: x IN ({", ".join(Q + w + Q for w in book.NAME_STOPS)}))) = 0 AND len(list_filter(ws[lead + 1:], lambda x: length(x) >= 3)) > 0 AS allowed FROM t""",
)
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FULL_NAMES.df(spark, sf_dir).select("name", book.name_core(F.col("name")).alias("core"), book.name_allowed(F.col("name")).alias("allowed"))


NOISE = Literal("term string, total long, at_start boolean", (("results", 4, False), ("Boost", 1, True), ("Boost", 2, True), ("Kubernetes", 1, True), ("data lake", 3, False), ("analyses", 9, False), ("superlongwords", 1, False)), more=derived.NOISE)


@query("flt14_noise_terms", f"SELECT term, total, NOT contains(term, ' ') AND regexp_full_match(term, '[a-z]+s') AND length(term) <= 10 AS generic, NOT contains(term, ' ') AND regexp_full_match(term, '[A-Z][a-z]+') AND term NOT IN ('Kubernetes') AND total <= 1 AND at_start AS misread FROM {NOISE.sql()} n")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("term")
    generic = ~t.contains(" ") & t.rlike("^[a-z]+s$") & (F.char_length(t) <= 10)
    misread = ~t.contains(" ") & t.rlike("^[A-Z][a-z]+$") & ~t.isin("Kubernetes") & (F.col("total") <= 1) & F.col("at_start")
    return NOISE.df(spark, sf_dir).select("term", "total", generic.alias("generic"), misread.alias("misread"))


@query("ext27_mid_sentence_names", f"SELECT word, count(*) AS n, count(DISTINCT segment) AS segments FROM (SELECT segment, unnest(regexp_extract_all(text, '[\\p{{Ll}},] (\\p{{Lu}}\\p{{Ll}}{{2,}})', 1)) AS word FROM {SEG}) GROUP BY word HAVING count(*) >= 2")
def ext27(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments(spark, sf_dir).select("segment", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{Ll},] (\p{Lu}\p{Ll}{2,})"), F.lit(1))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment").alias("segments")).where("n >= 2")


COMPATIBLE = Literal("source string, alias string", (("Anna Karenina", "Anna"), ("The Duke", "duke"), ("Robert Smith", "Bob"), ("王小明", "小明"), ("Jon Snow", "Jonathan"), ("Anna's", "Ann"), ("Mary", "the lady")), more=derived.COMPATIBLE)
IDENTITY = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: t NOT IN ('the', 'a', 'an', 'of', 's', 'lady', 'sir', 'lord', 'mr', 'mrs'))"


@query("ext01_alias_compatibility", f"SELECT source, alias, CASE WHEN NOT regexp_full_match(source, '(?i)[a-z0-9 ._''’-]+') OR NOT regexp_full_match(alias, '(?i)[a-z0-9 ._''’-]+') THEN true WHEN len({IDENTITY.format('alias')}) = 0 THEN false ELSE len(list_filter({IDENTITY.format('source')}, lambda x: len(list_filter({IDENTITY.format('alias')}, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) > 0 END AS compatible FROM {COMPATIBLE.sql()} c")
def ext01(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = ["the", "a", "an", "of", "s", "lady", "sir", "lord", "mr", "mrs"]
    tokens = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*stops))
    latin = lambda c: F.col(c).rlike("(?i)^[a-z0-9 ._'’-]+$")
    shared = F.exists(tokens("source"), lambda x: F.exists(tokens("alias"), lambda y: x.startswith(y) | y.startswith(x)))
    fits = F.when(~latin("source") | ~latin("alias"), True).when(F.size(tokens("alias")) == 0, False).otherwise(shared)
    return COMPATIBLE.df(spark, sf_dir).withColumn("compatible", fits)


ENTITIES = Literal(
    "node string, names array<string>, target string, status string",
    (
        ("e1", ["Anna", "Annie"], "安娜", "confirmed"), ("e2", ["annie", "A. K."], "安妮", "candidate"), ("e3", ["Bob"], "鲍勃", "confirmed"), ("e4", ["Robert", "bob"], "鲍勃", "confirmed"),
        ("e5", ["King Rat"], "鼠王", "confirmed"), ("e6", ["a. k.", "Karenina"], None, "candidate"), ("e7", ["King Rat"], "老鼠王", "confirmed"),
    ),
    more=derived.ENTITIES,
)


@query(
    "gra01_alias_components",
    f"""WITH RECURSIVE n AS (SELECT node, lower(trim(unnest(names))) AS name FROM {ENTITIES.sql()} e), edges AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b ON a.name = b.name),
r AS (SELECT DISTINCT x AS node, x AS root FROM edges UNION SELECT e.y, r.root FROM r JOIN edges e ON e.x = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""",
)
def gra01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_name_components(ENTITIES.df(spark, sf_dir))


@query("gra04_guarded_updates", f"WITH o AS (SELECT node AS key, status, target AS value FROM {ENTITIES.sql()} e WHERE node < 'e6'), n AS (SELECT 'e' || i AS key, 'auto' AS status, 'new' || i AS value FROM range(2, 9) t(i)) SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.status IN ('confirmed', 'rejected') OR n.status IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN o.status IN ('confirmed', 'rejected') OR n.status IS NULL THEN o.value ELSE n.value END AS value FROM o FULL JOIN n ON o.key = n.key")
def gra04(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = ENTITIES.df(spark, sf_dir).where("node < 'e6'").select(F.col("node").alias("key"), "status", F.col("target").alias("value"))
    new = spark.range(2, 9).select(F.concat(F.lit("e"), "id").alias("key"), F.lit("auto").alias("status"), F.concat(F.lit("new"), "id").alias("value"))
    held = F.coalesce(F.col("s").isin("confirmed", "rejected"), F.lit(False))
    o, n = old.select("key", F.col("status").alias("s"), F.col("value").alias("v")), new
    return o.join(n, "key", "full").select("key", F.when(held | F.col("status").isNull(), F.col("s")).otherwise(F.col("status")).alias("status"), F.when(held | F.col("status").isNull(), F.col("v")).otherwise(F.col("value")).alias("value"))


EVIDENCE = Literal("fact long, item_id long, quote string", ((1, 0, None), (1, 1, None), (2, 5, "zzz not there"), (3, 99, "missing sample"), (4, 3, "ab"), (5, 7, None)), more=derived.EVIDENCE)


@query(
    "gra05_evidence_validation",
    f"""WITH e AS (SELECT v.fact, v.item_id, coalesce(v.quote, left(b.text, 20)) AS quote, b.text FROM {EVIDENCE.sql()} v LEFT JOIN benchmark b ON b.item_id = v.item_id),
j AS (SELECT fact, CASE WHEN text IS NULL THEN 'no-sample' WHEN length(trim(quote)) < 4 THEN 'short' WHEN NOT contains(lower(text), lower(quote)) THEN 'not-grounded' ELSE 'valid' END AS verdict FROM e) SELECT fact, verdict, count(*) AS n FROM j GROUP BY 1, 2""",
)
def gra05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = EVIDENCE.df(spark, sf_dir).join(table(spark, sf_dir, "benchmark"), "item_id", "left").withColumn("quote", F.coalesce("quote", F.substring("text", 1, 20)))
    verdict = F.when(F.col("text").isNull(), "no-sample").when(F.char_length(F.btrim("quote")) < 4, "short").when(~F.lower("text").contains(F.lower("quote")), "not-grounded").otherwise("valid")
    return e.groupBy("fact", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "gra12_term_protections",
    f"""WITH t AS (SELECT unnest(names) AS name, target, CASE status WHEN 'confirmed' THEN 2 ELSE 1 END AS priority FROM {ENTITIES.sql()} e WHERE target IS NOT NULL), r AS (SELECT lower(name) AS name, target, priority, max(priority) OVER (PARTITION BY lower(name)) AS top FROM t)
SELECT name, min(target) AS target, length(name) AS n FROM r WHERE priority = top GROUP BY name HAVING count(DISTINCT target) = 1""",
)
def gra12(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = ENTITIES.df(spark, sf_dir).where("target IS NOT NULL").select(F.explode("names").alias("name"), "target", F.when(F.col("status") == "confirmed", 2).otherwise(1).alias("priority")).withColumn("name", F.lower("name"))
    top = exploded.withColumn("top", F.max("priority").over(W.partitionBy("name"))).where("priority = top")
    return top.groupBy("name").agg(F.min("target").alias("target"), F.count_distinct("target").alias("k")).where("k = 1").select("name", "target", F.char_length("name").cast("long").alias("n"))


@query("gra13_disposition", "SELECT source, doc_id, CASE WHEN n_chars < 200 THEN 'no-evidence' WHEN count(*) FILTER (WHERE n_chars >= 200) OVER (PARTITION BY source ORDER BY doc_id) > 10 THEN 'limit' ELSE 'persist' END AS disposition FROM documents")
def gra13(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.col("n_chars") >= 200
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    persisted = ledger.ranked(d.where(fine), ["source"], ["doc_id"]).select("source", "doc_id", F.when(F.col("rank") > 10, "limit").otherwise("persist").alias("disposition"))
    return persisted.unionByName(d.where(~fine).select("source", "doc_id", F.lit("no-evidence").alias("disposition")))


@query("gra10_graph_read", "WITH n AS (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 500) SELECT n.p_partkey, n.p_name, count(l.l_orderkey) AS evidence, min(l.l_orderkey) AS first_seen FROM n LEFT JOIN lineitem l ON l.l_partkey = n.p_partkey GROUP BY ALL")
def gra10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(500)
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("evidence"), F.min("l_orderkey").alias("first_seen"))
    return n.join(seen, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("evidence", F.lit(0)).alias("evidence"), "first_seen")


BOOK = Literal(
    "segment string, ordinal long, text string, translation string",
    (
        ("s1", 1, "Anna met the King Rat at 12 miles.", "安娜在12英里处遇见了鼠王。"), ("s2", 2, "Annie waited three days.", "安妮等了三天。"), ("s3", 3, "Bob said nothing again.", "鲍勃什么也没说 again"), ("s4", 4, "It was 5 hours later.", "那是6小时以后。"),
        ("s5", 5, "The end of the story.", None), ("s6", 6, "King Rat, and so on and on.", "the rest of the story stays 英文"), ("s7", 7, "Two lines the same here.", "两行相同。"), ("s8", 8, "Two lines the same here.", "两行一样。"), ("s9", 9, "Robert left.", "  "),
    ),
    more=derived.BOOK,
)


@query("aud01_missing", f"SELECT segment, 'missing-translation' AS type, 'must-fix' AS severity FROM {BOOK.sql()} b WHERE translation IS NULL OR trim(translation) = ''")
def aud01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BOOK.df(spark, sf_dir).where(F.col("translation").isNull() | (F.btrim("translation") == "")).select("segment", F.lit("missing-translation").alias("type"), F.lit("must-fix").alias("severity"))


NUMS = "array_to_string(list_transform(regexp_extract_all({0}, '[0-9]+(?:[,.][0-9]+)*'), lambda x: replace(x, ',', '')), ',')"


@query("aud02_numeric_mismatch", f"SELECT segment, {NUMS.format('text')} AS source_numbers, {NUMS.format('translation')} AS target_numbers FROM {BOOK.sql()} b WHERE trim(translation) <> '' AND {NUMS.format('text')} <> {NUMS.format('translation')}")
def aud02(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+(?:[,.][0-9]+)*"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))), ",")
    rows = BOOK.df(spark, sf_dir).where(F.btrim("translation") != "").select("segment", numbers("text").alias("source_numbers"), numbers("translation").alias("target_numbers"))
    return rows.where("source_numbers != target_numbers")


# fixed values: English words that a Chinese translation should not keep
RESIDUE = (
    "again although already anyway because before behind between beyond could during ever however indeed instead later maybe might must "
    "never nothing perhaps rather really should since still though through until unless whether while would"
).split()


@query("aud03_english_residue", f"""WITH w AS (SELECT segment, regexp_extract_all(translation, '[A-Za-z][A-Za-z''-]*(?: [A-Za-z][A-Za-z''-]*){{2,}}') AS phrases, list_filter(regexp_extract_all(translation, '[A-Za-z][A-Za-z''-]*'), lambda x: lower(x) IN ({", ".join(Q + w + Q for w in RESIDUE)})) AS words FROM {BOOK.sql()} b WHERE trim(translation) <> '')
SELECT segment, array_to_string(list_concat(list_filter(phrases, lambda p: len(string_split(p, ' ')) >= 4), words), '|') AS examples FROM w WHERE len(words) > 0 OR len(list_filter(phrases, lambda p: len(string_split(p, ' ')) >= 4)) > 0""")
def aud03(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without backtracking, which would overflow the stack on a long text
    phrases = F.filter(F.regexp_extract_all("translation", F.lit("[A-Za-z][A-Za-z'-]*+(?: [A-Za-z][A-Za-z'-]*+){2,}+"), F.lit(0)), lambda p: F.size(F.split(p, " ")) >= 4)
    words = F.filter(F.regexp_extract_all("translation", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0)), lambda w: F.lower(w).isin(*RESIDUE))
    return BOOK.df(spark, sf_dir).where(F.btrim("translation") != "").select("segment", F.concat(phrases, words).alias("e")).where(F.size("e") > 0).select("segment", F.array_join("e", "|").alias("examples"))


MAPPINGS = f"(SELECT lower(unnest(names)) AS name, node, target FROM {ENTITIES.sql()} e WHERE status = 'confirmed')"


@query(
    "aud04_terminology_drift",
    f"""WITH m AS {MAPPINGS}, bad AS (SELECT name FROM m GROUP BY name HAVING count(DISTINCT target) > 1), s AS (SELECT b.segment, b.translation, m.node, m.name, m.target FROM {BOOK.sql()} b JOIN m ON contains({PAD.format("b.text")}, {PAD.format("m.name")}) WHERE trim(b.translation) <> '' AND m.name NOT IN (SELECT name FROM bad))
SELECT segment, name, target FROM s WHERE NOT contains(translation, target)""",
)
def aud04(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ENTITIES.df(spark, sf_dir).where("status = 'confirmed'").select(F.explode("names").alias("name"), "node", "target").withColumn("name", F.lower("name"))
    clear = m.withColumn("k", F.size(F.collect_set("target").over(W.partitionBy("name")))).where("k = 1").select("name", "target")
    rows = BOOK.df(spark, sf_dir).where(F.btrim("translation") != "").select("segment", "text", "translation")
    return graph.mentions(rows, "text", clear, "name").where(~F.col("translation").contains(F.col("target"))).select("segment", "name", "target")


@query("jon10_mapping_conflicts", f"WITH m AS {MAPPINGS}, c AS (SELECT name, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM m GROUP BY name HAVING count(DISTINCT target) > 1) SELECT c.name, c.targets, count(*) AS segments FROM c JOIN {BOOK.sql()} b ON contains({PAD.format('b.text')}, {PAD.format('c.name')}) GROUP BY 1, 2")
def jon10(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ENTITIES.df(spark, sf_dir).where("status = 'confirmed'").select(F.explode("names").alias("name"), "target").withColumn("name", F.lower("name"))
    c = m.groupBy("name").agg(F.sort_array(F.collect_set("target")).alias("t")).where(F.size("t") > 1).select("name", F.array_join("t", "|").alias("targets"))
    hit = graph.mentions(BOOK.df(spark, sf_dir).select("text"), "text", c, "name")
    return hit.groupBy("name", "targets").agg(F.count(F.lit(1)).alias("segments"))


@query("aud05_repeated_drift", f"SELECT lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS words, count(*) AS n, count(DISTINCT trim(translation)) AS variants FROM {BOOK.sql()} b WHERE trim(translation) <> '' GROUP BY 1 HAVING count(*) > 1")
def aud05(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.lower(F.btrim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")))
    return BOOK.df(spark, sf_dir).where(F.btrim("translation") != "").groupBy(words.alias("words")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.btrim("translation")).alias("variants")).where("n > 1")


@query(
    "aud06_component_targets",
    f"""WITH RECURSIVE n AS (SELECT node, lower(trim(unnest(names))) AS name FROM {ENTITIES.sql()} e), edges AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b ON a.name = b.name), r AS (SELECT DISTINCT x AS node, x AS root FROM edges UNION SELECT e.y, r.root FROM r JOIN edges e ON e.x = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT component, count(*) AS entities, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM c JOIN {ENTITIES.sql()} e USING (node) GROUP BY component HAVING count(DISTINCT target) > 1""",
)
def aud06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.shared_name_components(ENTITIES.df(spark, sf_dir))
    by = c.join(ENTITIES.df(spark, sf_dir).select("node", "target"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("entities"), F.sort_array(F.collect_set("target")).alias("t"))
    return by.where(F.size("t") > 1).select("component", "entities", F.array_join("t", "|").alias("targets"))


@query("aud10_unchanged_blocks", "WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN text WHEN doc_id % 11 = 0 THEN NULL ELSE reverse(text) END AS answer FROM documents) SELECT count(*) FILTER (WHERE answer = text) AS unchanged, count(*) FILTER (WHERE answer IS NULL) AS missing, count(*) AS n FROM b")
def aud10(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 9 == 0, F.col("text")).when(F.col("doc_id") % 11 != 0, F.reverse("text"))
    return table(spark, sf_dir, "documents").select("text", answer.alias("answer")).agg(F.count_if(F.col("answer") == F.col("text")).alias("unchanged"), F.count_if(F.col("answer").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))


@query("aud09_metric_deltas", "WITH a AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT a.lang, b.n - a.n AS n_delta, round(b.mean - a.mean, 2) AS mean_delta FROM a JOIN b ON a.lang = b.lang")
def aud09(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd, n = F.col("doc_id") % 2 == 1, F.lit(1)
    m = lambda test: F.avg(F.when(test, F.col("n_chars")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg((F.count_if(odd) - F.count_if(~odd)).alias("n_delta"), F.round(m(odd) - m(~odd), 2).alias("mean_delta"))


@query(
    "agg11_finding_totals",
    "SELECT type, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN regexp_matches(text, '[A-Z]{8,}') THEN 'shouting' WHEN contains(text, '@') THEN 'mail' END AS type FROM documents) WHERE type IS NOT NULL GROUP BY type",
)
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_chars") < 100, "short").when(F.col("text").rlike("[A-Z]{8,}"), "shouting").when(F.col("text").contains("@"), "mail")
    return table(spark, sf_dir, "documents").select(kind.alias("type")).where("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("jon08_first_occurrence", "SELECT b.item_id, min(d.doc_id) AS first_doc, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.holding(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    return found.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"))


@query(
    "flagship_repeated_passages",
    f"""WITH u AS (SELECT DISTINCT words, segment FROM {SENTENCES} WHERE length(words) >= 12 AND len(string_split(words, ' ')) >= 3), c AS (SELECT words FROM u GROUP BY words HAVING count(*) > 1), r AS (SELECT segment, count(*) AS repeated FROM u JOIN c USING (words) GROUP BY segment)
SELECT d.doc_id, d.source, coalesce(r.repeated, 0) AS repeated, CAST(ceil({n_of("d.text", T.WIDE)} * 0.5 + (length(d.text) - {n_of("d.text", T.WIDE)}) * 0.25) AS BIGINT) AS tokens, l.quality, l.toxic FROM documents d LEFT JOIN r ON r.segment = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with how many of their passages stand elsewhere too, their token estimate and their labels."""
    units = book.sentences(segments(spark, sf_dir)).where((F.char_length("words") >= 12) & (F.size(F.split("words", " ")) >= 3))
    keyed = units.select(F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("passage"), F.col("words")).alias("k2"), "segment").distinct()
    frequent = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = keyed.join(frequent, ["k1", "k2"]).groupBy(F.col("segment").alias("doc_id")).agg(F.count(F.lit(1)).alias("repeated"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", T.estimate_tokens(F.col("text")).alias("tokens"))
    return d.join(repeated, "doc_id", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", F.coalesce("repeated", F.lit(0)).alias("repeated"), "tokens", "quality", "toxic")
