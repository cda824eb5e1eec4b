"""Briefs for batches of documents, a source being a book: its names are its memory, capitalised phrases their other names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import book, brief, ledger
from textloom.plans.base import query, table

BATCH, BUDGET = 8, 8


def stops(word: str) -> str:
    return f"lower({word}) NOT IN ({', '.join(chr(39) + w + chr(39) for w in book.NAME_STOPS)})"


def names_in(text: str) -> str:
    token, name = (p.replace("'", "''") for p in (book.TOKEN, book.NAME))
    return f"list_filter(regexp_extract_all({text}, '{token}'), lambda t: regexp_full_match(t, '{name}'))"


MEMORY = f"""WITH seg AS (SELECT doc_id AS ordinal, coalesce(source, '-') AS book, text, (row_number() OVER (PARTITION BY coalesce(source, '-') ORDER BY doc_id) - 1) // {BATCH} + 1 AS batch FROM documents),
ment AS (SELECT book, ordinal, batch, name, count(*) AS n FROM (SELECT book, ordinal, batch, unnest({names_in('text')}) AS name FROM seg) WHERE {stops('name')} GROUP BY ALL),
comp AS (SELECT DISTINCT book, ordinal, batch, alias FROM (SELECT book, ordinal, batch, unnest(regexp_extract_all(text, '{book.COMPOUND}')) AS alias FROM seg)),
facts AS (SELECT book, name, name IN (SELECT unnest({names_in('text')}) FROM benchmark) AS confirmed, min(batch) AS first FROM ment GROUP BY 1, 2 HAVING count(*) >= 2),
al AS (SELECT c.book, f.name, c.alias, c.batch, count(*) AS n FROM comp c JOIN facts f ON f.book = c.book AND f.name = split_part(c.alias, ' ', 1) GROUP BY ALL),
later AS (SELECT book, name, max(first) AS last_alias FROM (SELECT book, name, alias, min(batch) AS first FROM al GROUP BY 1, 2, 3) GROUP BY 1, 2),
proof AS (SELECT book, name, min(batch) AS proof FROM ment WHERE n >= 2 GROUP BY 1, 2),
b AS (SELECT book, batch, count(*) AS segments, min(ordinal) AS first, max(ordinal) AS last FROM seg GROUP BY 1, 2),
judged AS (SELECT b.book, b.batch, f.name, CASE WHEN NOT f.confirmed AND l.last_alias > b.batch THEN 'alias'
  WHEN NOT (f.first < b.batch OR f.confirmed AND (f.first = b.batch OR EXISTS (SELECT 1 FROM al WHERE al.book = b.book AND al.name = f.name AND al.batch = b.batch))) THEN 'name'
  WHEN NOT f.confirmed AND NOT coalesce(p.proof < b.batch, false) THEN 'evidence' ELSE 'visible' END AS state
  FROM b JOIN facts f ON f.book = b.book LEFT JOIN later l ON l.book = f.book AND l.name = f.name LEFT JOIN proof p ON p.book = f.book AND p.name = f.name),
counted AS (SELECT book, batch, count(*) FILTER (WHERE state = 'visible') AS visible, count(*) FILTER (WHERE state = 'alias') AS excluded_alias, count(*) FILTER (WHERE state = 'name') AS excluded_name, count(*) FILTER (WHERE state = 'evidence') AS excluded_evidence FROM judged GROUP BY 1, 2),
hits AS (SELECT book, batch, name, 4 * count(*) AS score, NULL AS alias FROM ment GROUP BY ALL UNION ALL SELECT book, batch, name, 2 * n, alias FROM al),
scored AS (SELECT h.book, h.batch, h.name, sum(h.score) AS score, h.name || coalesce(' (' || string_agg(h.alias, ', ' ORDER BY h.alias) || ')', '') AS entry FROM hits h JOIN judged j ON j.book = h.book AND j.batch = h.batch AND j.name = h.name AND j.state = 'visible' GROUP BY 1, 2, 3),
placed AS (SELECT *, CAST(ceil(length(entry) * 0.25) AS BIGINT) AS size, row_number() OVER w AS place, sum(CAST(ceil(length(entry) * 0.25) AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM scored WINDOW w AS (PARTITION BY book, batch ORDER BY score DESC, name)),
few AS (SELECT book, batch, count(*) AS matched, count(*) FILTER (WHERE total <= {BUDGET}) AS chosen, coalesce(sum(size) FILTER (WHERE total <= {BUDGET}), 0)::BIGINT AS tokens, coalesce(string_agg(entry, '; ' ORDER BY place) FILTER (WHERE total <= {BUDGET}), '') AS context FROM placed GROUP BY 1, 2)"""


@query(
    "gra09_batch_briefs",
    MEMORY + """ SELECT b.book, b.batch, b.segments, b.first, b.last, coalesce(visible, 0) AS visible, coalesce(excluded_alias, 0) AS excluded_alias, coalesce(excluded_name, 0) AS excluded_name, coalesce(excluded_evidence, 0) AS excluded_evidence,
coalesce(matched, 0) AS matched, coalesce(chosen, 0) AS chosen, coalesce(tokens, 0) AS tokens, coalesce(context, '') AS context FROM b LEFT JOIN counted c ON c.book = b.book AND c.batch = b.batch LEFT JOIN few ON few.book = b.book AND few.batch = b.batch""",
)
def gra09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two segments or more are facts, confirmed where the benchmark has them too; a segment that has one twice is evidence."""
    c = F.col
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("book"), c("doc_id").alias("ordinal"), book.name_tokens(c("text")).alias("names"), F.regexp_extract_all("text", F.lit(book.COMPOUND), F.lit(0)).alias("phrases"))
    seg = ledger.ranked(rows, ["book"], ["ordinal"]).withColumn("batch", F.floor((c("rank") - 1) / BATCH) + 1)
    used = seg.select("book", "ordinal", "batch", F.explode("names").alias("name")).where(~F.lower("name").isin(*book.NAME_STOPS))
    uses = used.groupBy("book", "ordinal", "batch", "name").agg(F.count(F.lit(1)).alias("n"))
    phrases = seg.select("book", "ordinal", "batch", F.explode("phrases").alias("name")).distinct()
    sure = table(spark, sf_dir, "benchmark").select(F.explode(book.name_tokens(c("text"))).alias("name")).distinct().withColumn("confirmed", F.lit(True))
    facts = uses.groupBy("book", "name").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").join(sure, "name", "left").select("book", "name", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    other = phrases.select("book", F.element_at(F.split("name", " "), 1).alias("first"), c("name").alias("alias")).distinct()
    aliases = other.join(facts.select("book", c("name").alias("first")), ["book", "first"]).select("book", c("first").alias("name"), "alias")
    evidence = uses.where("n >= 2").select("book", "name", "batch")
    return brief.briefs(seg.select("book", "batch", "ordinal"), uses.drop("n").unionByName(phrases.select("book", "ordinal", "batch", "name")), facts, aliases, evidence, BUDGET)
