"""Secret scanning with corpus-wide ownership frequency, in SQL functions only.

Base spans, leftmost and non-overlapping per kind, at code point offsets (end
exclusive): ``assign`` (a key word, a separator and a value of at least 6 characters),
``access`` (an access key of at least 20) and ``hex`` (a run of at least 24).

The method looks at candidate values across the corpus: the values of base spans, and
opaque tokens of at least 20 characters that mix cases and digits.  Their hashes are
aggregated by distinct repositories (documents, by default) and distinct owners
(sources).  A value that more than ``max_owners`` owners hold, or that stands in more than
``max_repositories`` repositories for each owner, is a widely copied example; one that
few repositories of few owners hold looks live.  Opaque tokens that look live and touch no
base span are added as spans of kind ``live``; base spans always stay, and their
verdicts are counted per document.

Match offsets come from splitting a text at the pattern: the lengths of pieces and
matches are exploded and summed by a window over the matches of one text and kind.
Texts without a trigger are passed over after one test.

Edge cases: a null text has no spans.  Null ids count as one repository, null owners
are no owner of their own (a value without any owner counts as one's).  Rows that repeat an
id count as one repository; each row gets the spans of its own text, once.  Other columns
than the three named are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save

# fixed values: the base patterns; group 2 of the first is the value
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: An opaque token: a whole run of 20 or more that mixes digits, upper and lower case.
TOKEN = (
    "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
)
TRIGGER = f"(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|{ACCESS}|{HEX}|{TOKEN}"
KINDS = ("assign", "access", "hex", "live")
ROW = ["did", "row"]


def pieces(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Array of (kind, i, gap, len, value): the text before each match, and the match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), lambda p: F.char_length(p))
    sized = F.zip_with(gaps, whole, lambda g, w: F.struct(g.alias("gap"), F.char_length(w).alias("len")))
    return F.zip_with(sized, F.transform(value, lambda v, i: F.struct(v.alias("value"), i.alias("i"))), lambda s, v: F.struct(F.lit(kind).alias("kind"), v["i"].alias("i"), s["gap"].alias("gap"), s["len"].alias("len"), v["value"].alias("value")))


def find_candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """One row (did, row, owner, kind, start, end, value) for each base span and opaque token."""
    hit = docs.where(F.col(text_col).rlike(TRIGGER)).select(
        F.col(id_col).alias("did"), F.xxhash64(F.col(text_col)).alias("row"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text")
    )
    text = F.col("text")
    found = hit.select(
        *ROW,
        "owner",
        F.explode(F.concat(pieces(text, 0, ASSIGN, 2), pieces(text, 1, ACCESS, 0), pieces(text, 2, HEX, 0), pieces(text, 3, TOKEN, 0))).alias("m"),
    ).select(*ROW, "owner", "m.*")
    once = found.groupBy(*ROW, "kind", "i", "gap", "len", "value").agg(F.collect_set("owner").alias("owners"))
    upto = W.partitionBy(*ROW, "kind").orderBy("i")
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    keep = (
        F.when(F.col("kind") == 0, F.char_length("value") >= 6)
        .when(F.col("kind") == 3, F.size(F.array_distinct(F.split("value", ""))) >= 10)
        .otherwise(True)
    )
    return placed.where(keep).select(*ROW, "owners", "kind", "start", "end", "value")


def ownership(candidates: DataFrame) -> DataFrame:
    """(v1, v2, repositories, owners): in how many distinct documents and sources a value occurs."""
    return (
        candidates.select("v1", "v2", "did", F.explode_outer("owners").alias("owner"))
        .groupBy("v1", "v2")
        .agg(
            (F.count_distinct("did") + F.max(F.when(F.col("did").isNull(), 1).otherwise(0))).alias("repositories"),
            F.count_distinct("owner").alias("n_owners"),
        )
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, max_repositories: int = 8) -> DataFrame:
    """A row (did, row, spans) for each text with spans; spans: sorted array of
    (start, kind_no, end, live, repositories, owners)."""
    found = save(
        find_candidates(docs, id_col, text_col, owner_col)
        .withColumn("v1", F.xxhash64("value"))
        .withColumn("v2", F.xxhash64(F.lit("value"), F.col("value")))
        .drop("value"),
        "secret-candidates",
    )
    # written, so that both sides of the join are shuffled and a value in very many documents can be split
    owned = save(ownership(found), "secret-ownership")
    few = (F.col("n_owners") <= max_owners) & (F.col("repositories") <= max_repositories * F.greatest("n_owners", F.lit(1)))
    judged = found.drop("owners").join(owned.hint("merge"), ["v1", "v2"]).withColumn("live", few)
    base = F.col("kind") < 3
    in_text = W.partitionBy(*ROW).orderBy("start")
    before = F.max(F.when(base, F.col("end"))).over(in_text.rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(in_text.rangeBetween(0, W.unboundedFollowing))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    spans = judged.withColumn("touched", touched).where(base | (F.col("live") & ~F.col("touched")))
    item = F.struct("start", "kind", "end", "live", "repositories", "n_owners")
    return spans.groupBy(*ROW).agg(F.sort_array(F.collect_set(item)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan_secrets(docs).select(F.col("did").alias("found_id"), F.col("row").alias("found_row"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"))
    joined = rows.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row") == F.col("found_row")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,repositories:bigint,n_owners:bigint>>")
    all_spans = joined.select("doc_id", F.coalesce("spans", none).alias("spans"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return all_spans.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        count(lambda s: (s["kind"] < 3) & s["live"]).alias("n_live_base"),
        count(lambda s: (s["kind"] < 3) & ~s["live"]).alias("n_example_base"),
        count(lambda s: s["kind"] == 3).alias("n_live_added"),
    )
