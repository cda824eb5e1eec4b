"""Line deduplication over levelled, sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
in lower case.  Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents lose all their lines except those of the largest document
id that holds them.

The index is a small log-structured store.  Documents arrive in batches of
descending id, each aggregated to one row per key.  A batch is merge-anti-joined with
every run on disk: the keys that no run holds are new, and this batch holds their
keeper; they are added as a run of their own.  So a key stands in exactly one run, and a
compaction, of ``fanout`` runs of a level into one of the next, only puts runs together.
Documents of the other keys of the batch are counted apart.  Runs, batches and counts are
tables bucketed and sorted by key, so neither the anti-joins nor a compaction shuffles
a run again.  They are dropped, with their files, once the frequent keys are written.

Keys are 128 bits: two xxhash64 values under different seeds.

Edge cases: a null text is one empty line, as is an empty one.  A null id counts as
the smallest id (that of the least long, if there is one), and all rows with it as one
document.  Rows that repeat an id count
as one document for ``min_docs``; each row is cleaned by its own text.  Lines of one
document that repeat a kept key all stay.  An empty table gives an empty result.
Columns beside the id and the text are carried through whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.storage import new_path, remove, save, shuffle_partitions

EDGE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALLEST_ID = -(2**63)
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """Strip ASCII white space at both ends, lower A-Z only."""
    bare = F.btrim(line, F.lit(EDGE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row (k1, k2, did, row, pos) for each line long enough to be a duplicate."""
    # hashed before the lines come out: beside the explode the whole text would be hashed for each line
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST_ID)).alias("did"), F.xxhash64(F.col(text_col)).alias("row"), lines_of(F.col(text_col)).alias("lines"))
    base = texts.select("did", "row", F.posexplode("lines").alias("pos", "line"))
    keyed = base.where(F.char_length("line") >= min_chars).select("did", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), F.col("key")).alias("k2"), "did", "row", "pos"
    )


@dataclass
class SortedRuns:
    """Levels of runs (k1, k2, docs, keeper), each key in one run only, and counts (k1, k2, docs) of keys met again.

    ``docs`` counts the documents of one batch that hold the key; ``keeper`` is the largest
    id of the batch that brought the key."""

    spark: SparkSession
    fanout: int = 2
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    counts: list[str] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or shuffle_partitions(self.spark)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        (
            df.repartition(self.buckets, *KEY)
            .write.format("parquet")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", self.paths[name])
            .saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def ingest(self, batch: DataFrame) -> None:
        """``batch``: (k1, k2, docs, keeper), a row per key, ids below those of former batches."""
        held = self.runs()
        whole = self._write(batch)
        if not held:
            self._add(0, whole)
            return
        new = self.spark.table(whole)
        for run in held:
            new = new.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti")
        added = self._write(new)
        again = self.spark.table(whole).join(self.spark.table(added).select(*KEY).hint("merge"), KEY, "left_anti")
        self.counts.append(self._write(again.select(*KEY, "docs")))
        self._drop(whole)
        self._add(0, added)

    def _add(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._add(level + 1, self._write(self._together(merged)))
            for name in merged:
                self._drop(name)

    def _together(self, names: list[str]) -> DataFrame:
        whole = self.spark.table(names[0])
        for name in names[1:]:
            whole = whole.unionByName(self.spark.table(name))
        return whole

    def keepers(self, min_docs: int) -> DataFrame:
        """(k1, k2, keeper) of the keys in ``min_docs`` documents or more."""
        keys = self._together(self.runs())
        if self.counts:
            more = self._together(self.counts).groupBy(*KEY).agg(F.sum("docs").alias("more"))
            keys = keys.join(more.hint("merge"), KEY, "left").withColumn("docs", F.col("docs") + F.coalesce("more", F.lit(0)))
        return keys.where(F.col("docs") >= min_docs).select(*KEY, "keeper")

    def clear(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def build_runs(found: DataFrame, batches: int, fanout: int = 2) -> SortedRuns:
    """Feed ``occurrences`` to the store in batches of descending document id."""
    spark = found.sparkSession
    store = SortedRuns(spark, fanout)
    low, high = found.where(F.col("did") != SMALLEST_ID).agg(F.min("did"), F.max("did")).first()
    span = 1 if low is None else high - low + 1
    step = -(-span // batches)
    for i in range(batches):
        part = found
        if low is not None and batches > 1:
            top, bottom = high - i * step, high - (i + 1) * step
            part = part.where(F.col("did") <= top) if i else part
            part = part.where(F.col("did") > bottom) if i + 1 < batches else part
        elif i:
            break
        rows = part.groupBy(*KEY).agg(F.count_distinct("did").alias("docs"), F.max("did").alias("keeper"))
        store.ingest(rows)
    return store


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with its lines deduplicated: all its columns under ``row`` (a struct), and
    ``n_lines``, ``n_dropped``, ``kept_text`` (null text: the empty string)."""
    found = save(occurrences(docs, id_col, text_col, min_chars), "line-occurrences")
    store = build_runs(found, batches, fanout)
    # written, so that both sides of the join are shuffled and a key in very many documents can be split
    frequent = save(store.keepers(min_docs), "line-frequent")
    store.clear()
    drops = (
        found.join(frequent.hint("merge"), KEY)
        .where(F.col("did") != F.col("keeper"))
        .groupBy("did", "row")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST_ID)).alias("did"),
        F.xxhash64(F.col(text_col)).alias("row"),
    )
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    # a column of its own: inside the lambda the split would run once for each line
    cut = rows.join(drops, ["did", "row"], "left").select("doc", "dropped", F.split(text, "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    return cut.select(
        F.col("doc").alias("row"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")).alias("kept_text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> f.keeper, false) AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
