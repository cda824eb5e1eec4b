"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of words are hashed to ``BUCKETS`` buckets.  The raw model counts them over
all documents, the target model over documents labelled good and not toxic (at most
``MOST_LABELLED`` of them, a parameter, drawn by a hash of the id).  A document's log weight
is the mean over its n-grams of log target minus log raw probability, times ``UNIT``, so
that every document counts as one of that many n-grams and length gives no advantage.
With a Gumbel variable hashed from the id added, the ``share`` of documents with the
highest keys is a sample without replacement in proportion to the weights; the share
is that of good documents among the labelled ones unless it is given.

The k-th key is found by counts over a histogram and a rank within one of its bins, so
no task sorts all documents.

Edge cases: a document without a word has no weight (null) and is not kept unless all
are.  Ties go to the smaller id, null ids last.  Rows that repeat get the same key; each
counts.  Without labels all weights are 0.  A text of any length is weighed whole, by
counts in a fixed number of buckets.  Other columns than the id and the text are not
read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save, small_batches

BUCKETS = 16384
MOST_LABELLED = 5000
UNIT = 50.0
BINS = 4096
SPACE = "[\\x20\\x09-\\x0D]+"


def buckets_of(words: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    h = words.view(np.uint64)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xFF51AFD7ED558CCD)
        whole = np.concatenate([h * np.uint64(0xC2B2AE3D27D4EB4F), pairs])
    return (whole >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACE, -1), lambda w: w != "")
    return docs.select(F.col(id_col).alias("did"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def counted(hashed: DataFrame) -> DataFrame:
    """(bucket, n) over all rows; a task adds up its own before anything is shuffled."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for frame in frames:
            for words in frame["words"]:
                total += np.bincount(buckets_of(np.asarray(words, dtype=np.int64)), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    return hashed.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MOST_LABELLED) -> np.ndarray:
    """Log target minus log raw probability by bucket."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("did")).distinct()
    chosen = good.orderBy(F.xxhash64(F.lit("target"), "did"), "did").limit(most)
    named = docs.join(F.broadcast(chosen), docs[id_col] == F.col("did"), "left_semi")  # at most ``most`` ids
    logs = []
    for part in (named, docs):
        counts = np.full(BUCKETS, 0.5)
        # at most a row per bucket
        rows = counted(word_hashes(part, id_col, text_col)).toPandas()
        counts[rows["bucket"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=float)
        logs.append(np.log(counts / counts.sum()))
        if part is named and not len(rows):
            return np.zeros(BUCKETS)
    return logs[0] - logs[1]


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, seed: int = 4) -> DataFrame:
    """(did, log_weight, key) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            means = [float(sent.value[buckets_of(np.asarray(w, dtype=np.int64))].mean() * UNIT) if len(w) else None for w in frame["words"]]
            yield pd.DataFrame({"did": frame["did"], "log_weight": pd.Series(means, dtype="Float64")})

    scored = word_hashes(docs, id_col, text_col).mapInPandas(weigh, "did long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "did"), 11) + 0.5) / F.lit(float(2**53))
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def top_share(rows: DataFrame, share: float) -> DataFrame:
    """``rows`` with ``kept``: whether its key is among the highest share, by counts and one bin's ranks."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    if not stats.n:
        return rows.withColumn("kept", F.lit(False))
    k = int(np.ceil(share * stats.n))
    width = ((stats.high or 0.0) - (stats.low or 0.0)) / BINS or 1.0
    binned = rows.withColumn("bin", F.when(F.col("key").isNull(), -1).otherwise(F.least(F.floor((F.col("key") - (stats.low or 0.0)) / width), F.lit(BINS - 1))).cast("int"))
    above, edge, need = 0, -1, k
    # at most a row per bin
    for r in sorted(binned.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        if above + r["count"] >= k:
            edge, need = r["bin"], k - above
            break
        above += r["count"]
    inside = binned.where(F.col("bin") == edge).withColumn("r", F.row_number().over(W.partitionBy("bin").orderBy(F.col("key").desc_nulls_last(), F.col("did").asc_nulls_last())))
    rest = binned.where(F.col("bin") != edge).withColumn("kept", F.col("bin") > edge)
    return rest.unionByName(inside.withColumn("kept", F.col("r") <= need).drop("r")).drop("bin")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """(did, log_weight, key, kept) of every row of ``docs``; ``share``: of documents to keep, by default
    the share of good ones among all that are labelled."""
    if share is None:
        share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 1.0
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    scored = save(weights(slim, fit(slim, labels, id_col, text_col, most), id_col, text_col), "importance-keys")
    return top_share(scored, share)


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("did", "doc_id")
