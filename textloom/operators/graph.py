"""Entities and evidence: components of shared names, visibility, status-protected updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ledger import checkpointed


def shared_name_components(nodes: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(node, names) to (node, component): nodes that share a lower-cased name, transitively.

    Every round each name takes the smallest component of its nodes, each node the
    smallest of its names, and then the component of that component, so chains shrink by
    half; the lineage is cut by a checkpoint."""
    named = nodes.select("node", F.explode("names").alias("name")).select("node", F.lower(F.btrim("name")).alias("name")).distinct()
    label = nodes.select("node", F.col("node").alias("component")).distinct()
    for _ in range(max_rounds):
        by_name = named.join(label, "node").groupBy("name").agg(F.min("component").alias("component"))
        lower = named.join(by_name, "name").groupBy("node").agg(F.min("component").alias("lower"))
        new = label.join(lower, "node", "left").select("node", F.least("component", F.coalesce("lower", "component")).alias("component"), (F.col("lower") < F.col("component")).alias("moved"))
        new = checkpointed(new)
        if new.where("moved").limit(1).count() == 0:
            return new.drop("moved")
        hop = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        label = new.join(hop, "component").select("node", F.col("further").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def guarded_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new (key, status, value): rows that were confirmed or rejected stay as they were."""
    o, n = old.select(key, F.col("status").alias("s"), F.col("value").alias("v")), new.select(key, "status", "value")
    held = F.col("s").isin("confirmed", "rejected")
    return o.join(n, key, "full").select(
        key, F.when(held | F.col("status").isNull(), F.col("s")).otherwise(F.col("status")).alias("status"), F.when(held | F.col("status").isNull(), F.col("v")).otherwise(F.col("value")).alias("value")
    )


def _runs(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


#: Bits that tell which hashes are asked for: 512 KB, sent to every task.
SIEVE_BITS = 1 << 22


def sieved(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose hash ``key`` is not in ``asked``; none that is there is lost.

    The bits are bounded by ``SIEVE_BITS``; with far more keys than bits all rows pass."""
    bucket = lambda: F.pmod(F.col(key), F.lit(SIEVE_BITS))
    word = F.floor(bucket() / 64).cast("int")
    bits = asked.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits"))
    # a row a word of 64 bits: SIEVE_BITS / 64 rows at most
    return rows.withColumn("_word", word).join(F.broadcast(bits.withColumnRenamed("word", "_word")), "_word").where(F.expr(f"bits & shiftleft(1L, cast(pmod({key}, 64) as int)) != 0")).drop("_word", "bits")


def mentions(texts: DataFrame, text_col: str, names: DataFrame, name_col: str, most: int = 4) -> DataFrame:
    """Rows of ``texts`` joined with those of ``names`` that stand in them as whole tokens ([a-z0-9]+, in lower case).

    An equi join on runs of up to ``most`` tokens, by the first ones of longer names; those are compared whole afterwards.  Only hashes of runs and keys
    of rows go through it, runs that no name's bits in ``sieve`` know stay behind, and texts come back to the few that were found.  Repeated rows share a
    key and each keep their matches."""
    c = F.col
    plain = lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    keyed = texts.withColumns({"_k1": F.xxhash64(*texts.columns), "_k2": F.xxhash64(F.lit("row"), *texts.columns)})
    named = names.withColumn("_whole", plain(name_col)).where("_whole != ''")
    asked = named.select("_whole", F.xxhash64(F.array_join(F.slice(F.split("_whole", " "), 1, most), " ")).alias("_gram")).distinct()
    # the words have a column of their own: within a lambda a text would be split again for each run
    words = keyed.select("_k1", "_k2", F.split(plain(text_col), " ").alias("_words"))
    runs = words.select("_k1", "_k2", F.array_distinct(F.concat(*[_runs(c("_words"), n) for n in range(1, most + 1)])).alias("_grams"))
    rows = runs.select("_k1", "_k2", F.explode_outer("_grams").alias("_gram"))
    met = sieved(rows, asked, "_gram").join(asked, "_gram").select("_k1", "_k2", "_whole").distinct()
    held = keyed.join(met, ["_k1", "_k2"]).withColumn("_plain", plain(text_col)).where(padded(c("_plain")).contains(padded(c("_whole"))))
    return held.drop("_k1", "_k2", "_plain").join(named, "_whole").drop("_whole")
