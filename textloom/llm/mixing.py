"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words (runs of ``[^\\x20\\x09-\\x0D]``).  Sources in code point order, null
last, take the weights in turn; together they get ``share`` times all words.  A target
stops at ``repeats`` times its source's size, and what is above is shared again by
weight until no target is above.

Every source is cut into blocks by a hash of its documents.  An epoch of a source
takes its blocks in a hashed order, passing over those above the rest of its target.
Of these the one whose longest document is shortest is the end block.  In the mix it
gives whole documents in a hashed order, as many as bring the words nearest to the
target; so no text is cut and a source is off by half of that document at most.  Rows
of one id and text have one hash and are taken together.  A plan alone may count words
(``whole=False``): then the end block gives the same fraction of each of its documents,
rounded up or down by a hash, and the words come out at the target.  Each block taken
in an epoch is a token.  The tree starts with all tokens of all sources in one node and halves
every node ``depth`` times: the left child gets the half with the smallest hashes,
which is an exact draw from the multivariate hypergeometric distribution of the
sources' quotas.  The leaves are the output shards.  A shard's quota of a source is
met by the next blocks of that source's own hashed order, so shards draw disjoint
blocks, and a document's place in its shard is a hash.  The mix is written in that
order: a partition is a stretch of a shard.

The halves need ranks of tokens by hash.  They are counted per hash cell and then
within a cell, so no window holds more than a cell of a node.

The source table (a row per distinct source) goes through windows of one task: the
weights follow a global order of the sources.  Documents and blocks never do.

Edge cases: a null text has size 0; null is a source of its own.  Rows that repeat
are separate documents in the same block.  A source without words has target 0 and
nothing is taken.  An empty table gives an empty result.  All hashes are seeded, so
reruns agree.  Other columns of ``docs`` are kept under ``row`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save, shuffle_partitions

WEIGHTS = (5, 2, 1)
BLOCKS = 256
DEPTH = 4
CELLS = 64
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column | str) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, weight, target): weights in turn, filled up to the caps."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    filled = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto, rest = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    capped = ranked.withColumn("capped", F.col("cap") <= level * F.col("weight"))
    left = F.sum("source_size").over(everything) * share - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight") / free)
    return capped.withColumn("target", target).select("source", "source_size", "rank", "weight", "target")


def by_hash_rank(df: DataFrame, group: list[str], hashed: str, out: str) -> DataFrame:
    """``out``: rank from 1 of each row in its group by (hashed, token), ``out_n``: the group's rows.

    Ranks are sums of counts per cell of the hash and ranks within a cell."""
    cells = df.withColumn("cell", F.floor(F.col(hashed) * CELLS).cast("int"))
    counts = cells.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    before = W.partitionBy(*group).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("offset"), F.sum("in_cell").over(W.partitionBy(*group)).alias(f"{out}_n")
    )
    inside = W.partitionBy(*group, "cell").orderBy(hashed, "rank", "place")
    return cells.join(offsets, [*group, "cell"]).withColumn(out, F.col("offset") + F.row_number().over(inside)).drop("cell", "offset")


def block_tokens(blocks: DataFrame, goal: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(rank, block, words, longest) and targets to a token (rank, epoch, block, fits, need, fraction, place) for each block that an epoch takes.

    ``need``: the words that it gives if it does not fit.  ``place`` counts the source's tokens in epoch
    order, each epoch permuted by hash."""
    epochs = blocks.where("words > 0").join(goal.select("rank", "source_size", "target"), "rank").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rest = F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - F.col("epoch") * F.col("source_size")))
    mixed = epochs.withColumn("rest", rest).withColumn("u", unit_hash(F.lit(seed), "rank", "epoch", "block"))
    # an array of a source's blocks, a fixed number
    ordered = mixed.groupBy("rank", "epoch", "rest").agg(F.sort_array(F.collect_list(F.struct("u", "block", "words", "longest"))).alias("all"))

    def step(s: Column, b: Column) -> Column:
        fits = b["words"] <= s["left"]
        return F.struct((s["left"] - F.when(fits, b["words"]).otherwise(0)).alias("left"), F.concat(s["fits"], F.array(fits)).alias("fits"))

    walked = ordered.withColumn("walk", F.aggregate("all", F.struct(F.col("rest").alias("left"), F.array().cast("array<boolean>").alias("fits")), step))
    judged = walked.withColumn("all", F.transform("all", lambda b, i: F.struct(b["u"].alias("u"), b["block"].alias("block"), b["words"].alias("words"), b["longest"].alias("longest"), F.get(F.col("walk.fits"), i).alias("fits"))))
    over = F.transform(F.filter("all", lambda b: ~b["fits"]), lambda b: F.struct(b["longest"], b["u"], b["block"].alias("block")))
    taken = judged.withColumn("end", F.array_min(over)["block"]).select("rank", "epoch", "end", F.col("walk.left").alias("need"), F.inline("all"))
    taken = taken.where(F.col("fits") | ((F.col("block") == F.col("end")) & (F.col("need") > 0)))
    return taken.select("rank", "epoch", "block", "fits", "need", (F.col("need") / F.col("words")).alias("fraction"), F.row_number().over(W.partitionBy("rank").orderBy("epoch", "u", "block")).alias("place"))


def part_hash(h: Column, epoch: Column) -> Column:
    """The order of documents in the block at the end of an epoch."""
    return F.xxhash64(h, epoch, F.lit("part"))


def cutoffs(sizes: DataFrame, ends: DataFrame) -> DataFrame:
    """(rank, block, h, size) and the blocks (rank, block, epoch, need) at the ends of epochs to (rank, block, epoch, cutoff):
    the last ``part_hash`` whose document brings the words nearer to the need.  No row where none does.

    Running sums are sums of counts per hash cell and sums within a cell."""
    key = ["rank", "block", "epoch"]
    hashed = sizes.join(ends, ["rank", "block"]).select(*key, "need", part_hash(F.col("h"), F.col("epoch")).alias("p"), "size")
    docs = hashed.groupBy(*key, "need", "p").agg(F.sum("size").alias("size")).withColumn("cell", F.shiftright("p", 58))
    sums = docs.groupBy(*key, "cell").agg(F.sum("size").alias("in_cell"))
    earlier = W.partitionBy(*key).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*key, "cell", F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy(*key, "cell").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    before = docs.join(offsets, [*key, "cell"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return before.where((F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("need"))).groupBy(*key).agg(F.max("p").alias("cutoff"))


def split_tree(tokens: DataFrame, depth: int, seed: int) -> DataFrame:
    """Quotas (rank, shard, quota): every node's tokens are halved ``depth`` times by an exact hypergeometric draw."""
    node = tokens.select("rank", "place").withColumn("shard", F.lit(0))
    for level in range(depth):
        drawn = node.withColumn("u", unit_hash(F.lit(seed + 1 + level), "rank", "place"))
        ranked = by_hash_rank(drawn, ["shard"], "u", "r")
        node = ranked.select("rank", "place", (F.col("shard") * 2 + F.when(F.col("r") * 2 <= F.col("r_n"), 0).otherwise(1)).alias("shard"))
    return node.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("quota"))


def shard_of(tokens: DataFrame, quotas: DataFrame) -> DataFrame:
    """Tokens with their shard: a source's places in order, as many to each shard as its quota."""
    upto = W.partitionBy("rank").orderBy("shard")
    ranges = quotas.withColumn("last", F.sum("quota").over(upto)).select("rank", "shard", (F.col("last") - F.col("quota") + 1).alias("first"), "last")
    return tokens.join(ranges, "rank").where(F.col("place").between(F.col("first"), F.col("last"))).drop("first", "last")


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    blocks: int = BLOCKS,
    depth: int = DEPTH,
    seed: int = 9,
    carry: list[str] | None = None,
    whole: bool = True,
) -> DataFrame:
    """``docs`` (its columns, or those in ``carry``, as struct ``row``) with ``size``, ``source_size``, ``target``, ``taken`` and ``draws``:
    an array of (epoch, shard, position, words) for the copies that the mix takes."""
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("row"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    ).withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int"))
    sizes = keyed.select("source", "block", "h", "size")
    if whole:
        sizes = save(sizes, "mix-sizes")
    counts = save(sizes.groupBy("source", "block").agg(F.sum("size").alias("words"), F.max("size").alias("longest")), "mix-blocks")
    goal = save(targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats), "mix-targets")
    ranked = counts.join(goal.select("source", "rank"), counts["source"].eqNullSafe(goal["source"])).select("rank", "block", "words", "longest")
    tokens = save(block_tokens(ranked, goal, repeats, seed), "mix-tokens")
    quotas = save(split_tree(tokens, depth, seed), "mix-quotas")
    dealt = shard_of(tokens, quotas)
    if whole:
        named = sizes.join(goal.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).select("rank", "block", "h", "size")
        last = save(cutoffs(named, tokens.where("not fits").select("rank", "block", "epoch", "need")), "mix-cutoffs")
        dealt = dealt.join(last, ["rank", "block", "epoch"], "left").where(F.col("fits") | F.col("cutoff").isNotNull())
    else:
        dealt = dealt.withColumn("cutoff", F.lit(None).cast("long"))
    drawn = dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "fits", "fraction", "cutoff"))).alias("take"))
    per_block = (
        counts.withColumnRenamed("source", "s")
        .join(goal, F.col("s").eqNullSafe(F.col("source")))
        .select("source", "rank", "block", "source_size", "target")
        .join(drawn, ["rank", "block"], "left")
        .select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "source_size", "target", "take")
    )
    joined = keyed.join(per_block, (F.col("block") == F.col("plan_block")) & F.col("source").eqNullSafe(F.col("plan_source")))

    def draw(t: Column) -> Column:
        if whole:
            part = F.when(part_hash(F.col("h"), t["epoch"]) <= t["cutoff"], F.col("size")).otherwise(F.lit(0))
        else:
            part = F.floor(F.col("size") * t["fraction"] + unit_hash(F.col("h"), t["epoch"], F.lit("part")))
        words = F.when(t["fits"], F.col("size")).otherwise(part).cast("long")
        return F.struct(t["epoch"].alias("epoch"), t["shard"].alias("shard"), F.xxhash64("h", t["epoch"]).alias("position"), words.alias("words"))

    draws = F.filter(F.transform(F.coalesce("take", F.array().cast("array<struct<epoch:int,shard:int,fits:boolean,fraction:double,cutoff:bigint>>")), draw), lambda d: d["words"] > 0)
    return joined.withColumn("draws", draws).select(
        "row",
        "size",
        "source_size",
        "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"),
        "draws",
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; all of it if it has no more."""
    skip = F.when(text.rlike("^" + SPACE), 1).otherwise(0)
    rest = F.element_at(F.split(text, SPACE, (n + skip + 1).cast("int")), -1)
    part = F.when(n_words(text) <= n, text).otherwise(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(rest)))
    return F.rtrim(part, F.lit(" \t\n\x0b\x0c\r"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int = DEPTH, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, whole, in the order of shards and of positions within them."""
    drawn = plan_mix(docs, id_col, text_col, source_col, depth=depth, **options).withColumn("draw", F.explode("draws"))
    n = shuffle_partitions(docs.sparkSession)
    # positions are hashes, so equal stretches of them hold about as many rows
    place = (F.col("draw.shard") + F.col("draw.position") / F.lit(2.0**64) + 0.5) / 2**depth
    dealt = drawn.select("row", "draw").repartitionById(n, F.least(F.lit(n - 1), F.floor(place * n)).cast("int"))
    return dealt.sortWithinPartitions("draw.shard", "draw.position").select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs, carry=["doc_id"], whole=False).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "draws")
