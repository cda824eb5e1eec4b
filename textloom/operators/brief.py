"""Memory that a batch of segments may know, and the brief made of it.

A book's memory is made from the whole book, so most of it lies ahead of any one batch.  What a fact needs comes true once and stays true: its other names have
been seen, its name stands in an earlier batch, and so does a piece of evidence.  So each fact has three numbers of batches from which these hold, found by
equi joins, and a batch sees it from the largest of them.  How many facts a batch sees, and why it does not see the others, are running sums of the facts that
begin and end at each batch: nothing is joined by ranges, and no task holds a book.

A confirmed fact needs no evidence, and its later names do not hide it: it counts where it was seen before, or where it or one of its names stands in the batch.

Edge cases: a batch without any name has a row with an empty context; facts whose name never stands in the book are hidden from all batches, by their name, or by
an other name that never stands there; nulls as books or names are none; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import estimate_tokens
from textloom.operators import ledger

c = F.col
NEVER = 2**40
STATES = ["visible", "excluded_alias", "excluded_name", "excluded_evidence"]
#: What a segment with the name counts, and one with an other name.
NAME_WEIGHT, ALIAS_WEIGHT = 4, 2


def intervals(facts: DataFrame, aliases: DataFrame, evidence: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book, name, confirmed, alias_from, name_from, evidence_from): from which batch on each holds.

    ``facts`` (book, name, confirmed), ``aliases`` (book, name, alias), ``evidence`` (book, name, batch), ``mentions`` (book, batch, ordinal, name)."""
    first = mentions.groupBy("book", "name").agg(F.min("batch").alias("first"))
    seen = aliases.join(first.withColumnRenamed("name", "alias"), ["book", "alias"], "left")
    last_alias = seen.groupBy("book", "name").agg(F.max(F.coalesce("first", F.lit(NEVER))).alias("last_alias"))
    proof = evidence.groupBy("book", "name").agg(F.min("batch").alias("proof"))
    known = facts.join(first, ["book", "name"], "left").join(last_alias, ["book", "name"], "left").join(proof, ["book", "name"], "left")
    return known.select(
        "book", "name", "confirmed",
        F.when(c("confirmed"), 1).otherwise(F.coalesce("last_alias", F.lit(1))).cast("long").alias("alias_from"),
        F.coalesce(c("first") + F.when(c("confirmed"), 0).otherwise(1), F.lit(NEVER)).cast("long").alias("name_from"),
        F.when(c("confirmed"), 1).otherwise(F.coalesce(c("proof") + 1, F.lit(NEVER))).cast("long").alias("evidence_from"),
    )


def counters(held: DataFrame, aliases: DataFrame, mentions: DataFrame, batches: DataFrame) -> DataFrame:
    """(book, batch) with the number of facts in each of ``STATES``; what hides a fact is the first of alias, name, evidence."""
    named = F.greatest("alias_from", "name_from")
    steps = [
        ("excluded_alias", F.lit(1), 1), ("excluded_alias", c("alias_from"), -1), ("excluded_name", c("alias_from"), 1), ("excluded_name", named, -1),
        ("excluded_evidence", named, 1), ("excluded_evidence", F.greatest(named, "evidence_from"), -1), ("visible", F.greatest(named, "evidence_from"), 1),
    ]
    changes = F.array(*[F.struct(F.lit(w).alias("what"), b.cast("long").alias("batch"), F.lit(d).cast("long").alias("delta")) for w, b, d in steps])
    begun = held.select("book", F.inline(changes)).where(c("batch") < NEVER)
    # a confirmed fact whose name comes later, in a batch where an other name stands
    early = aliases.join(held.where("confirmed").select("book", "name", "name_from"), ["book", "name"])
    early = early.join(mentions.select("book", "batch", c("name").alias("alias")), ["book", "alias"]).where(c("batch") < c("name_from")).select("book", "name", "batch").distinct()
    turned = F.array(*[F.struct(F.lit(w).alias("what"), (c("batch") + later).alias("at"), F.lit(d).cast("long").alias("delta")) for w, later, d in (("visible", 0, 1), ("visible", 1, -1), ("excluded_name", 0, -1), ("excluded_name", 1, 1))])
    passing = early.select("book", F.inline(turned)).withColumnRenamed("at", "batch").select("book", "what", "batch", "delta")
    asked = batches.select("book", F.explode(F.array(*[F.lit(s) for s in STATES])).alias("what"), "batch", F.lit(0).cast("long").alias("delta"), F.lit(True).alias("asked"))
    every = asked.unionByName(begun.unionByName(passing).withColumn("asked", F.lit(False))).groupBy("book", "what", "batch").agg(F.sum("delta").alias("delta"), F.max("asked").alias("asked"))
    summed = ledger.running_sum(every, ["book", "what"], ["batch"], "delta", "before").where("asked").withColumn("n", c("before") + c("delta"))
    return summed.groupBy("book", "batch").agg(*[F.sum(F.when(c("what") == s, c("n")).otherwise(0)).alias(s) for s in STATES])


def chosen(held: DataFrame, aliases: DataFrame, mentions: DataFrame, budget: int) -> DataFrame:
    """(book, batch, matched, chosen, tokens, context): the visible facts that stand in a batch, the best first, while their entries fit the budget.

    What is sorted for a batch is as long as the batch has names."""
    asked = held.select("book", "name", c("name").alias("found"), F.lit(NAME_WEIGHT).alias("weight")).unionByName(aliases.select("book", "name", c("alias").alias("found"), F.lit(ALIAS_WEIGHT).alias("weight")))
    here = mentions.groupBy("book", "batch", c("name").alias("found")).agg(F.count(F.lit(1)).alias("n"))
    hits = here.join(asked, ["book", "found"]).groupBy("book", "batch", "name").agg(F.sum(c("n") * c("weight")).alias("score"), F.array_sort(F.collect_set(F.when(c("weight") == ALIAS_WEIGHT, c("found")))).alias("others"))
    seen = hits.join(held, ["book", "name"]).where(c("confirmed") | (c("batch") >= F.greatest("alias_from", "name_from", "evidence_from")))
    entry = F.when(F.size("others") > 0, F.concat("name", F.lit(" ("), F.array_join("others", ", "), F.lit(")"))).otherwise(c("name"))
    sized = seen.select("book", "batch", "name", "score", entry.alias("entry")).withColumn("size", estimate_tokens(c("entry")))
    best = W.partitionBy("book", "batch").orderBy(c("score").desc(), "name")
    placed = sized.withColumn("place", F.row_number().over(best)).withColumn("total", F.sum("size").over(best.rowsBetween(W.unboundedPreceding, W.currentRow)))
    fits = c("total") <= budget
    listed = F.array_sort(F.collect_list(F.when(fits, F.struct("place", "entry"))))
    return placed.groupBy("book", "batch").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(fits).alias("chosen"), F.coalesce(F.sum(F.when(fits, c("size"))), F.lit(0)).alias("tokens"),
        F.array_join(F.transform(listed, lambda x: x["entry"]), "; ").alias("context"),
    )


def briefs(segments: DataFrame, mentions: DataFrame, facts: DataFrame, aliases: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """A row per batch of ``segments`` (book, batch, ordinal): its range, the counters of the book's memory, and the chosen context.

    Batches are numbered from 1 in the order of the book.  ``mentions`` (book, batch, ordinal, name) hold names and other names alike; ``facts``, ``aliases``
    and ``evidence`` are as in ``intervals``."""
    mentions, aliases = mentions.select("book", "batch", "ordinal", "name").distinct(), aliases.select("book", "name", "alias").distinct()
    facts = facts.where(c("name").isNotNull()).groupBy("book", "name").agg(F.max("confirmed").alias("confirmed"))
    batches = segments.groupBy("book", "batch").agg(F.count(F.lit(1)).alias("segments"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    held = intervals(facts, aliases, evidence, mentions)
    counted = batches.join(counters(held, aliases, mentions, batches), ["book", "batch"], "left")
    full = counted.join(chosen(held, aliases, mentions, budget), ["book", "batch"], "left")
    return full.select("book", "batch", "segments", "first", "last", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in [*STATES, "matched", "chosen", "tokens"]], F.coalesce("context", F.lit("")).alias("context"))
