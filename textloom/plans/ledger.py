"""Queries over versioned results, runs and events.

Orders stand for results (customer = segment, order = version, status O = accepted,
P = candidate, F = failed), line items for the run's bridge rows, events for the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import round_half_up
from textloom.operators import ledger, segments
from textloom.plans import derived
from textloom.plans.base import Literal, query, table



def newest() -> list:
    return [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]


ACCEPTED = "(SELECT * FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], newest())


@query("win01_latest_accepted", f"SELECT o_custkey, o_orderkey, o_totalprice FROM {ACCEPTED}")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice")


@query("jon01_accepted_of_source", "SELECT c.c_custkey, c.c_mktsegment, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey, count(*) AS versions FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY ALL")
def jon01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    by = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count(F.lit(1)).alias("versions"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(by, "c_custkey")


@query(
    "jon02_overlay_candidates",
    f"""WITH p AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT a.o_custkey, coalesce(CASE WHEN p.o_custkey % 3 <> 0 THEN p.v END, a.o_orderpriority) AS value, p.v IS NOT NULL AS has_candidate FROM {ACCEPTED} a LEFT JOIN p ON a.o_custkey = p.o_custkey""",
)
def jon02(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = accepted(spark, sf_dir).select("o_custkey", F.col("o_orderpriority").alias("value"))
    p = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("value"))
    blanked = p.withColumn("value", F.when(F.col("o_custkey") % 3 != 0, F.col("value")).otherwise("  "))
    return ledger.overlay(base, blanked, ["o_custkey"], "value").join(p.select("o_custkey", F.lit(True).alias("has_candidate")), "o_custkey", "left").select("o_custkey", "value", F.coalesce("has_candidate", F.lit(False)).alias("has_candidate"))


@query(
    "jon03_segment_page",
    """SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS accepted,
(SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS candidate FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100""",
)
def jon03(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").offset(100).limit(50)
    o, order = table(spark, sf_dir, "orders"), F.struct("o_orderdate", "o_orderkey")
    # the page goes into the join first, so only its orders are aggregated
    return page.join(o, page["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(
        ledger.newest_value("o_orderkey", order, F.col("o_orderstatus") == "O").alias("accepted"), ledger.newest_value("o_orderkey", order, F.col("o_orderstatus") == "P").alias("candidate")
    )


@query("jon04_run_segments", "SELECT l.l_orderkey, l.l_partkey, p.p_brand, o.o_orderpriority FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus IN ('P', 'F') AND l.l_linestatus = 'O'")
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("P", "F")).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").join(o, "l_orderkey").join(p, "l_partkey").select("l_orderkey", "l_partkey", "p_brand", "o_orderpriority")


@query(
    "jon05_current_findings",
    """WITH reviewed AS (SELECT source, max(doc_id) AS run FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source)
SELECT d.doc_id, d.source, l.quality, l.toxic, r.run FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN reviewed r ON r.source = d.source WHERE l.quality = 0 OR d.doc_id = r.run""",
)
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")  # noqa: E741
    runs = d.join(l, "doc_id", "left_semi").groupBy("source").agg(F.max("doc_id").alias("run"))
    return l.join(d, "doc_id").join(runs, "source").where((F.col("quality") == 0) | (F.col("doc_id") == F.col("run"))).select("doc_id", "source", "quality", "toxic", "run")


@query("jon06_evidence_context", "SELECT l.doc_id, l.toxic, d.source, d.n_chars FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'en'")
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(d, "doc_id", "left")


@query(
    "jon07_temporal_visibility",
    """WITH facts AS (SELECT l_partkey AS node, max(l_orderkey) AS last_seen, count(*) AS evidence FROM lineitem GROUP BY 1), batches AS (SELECT DISTINCT (o_orderkey // 1500) * 1500 AS boundary FROM orders)
SELECT b.boundary, count(f.node) AS visible, coalesce(sum(f.evidence), 0) AS evidence FROM batches b LEFT JOIN facts f ON f.last_seen < b.boundary GROUP BY 1""",
)
def jon07(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fact counts from the first boundary above all its evidence: bucket it there, then sum up; no range join
    first = (F.floor(F.col("last_seen") / 1500) + 1) * 1500
    facts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_orderkey").alias("last_seen"), F.count(F.lit(1)).alias("evidence"))
    starts = facts.groupBy(first.alias("boundary")).agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("e"))
    bounds = table(spark, sf_dir, "orders").select((F.floor(F.col("o_orderkey") / 1500) * 1500).alias("boundary")).distinct()
    # a row per boundary
    upto = W.orderBy("boundary").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = bounds.withColumn("asked", F.lit(True)).join(starts, "boundary", "full")
    return every.select("boundary", "asked", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("visible"), F.coalesce(F.sum("e").over(upto), F.lit(0)).alias("evidence")).where("asked").drop("asked")


@query("jon11_missing_and_retry", "SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jon11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("jon12_users_without_end", "SELECT user_id, count(*) AS events FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.user_id = e.user_id AND t.event_type = (SELECT max(event_type) FROM events) AND t.value > 90) GROUP BY user_id")
def jon12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_type").alias("event_type"))
    ended = e.where("value > 90").join(F.broadcast(last), "event_type", "left_semi").select("user_id").distinct()  # a single row
    return e.join(ended, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


@query(
    "jon13_verify_project",
    f"""WITH a AS {ACCEPTED}, n AS (SELECT o_custkey, count(*) AS any_version FROM orders GROUP BY 1)
SELECT CASE WHEN n.any_version IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'unaccepted' WHEN a.o_orderkey % 5 <> c.c_custkey % 5 THEN 'stale-source' WHEN a.o_orderpriority <> '1-URGENT' THEN 'stale-prompt' ELSE 'accepted' END AS state, count(*) AS n
FROM customer c LEFT JOIN a ON a.o_custkey = c.c_custkey LEFT JOIN n ON n.o_custkey = c.c_custkey GROUP BY 1""",
)
def jon13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders")
    by = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.when(F.col("o_orderstatus") == "O", F.struct("o_orderdate", "o_orderkey"))).alias("a"), F.count(F.lit(1)).alias("n")
    )
    state = (
        F.when(F.col("n").isNull(), "missing").when(F.col("a").isNull(), "unaccepted").when(F.col("a.o_orderkey") % 5 != F.col("c_custkey") % 5, "stale-source")
        .when(F.col("a.o_orderpriority") != "1-URGENT", "stale-prompt").otherwise("accepted")
    )
    return c.join(by, "c_custkey", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


ALIASES = Literal("node string, names array<string>", (("n1", ["Anna", "Annie"]), ("n2", ["Bob", "annie"]), ("n3", ["Robert", "bob"]), ("n4", ["Zed"])), more=derived.ALIASES)


@query("jon14_alias_lookup", f"SELECT name, arg_min(node, (node, pos)) AS node FROM (SELECT node, generate_subscripts(names, 1) AS pos, lower(unnest(names)) AS name FROM {ALIASES.sql()} a) GROUP BY name")
def jon14(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ALIASES.df(spark, sf_dir).select("node", F.posexplode("names").alias("pos", "name"))
    return named.groupBy(F.lower("name").alias("name")).agg(F.min_by("node", F.struct("node", "pos")).alias("node"))


@query(
    "jon15_edges_within",
    "WITH s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), p AS (SELECT p_partkey FROM part WHERE p_size < 10) SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT * FROM s) AND l_partkey IN (SELECT * FROM p)",
)
def jon15(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_semi").distinct().select("l_suppkey", "l_partkey")


@query(
    "jon16_example_candidates",
    f"""SELECT a.o_custkey, a.o_orderkey, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 0 WHEN 4 * a.o_orderkey > 3 * m.top THEN 1 ELSE 2 END AS tier FROM {ACCEPTED} a JOIN customer c ON c.c_custkey = a.o_custkey, (SELECT max(o_orderkey) AS top FROM orders) m
WHERE a.o_orderkey < m.top AND (a.o_orderkey >= m.top - 250 OR c.c_mktsegment = 'BUILDING' OR contains(lower(a.o_orderpriority), 'urgent')) ORDER BY tier, o_orderkey DESC, o_custkey LIMIT 200""",
)
def jon16(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    same = F.col("c_mktsegment") == "BUILDING"
    # those before the newest order, a single row
    newest = F.broadcast(table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("top")))
    key, top = F.col("o_orderkey"), F.col("top")
    found = accepted(spark, sf_dir).join(c, "o_custkey").join(newest).where((key < top) & ((key >= top - 250) | same | F.lower("o_orderpriority").contains("urgent")))
    tier = F.when(same, 0).when(4 * key > 3 * top, 1).otherwise(2)
    return found.select("o_custkey", "o_orderkey", tier.alias("tier")).orderBy("tier", F.col("o_orderkey").desc(), "o_custkey").limit(200)


@query(
    "jon17_merge_pieces",
    """WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), k AS (SELECT * FROM p WHERE NOT (conv_id % 10 = 3 AND i = 1))
SELECT conv_id, md5(string_agg(text, ' ' ORDER BY i)) AS merged FROM k GROUP BY conv_id HAVING count(*) = max(n) AND max(i) = max(n) - 1 AND bool_and(trim(text) <> '')""",
)
def jon17(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id")
    p = table(spark, sf_dir, "conversations").select("conv_id", "text", (F.row_number().over(w.orderBy("turn", "role", "text")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    kept = p.where(~((F.col("conv_id") % 10 == 3) & (F.col("i") == 1)))
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("parts"), F.max("n").alias("n"), F.every(F.btrim("text") != "").alias("filled"))
    done = whole.where((F.size("parts") == F.col("n")) & F.col("filled") & (F.element_at("parts", -1)["i"] == F.col("n") - 1))
    return done.select("conv_id", F.md5(F.array_join(F.transform("parts", lambda x: x["text"]), " ").cast("binary")).alias("merged"))


@query("jon18_merge_catalog", "SELECT coalesce(a.c_nationkey, b.s_nationkey) AS nation, coalesce(b.bal, a.bal) AS balance, a.bal IS NULL AS only_new FROM (SELECT c_nationkey, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey, round(sum(s_acctbal), 2) AS bal FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.c_nationkey = b.s_nationkey")
def jon18(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("a"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.sum("s_acctbal"), 2).alias("b"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("b", "a").alias("balance"), F.col("a").isNull().alias("only_new"))


@query(
    "jon19_run_comparison",
    """WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || '.' WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS text FROM documents), j AS (SELECT a.doc_id AS i, b.doc_id AS k, a.text AS x, b.text AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT bool_and(i IS NOT NULL AND k IS NOT NULL) AS comparable, count(*) FILTER (WHERE x IS DISTINCT FROM y) AS changed, count(*) AS n FROM j""",
)
def jon19(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("x"), F.lit(1).alias("in_a"))
    changed = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("."))).when(F.col("doc_id") % 17 != 0, F.col("text"))
    b = table(spark, sf_dir, "documents").select("doc_id", changed.alias("y"), F.lit(1).alias("in_b"))
    return a.join(b, "doc_id", "full").agg(F.every(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("comparable"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("changed"), F.count(F.lit(1)).alias("n"))


@query("jon23_resolve_project", "SELECT p_brand, arg_max(p_partkey, (CASE WHEN p_size = 1 THEN 4 ELSE 0 END + CASE WHEN starts_with(p_type, 'ST') THEN 2 ELSE 0 END, p_partkey)) AS chosen FROM part GROUP BY p_brand")
def jon23(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("p_size") == 1, 4).otherwise(0) + F.when(F.col("p_type").startswith("ST"), 2).otherwise(0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(score.alias("s"), F.col("p_partkey"))).alias("chosen"))


@query(
    "win02_preceding_context",
    "SELECT conv_id, turn, role, array_to_string(coalesce(list(left(text, 900)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), '|') AS before FROM conversations",
)
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("head", F.substring("text", 1, 900))
    return segments.preceding(c, ["conv_id"], ["turn", "role", "text"], "head", 3).select("conv_id", "turn", "role", F.array_join("before", "|").alias("before"))


@query("win03_prior_summaries", "SELECT o_custkey, o_orderkey, array_to_string(coalesce(list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), ',') AS prior FROM orders")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.preceding(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", 2)
    return rows.select("o_custkey", "o_orderkey", F.array_join(F.transform("before", lambda x: x.cast("string")), ",").alias("prior"))


@query("win08_fixed_groups", "SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 AS grp, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return ledger.ranked(d, ["source"], ["doc_id"]).select("doc_id", F.floor((F.col("rank") - 1) / 4).alias("grp"), "source")


@query("win10_duplicate_ids", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) SELECT l_orderkey, count(*) FILTER (WHERE n = 1) AS kept, count(*) FILTER (WHERE n > 1) AS repeated FROM r GROUP BY l_orderkey")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("repeated"))


@query("win11_exact_dedupe", "SELECT source, md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1, 2")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("win12_region_thirds", "WITH r AS (SELECT conv_id, turn, (turn - min(turn) OVER (PARTITION BY conv_id)) / greatest(1, max(turn) OVER (PARTITION BY conv_id) - min(turn) OVER (PARTITION BY conv_id)) AS p FROM conversations) SELECT conv_id, CASE WHEN p < 1/3 THEN 'early' WHEN p > 2/3 THEN 'late' ELSE 'middle' END AS region, count(*) AS n FROM r GROUP BY 1, 2")
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id")
    p = (F.col("turn") - F.min("turn").over(w)) / F.greatest(F.lit(1), F.max("turn").over(w) - F.min("turn").over(w))
    region = F.when(F.col("p") < 1 / 3, "early").when(F.col("p") > 2 / 3, "late").otherwise("middle")
    return table(spark, sf_dir, "conversations").select("conv_id", p.alias("p")).groupBy("conv_id", region.alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("win09_heading_outline", "WITH h AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 20 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS lvl, source FROM documents), a AS (SELECT *, last_value(CASE WHEN lvl = 1 THEN doc_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id) AS h1, last_value(CASE WHEN lvl = 2 THEN doc_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id) AS h2 FROM h) SELECT doc_id, source, h1, CASE WHEN h2 > coalesce(h1, -1) THEN h2 END AS h2 FROM a")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    level = F.when(F.col("doc_id") % 20 == 0, 1).when(F.col("doc_id") % 5 == 0, 2).otherwise(0)
    at = lambda n: F.last(F.when(F.col("lvl") == n, F.col("doc_id")), ignorenulls=True).over(w)
    a = table(spark, sf_dir, "documents").select("doc_id", "source", level.alias("lvl")).select("doc_id", "source", at(1).alias("h1"), at(2).alias("h2"))
    return a.withColumn("h2", F.when(F.col("h2") > F.coalesce("h1", F.lit(-1)), F.col("h2")))


@query("top01_paged_list", "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 40")
def top01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy(F.col("doc_id").desc()).offset(40).limit(20)


@query("top02_latest_ascending", "SELECT * FROM (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25) ORDER BY event_id")
def top02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.col("event_id").desc()).limit(25).orderBy("event_id")


@query("top03_keep_newest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def top03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id")


@query("top04_evict_least_used", "SELECT user_id, hits FROM (SELECT user_id, count(*) AS hits, min(event_id) AS born FROM events GROUP BY 1) ORDER BY hits DESC, born DESC LIMIT 40")
def top04(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.min("event_id").alias("born"))
    return ledger.keep_newest(used, [F.col("hits").desc(), F.col("born").desc()], 40).select("user_id", "hits")


@query("top05_evict_oldest", "SELECT user_id, first_seen FROM (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1) ORDER BY first_seen DESC LIMIT (SELECT CAST(floor(count(DISTINCT user_id) * 0.8) AS BIGINT) FROM events)")
def top05(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"))
    bounds = seen.agg(F.floor(F.count(F.lit(1)) * 0.8).alias("keep"))  # a single row with the number to keep
    newest = ledger.ranked(seen.withColumn("age", -F.col("first_seen")), [], ["age"])
    return newest.join(F.broadcast(bounds), F.col("rank") <= F.col("keep")).select("user_id", "first_seen")


@query("top07_even_sample", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE EXISTS (SELECT 1 FROM range(4) k(j) WHERE i = (k.j * (n - 1)) // 3)")
def top07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    r = ledger.ranked(d, ["source"], ["doc_id"]).join(sizes, "source").withColumn("i", (F.col("rank") - 1).cast("int"))
    wanted = F.array(*[F.floor(F.lit(j) * (F.col("n") - 1) / 3).cast("int") for j in range(4)])
    return r.where(F.array_contains(wanted, F.col("i"))).select("source", "doc_id")


@query("top09_example_ranking", "WITH q AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark), s AS (SELECT a.item_id AS item_id, b.item_id AS other, len(list_intersect(a.t, b.t)) AS shared, len(a.t) AS n FROM q a JOIN q b ON a.item_id <> b.item_id AND a.item_id // 10 = b.item_id // 10) SELECT item_id, other, shared, round(shared / n * 6 + least(shared, 3) * 0.15 + 0.5 / (1 + abs(item_id - other) / 40), 6) AS score FROM s WHERE shared >= 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(shared / n * 6 + least(shared, 3) * 0.15 + 0.5 / (1 + abs(item_id - other) / 40), 6) DESC, other) <= 3")
def top09(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", F.floor(F.col("item_id") / 10).alias("part"), F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    other = q.select(F.col("item_id").alias("other"), "part", F.col("t").alias("u"))
    s = q.join(other, "part").where(F.col("item_id") != F.col("other")).select("item_id", "other", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"), F.size("t").alias("n"))
    score = F.round(F.col("shared") / F.col("n") * 6 + F.least("shared", F.lit(3)) * 0.15 + 0.5 / (1 + F.abs(F.col("item_id") - F.col("other")) / 40), 6)
    return ledger.latest(s.where("shared >= 2").withColumn("score", score), ["item_id"], [F.col("score").desc(), F.col("other")], 3).select("item_id", "other", "shared", "score")


@query("top11_top_per_kind", "SELECT p_brand, p_partkey, p_size * 4 + length(p_type) % 3 * 2 AS score FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 4 + length(p_type) % 3 * 2 DESC, p_partkey) <= 4")
def top11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 4 + F.char_length("p_type") % 3 * 2).cast("long").alias("score"))
    return ledger.latest(p, ["p_brand"], [F.col("score").desc(), F.col("p_partkey")], 4)


@query("top13_longest_tokens", "SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(lower(text), ' ')), lambda w: struct_pack(n := -length(w), w := w)))[1:12], lambda x: x.w), ' ') AS tokens FROM benchmark")
def top13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(F.slice(F.array_sort(words), 1, 12), lambda x: x["w"]), " ").alias("tokens"))


@query("top14_preferred_model", "SELECT o_custkey, arg_min(o_orderpriority, (CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey)) AS preferred FROM orders GROUP BY o_custkey")
def top14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "3-MEDIUM", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(rank.alias("r"), F.col("o_orderkey"))).alias("preferred"))


@query("set01_difference", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("set02_later_wins", "WITH u AS (SELECT doc_id, source AS v, 0 AS layer FROM documents WHERE doc_id < 600 UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE doc_id >= 400) SELECT doc_id, arg_max(v, layer) AS value FROM u GROUP BY doc_id")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a, b = d.where("doc_id < 600").select("doc_id", F.col("source").alias("value")), d.where("doc_id >= 400").select("doc_id", F.col("lang").alias("value"))
    return ledger.upsert(a, b, ["doc_id"])


@query("set03_scope_equality", "SELECT NOT EXISTS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AND NOT EXISTS (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS equal_scope, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left")
def set03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("a")).distinct(), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("b")).distinct()  # noqa: E741
    return d.join(l, "doc_id", "full").agg(F.every(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("equal_scope"), F.count_if(F.col("b").isNull()).alias("only_left"))


@query("set04_token_jaccard", "WITH t AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    n = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("x"))
    return t.join(n, "item_id").select("item_id", F.round(F.size(F.array_intersect("w", "x")) / F.size(F.array_union("w", "x")), 6).alias("jaccard"))


@query("set05_clean_terms", "WITH w AS (SELECT doc_id, list_transform(string_split(text, ' ')[1:120], lambda x: left(regexp_replace(x, '[<>\\x00-\\x1f]', '', 'g'), 64)) AS t FROM documents), d AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM w), f AS (SELECT doc_id, term, min(p) AS p FROM d WHERE term <> '' GROUP BY 1, 2), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= 50) SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms FROM k GROUP BY doc_id")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = F.transform(F.slice(F.split("text", " "), 1, 120), lambda x: F.substring(F.regexp_replace(x, r"[<>\x00-\x1f]", ""), 1, 64))
    terms = F.sort_array(F.slice(F.array_distinct(F.filter(cleaned, lambda x: x != "")), 1, 50))
    return table(spark, sf_dir, "documents").select("doc_id", terms.alias("t")).where(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"))


@query("sta03_finish_run", "WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS candidates, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS ok FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN pending > 0 THEN 'paused' WHEN candidates > 0 THEN 'awaiting-review' WHEN failed > 0 AND ok > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS outcome FROM c")
def sta03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if((F.col("o_orderpriority") == "5-LOW") & (s == "P")).alias("pending"), F.count_if(s == "P").alias("c"), F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("a"))
    return n.select("o_custkey", ledger.run_outcome(F.col("pending"), F.col("c"), F.col("f"), F.col("a")).alias("outcome"))


@query("sta04_accept_candidates", f"WITH p AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, max(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT p.o_custkey, p.k AS o_orderkey FROM p LEFT JOIN {ACCEPTED} a ON a.o_custkey = p.o_custkey WHERE a.o_custkey IS NULL OR a.o_orderdate < p.d")
def sta04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("d"))
    newer = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("a"))
    return p.join(newer, "o_custkey", "left").where(F.col("a").isNull() | (F.col("a") < F.col("d"))).select("o_custkey", "o_orderkey")


@query("sta05_import_counts", "SELECT count(*) FILTER (WHERE length(d.text) BETWEEN 1 AND 20000 AND l.doc_id IS NULL) AS imported, count(*) FILTER (WHERE NOT (length(d.text) BETWEEN 1 AND 20000 AND l.doc_id IS NULL)) AS skipped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def sta05(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))  # noqa: E741
    fits = F.char_length("text").between(1, 20000) & F.col("has").isNull()
    return table(spark, sf_dir, "documents").join(l, "doc_id", "left").agg(F.count_if(fits).alias("imported"), F.count_if(~fits).alias("skipped"))



@query("sta07_recover_runs", "WITH t AS (SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) GROUP BY 1) SELECT u.user_id, coalesce(t.last_type, 'failed') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN t ON t.user_id = u.user_id")
def sta07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2).withColumn("ends", F.lit(True))
    # two rows
    marked = e.join(F.broadcast(kinds), "event_type", "left")
    return marked.groupBy("user_id").agg(F.coalesce(F.max_by("event_type", F.when(F.col("ends"), F.col("event_id"))), F.lit("failed")).alias("state"))


@query("sta01_status_replay", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'failed' ELSE arg_max(o_orderstatus, (o_orderdate, o_orderkey)) END AS status, min(o_orderdate) AS started, max(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END) AS finished FROM orders GROUP BY o_custkey")
def sta01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(F.some(s == "F"), "failed").otherwise(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(status.alias("status"), F.min("o_orderdate").alias("started"), F.max(F.when(s.isin("F", "O"), F.col("o_orderdate"))).alias("finished"))


@query("flt15_run_scope", f"WITH a AS {ACCEPTED} SELECT c.c_custkey, CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey % 3 = 0 THEN 'stale-hash' WHEN a.o_orderpriority <> '1-URGENT' AND a.o_orderkey % 7 <> 0 THEN 'stale-fingerprint' END AS reason FROM customer c LEFT JOIN a ON a.o_custkey = c.c_custkey WHERE a.o_orderkey IS NULL OR a.o_orderkey % 3 = 0 OR (a.o_orderpriority <> '1-URGENT' AND a.o_orderkey % 7 <> 0)")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = accepted(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    reason = F.when(k.isNull(), "missing").when(k % 3 == 0, "stale-hash").when((F.col("o_orderpriority") != "1-URGENT") & (k % 7 != 0), "stale-fingerprint")
    return table(spark, sf_dir, "customer").select("c_custkey").join(a, "c_custkey", "left").select("c_custkey", reason.alias("reason")).where(F.col("reason").isNotNull())


@query("flt20_cache_freshness", "WITH k AS (SELECT user_id, arg_max(event_type, event_id) AS v, max(ts) AS ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, CASE WHEN ts + INTERVAL 3 HOUR <= now THEN 'expired' WHEN v = 'click' THEN 'hit' ELSE 'stale' END AS freshness FROM k, n")
def flt20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    k = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("v"), F.max("ts").alias("ts"))
    freshness = F.when(F.col("ts") + F.expr("INTERVAL 3 HOURS") <= F.col("now"), "expired").when(F.col("v") == "click", "hit").otherwise("stale")
    return k.join(F.broadcast(now)).select("user_id", freshness.alias("freshness"))  # a single row


@query("snk03_upsert", "WITH n AS (SELECT doc_id, 'new' AS source, lang FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return ledger.upsert(d, d.where("doc_id % 4 = 0").withColumn("source", F.lit("new")), ["doc_id"])


@query("snk04_cache_write", "WITH c AS (SELECT event_id, user_id, least(greatest(CAST(value * 1000 AS BIGINT), 60), 7776000) AS ttl, length(props) AS size FROM events) SELECT user_id, count(*) AS n, sum(ttl) AS ttl FROM c WHERE size <= 2097152 GROUP BY user_id")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    ttl = F.least(F.greatest(F.round(F.col("value") * 1000).cast("long"), F.lit(60)), F.lit(7776000))
    return table(spark, sf_dir, "events").where(F.char_length("props") <= 2097152).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(ttl).alias("ttl"))


@query("snk06_history_retention", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keep_newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [F.col("ts").desc(), F.col("event_id").desc()], 500).drop("ts")


@query("agg08_status_counts", "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("agg09_graph_status", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(value) AS valued FROM events GROUP BY 1")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count("value").alias("valued"))


@query("agg10_run_metrics", "SELECT user_id, count(*) AS events, count(*) FILTER (WHERE value > 50) AS high, floor(count(*) FILTER (WHERE value > 50) * 1000 / count(*) + 0.5) / 10 AS high_pct FROM events GROUP BY user_id")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, n = F.count_if(F.col("value") > 50), F.count(F.lit(1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("events"), high.alias("high"), (F.floor(high * 1000 / n + 0.5) / 10).alias("high_pct"))


USAGE = Literal("turn long, input long, output long, cost double", ((1, 10, 5, None), (2, None, 7, 0.5), (3, 3, None, None)), more=derived.USAGE)


@query("agg12_usage_totals", f"SELECT sum(input) AS input, sum(output) AS output, sum(cost) AS cost, coalesce(sum(input), 0) + coalesce(sum(output), 0) AS total FROM {USAGE.sql()} u")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return USAGE.df(spark, sf_dir).agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost"), (F.coalesce(F.sum("input"), F.lit(0)) + F.coalesce(F.sum("output"), F.lit(0))).alias("total"))


CHECKS = Literal("run string, required double, terms double, repeated double, spoilers double, numeric_ok double", (("a", 1.0, 0.5, 1.0, 0.0, 0.75), ("b", 1.0, 1.0, 1.0, 1.0, 1.0), ("c", 0.333, 0.25, 0.0, 1.0, 0.5)), more=derived.CHECKS)


@query("agg13_weighted_score", f"SELECT run, floor((0.3 * required + 0.2 * terms + 0.2 * repeated + 0.15 * spoilers + 0.15 * numeric_ok) * 100 + 0.5) AS score FROM {CHECKS.sql()} c")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return CHECKS.df(spark, sf_dir).select("run", round_half_up((0.3 * c("required") + 0.2 * c("terms") + 0.2 * c("repeated") + 0.15 * c("spoilers") + 0.15 * c("numeric_ok")) * 100).alias("score"))


@query("agg14_blind_review", "SELECT lang, count(*) FILTER (WHERE quality = 1 AND doc_id % 2 = 0) AS before_wins, count(*) FILTER (WHERE quality = 1 AND doc_id % 2 = 1) AS after_wins, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS ties, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS unjudged FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t, odd = F.col("quality"), F.col("toxic"), F.col("doc_id") % 2
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.count_if((q == 1) & (odd == 0)).alias("before_wins"), F.count_if((q == 1) & (odd == 1)).alias("after_wins"), F.count_if((q == 0) & (t == 0)).alias("ties"), F.count_if((q == 0) & (t == 1)).alias("unjudged")
    )


@query("agg15_char_totals", "SELECT source, sum(length(text)) AS n_chars, count(*) AS n_segments FROM documents GROUP BY source")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("n_segments"))


@query("agg16_page_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM documents")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 20).alias("pages"))


@query("agg18_source_fingerprint", "WITH b AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg('[' || CAST(doc_id AS VARCHAR) || ',' || sha256(text) || ']', ',' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2), c AS (SELECT source, block // 1000 AS part, sha256(string_agg(h, ',' ORDER BY block)) AS h FROM b GROUP BY 1, 2) SELECT source, sha256(string_agg(h, ',' ORDER BY part)) AS fingerprint FROM c GROUP BY source")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(","), F.sha2("text", 256), F.lit("]"))
    # of blocks of a thousand ids, then of a thousand blocks, then of those: no array holds a source
    joined = lambda order, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(h).alias("x")))), lambda s: s["x"]), ","), 256)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", item.alias("h"))
    blocks = rows.groupBy("source", F.floor(F.col("doc_id") / 1000).alias("block")).agg(joined("doc_id", "h").alias("h"))
    parts = blocks.groupBy("source", F.floor(F.col("block") / 1000).alias("part")).agg(joined("block", "h").alias("h"))
    return parts.groupBy("source").agg(joined("part", "h").alias("fingerprint"))


@query("str04_rate_limit", "SELECT event_id, user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 SECOND, true) AS spaced FROM events")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.coalesce(F.col("ts") - before >= F.expr("INTERVAL 30 SECONDS"), F.lit(True)).alias("spaced"))


@query("str05_single_flight", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type")


@query("ext05_revision_reuse", "SELECT sha256(text) AS fingerprint, min(doc_id) AS revision, max(doc_id) AS last_use, count(*) AS uses FROM documents GROUP BY 1")
def ext05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("revision"), F.max("doc_id").alias("last_use"), F.count(F.lit(1)).alias("uses"))


@query("ext09_run_context", "SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3")
def ext09(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").drop("o_custkey")


@query("ext13_request_metadata", "SELECT conv_id, count(*) AS messages, sum(length(text)) AS n_chars, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
def ext13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.char_length("text")).alias("n_chars"), F.array_join(F.transform(rows, lambda x: x["role"]), ",").alias("roles"))


@query("ext18_alternate_strategy", "SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 2 = 1 THEN 'B' ELSE 'A' END AS strategy FROM orders")
def ext18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(n % 2 == 1, "B").otherwise("A").alias("strategy"))


@query("ext22_relations_first_wins", "SELECT lower(l_returnflag) || '|' || lower(l_linestatus) || '|' || CAST(l_suppkey AS VARCHAR) AS relation, min(l_orderkey) AS first_order, count(*) AS n FROM lineitem GROUP BY 1")
def ext22(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.concat_ws("|", F.lower("l_returnflag"), F.lower("l_linestatus"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(relation.alias("relation")).agg(F.min("l_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))


@query("ext38_list_runs", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5")
def ext38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "orders").where("o_orderstatus != 'F'"), ["o_custkey"], newest(), 5).select("o_custkey", "o_orderkey")
