from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from tests.llm.util import SCHEMA, documents, folder
from tests.oracle import assert_same, connection
from textloom.llm import line_dedup
from textloom.llm.registry import oracle_sql, queries

EDGE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(EDGE))


def brute(rows, least=20, docs=3):
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(-(2**63) if i is None else i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in lines if keeper.get(key(x), own) == own]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_against_brute_force(spark):
    rows = documents()
    got = Counter(tuple(r) for r in line_dedup.op1_line_dedup(spark, folder(spark, rows)).collect())
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_batches_and_fanout_change_nothing(spark):
    rows = spark.createDataFrame(documents(60, 3), SCHEMA)
    one = line_dedup.dedup_lines(rows, batches=1)
    for batches, fanout in ((3, 2), (7, 3)):
        assert one.exceptAll(line_dedup.dedup_lines(rows, batches=batches, fanout=fanout)).count() == 0


def test_empty_table_and_other_columns(spark):
    assert line_dedup.op1_line_dedup(spark, folder(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, "x", 5, "k")], "doc_id long, text string, pos int, k1 string")
    assert line_dedup.dedup_lines(rows).select("row.*").columns == ["doc_id", "text", "pos", "k1"]


def test_against_sql(spark):
    where = "/root/testdata/sf0.001"
    assert assert_same(queries()["op1_line_dedup"](spark, where), oracle_sql()["op1_line_dedup"], connection(where)) == 200


def test_each_key_stands_in_one_run(spark):
    rows = spark.createDataFrame(documents(60, 3), SCHEMA)
    found = line_dedup.occurrences(rows, "doc_id", "text", 20)
    distinct = found.select("k1", "k2").distinct().count()
    for batches, fanout in ((4, 2), (5, 10)):
        store = line_dedup.build_runs(found, batches, fanout)
        held = [spark.table(r).select("k1", "k2") for r in store.runs()]
        assert sum(t.count() for t in held) == distinct
        assert sum(spark.table(c).count() for c in store.counts) > 0
        docs = sum(spark.table(t).agg({"docs": "sum"}).first()[0] for t in [*store.runs(), *store.counts])
        assert docs == found.select("k1", "k2", "did").distinct().count()
        plan = spark.table(store.runs()[0]).join(spark.table(store.runs()[-1]).hint("merge"), ["k1", "k2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        store.clear()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_nulls_repeats_and_a_long_text(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (None, line), (None, line + "\n" + line), (1, line), (1, "x"), (2, None), (3, "\n".join([line] * 50_000)), (3, line), (-(2**63) + 1, " " + line.upper())]
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    got = Counter(tuple(r) for r in line_dedup.op1_line_dedup(spark, folder(spark, rows)).collect())
    assert got == brute(rows)
