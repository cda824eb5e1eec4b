"""Entities merged by names and kinds against the rule applied row by row."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from textloom.operators import entities
from textloom.plans import entities as plans

SCHEMA = "book long, at long, kind string, name string, other array<string>, record string"


def key(name: str | None) -> str:
    return re.sub(r"[\s._'’-]+", " ", (name or "").lower()).strip()


def plain(rows: list[tuple], most: int = 8) -> tuple[list[int], dict[int, tuple]]:
    """Records in a list, searched whole for each (kind, source, aliases); members are held by row numbers."""
    records: list[dict] = []
    for number, (kind, source, aliases) in enumerate(rows, 1):
        kind, source, aliases = kind or "other", key(source), list(dict.fromkeys(key(a) for a in aliases or [] if key(a)))
        new = {"kind": kind, "source": source, "aliases": aliases, "members": [number]}
        fits = [r for r in records if ({r["source"], *r["aliases"]} & {source, *aliases}) - {""} and (r["kind"] == kind or "other" in (r["kind"], kind))]
        if not fits:
            records.append(new)
            continue
        first = fits[0]
        for more in [*fits[1:], new]:
            pool = [*first["aliases"], *more["aliases"], more["source"]]
            first["aliases"] = [a for a in dict.fromkeys(pool) if a and a != first["source"]][:most]
            first["members"] += more["members"]
        records = [r for r in records if not any(r is f for f in fits[1:])]
    of = {m: r["members"][0] for r in records for m in r["members"]}
    return [of[i] for i in sorted(of)], {r["members"][0]: (r["kind"], r["source"], r["aliases"], len(r["members"])) for r in records}


def check(rows: list, found: tuple, by: str) -> None:
    """``rows`` (scope, position, kind, source, aliases) against the rows and records found."""
    scopes = defaultdict(list)
    for scope, at, kind, source, aliases in rows:
        scopes[scope].append((at, key(source), kind or "other", list(dict.fromkeys(key(a) for a in aliases or [] if key(a)))))
    got_rows, got_records = defaultdict(dict), defaultdict(dict)
    for r in found[0].collect():
        got_rows[r[by]][r.number] = r.record
    for r in found[1].collect():
        got_records[r[by]][r.record] = (r.kind, r.source, list(r.aliases), r.members)
    assert set(got_rows) == set(scopes)
    for scope, held in scopes.items():
        of, records = plain([(k, s, a) for _, s, k, a in sorted(held)])
        assert [got_rows[scope][i] for i in sorted(got_rows[scope])] == of
        assert got_records[scope] == records


def cases(books: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    names = ["Anna", "anna", "Anna K.", "Bob", "O'Neil", "o neil", "Rat", "King Rat", "Paris", "Rue", "  ", None, *"abcdefghijkl"]
    rows = []
    for b in range(books):
        for at in range(rng.randrange(1, 60)):
            kind = rng.choice(["person", "person", "place", "other", None])
            rows.append((b, at, kind, rng.choice(names), rng.choice([None, [], rng.choices(names, k=rng.randrange(4))]), "clash"))
    return rows


def test_equals_the_rule_on_random_cases(spark):
    rows = cases(60, 5)
    found = entities.merged(spark.createDataFrame(rows, SCHEMA), ["book"], "at", "kind", "name", "other")
    check([r[:5] for r in rows], found, "book")


def test_other_bridges_and_the_order_decides(spark):
    rows = [(1, 1, "person", "A", []), (1, 2, "place", "A", []), (1, 3, "other", "A", []), (1, 4, "place", "A", []), (2, 1, "other", "A", []), (2, 2, "place", "A", []), (2, 3, "person", "A", [])]
    found = entities.merged(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), ["book"], "at", "kind", "name", "other")[0]
    got = {(r.book, r.position): r.record for r in found.collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (2, 1): 1, (2, 2): 1, (2, 3): 1}


def test_components_cut_a_scope_without_changing_it(spark):
    rows = [(0, i, *r[2:]) for i, r in enumerate(cases(12, 9))]
    table = spark.createDataFrame([(*r[:3], f"{r[3]}{r[1] % 7}" if r[3] else None, [f"{x}{r[1] % 7}" for x in r[4] or [] if x and x.strip()], r[5]) for r in rows], SCHEMA)
    whole = entities.merged(table, ["book"], "at", "kind", "name", "other")[0].select("position", "record")
    cut = entities.merged(entities.with_components(table, "at", "name", "other"), ["component"], "at", "kind", "name", "other")[0]
    first = cut.where("number = record").select("component", "record", F.col("position").alias("first"))
    got = {r.position: r["first"] for r in cut.join(first, ["component", "record"]).collect()}
    assert got == {r.position: r.record - 1 for r in whole.collect()}
    assert cut.select("component").distinct().count() > 1


def test_null_scopes_ties_and_empty_tables(spark):
    tie = [(None, 1, "person", "A", None, "r"), (None, 1, "place", "A", None, "r"), (None, 1, "person", "A", None, "r"), (None, None, None, None, None, None)]
    check([r[:5] if r[1] is not None else (None, -1, *r[2:5]) for r in tie], entities.merged(spark.createDataFrame(tie, SCHEMA), ["book"], "at", "kind", "name", "other"), "book")
    assert all(part.count() == 0 for part in entities.merged(spark.createDataFrame([], SCHEMA), ["book"], "at", "kind", "name", "other"))


def test_query_equals_the_rule(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in plans.document_entities(spark, folder).collect()]
    assert {r[2] for r in rows} == {"person", "place", "other"}
    check(rows, (plans.records_of_rows(spark, folder), plans.kind_records(spark, folder)), "doc_id")
