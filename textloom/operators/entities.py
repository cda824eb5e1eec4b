"""Entities merged by shared names where kinds must agree.

Rows are taken in order.  A row joins every earlier record of its scope that shares a name with it and whose kind is the same, or where either kind is
``other``; the earliest of those records takes the names of the rest, and its source and kind stay.  Since ``other`` agrees with all, the result depends on the
order: rows of one kind may stay apart although each shares a name with a row of kind ``other``, so components of shared names would be wrong.

A scope is dealt to one partition and read there as a sorted stream, of which the open records are held: a source and ``most_aliases`` names each, beside a
number for every record that another took.  Where no column scopes the rows, ``with_components`` gives one: rows that share no name, not even by others, never meet.

Edge cases: null kinds are ``other``; null and blank names are none, and a row without any is a record; rows of one place in order go by their source, kind and
aliases, so that equal inputs give equal records; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import graph
from textloom.operators.packing import group_keys, in_order

c = F.col
OTHER = "other"
#: Other names that a merged record keeps.
MOST_ALIASES = 8


def name_key(name: Column) -> Column:
    """In lower case, white space and the marks within names as one space."""
    return F.btrim(F.regexp_replace(F.lower(name), r"[\s._'’-]+", " "))


def keyed(rows: DataFrame, scope: list[str], position: str, kind: str, source: str, aliases: str) -> DataFrame:
    """(scope, position, kind, source, aliases) with the keys of the names."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), name_key), lambda n: n.isNotNull() & (n != "")))
    return rows.select(*scope, c(position).alias("position"), F.coalesce(kind, F.lit(OTHER)).alias("kind"), F.coalesce(name_key(c(source)), F.lit("")).alias("source"), names.alias("aliases"))


def with_components(rows: DataFrame, position: str, source: str, aliases: str) -> DataFrame:
    """``rows`` with ``component``, the smallest position of those that share names with it, directly or by others.

    Positions are of one row each."""
    named = rows.select(c(position).alias("node"), F.array_compact(F.transform(F.array_append(F.coalesce(aliases, F.array().cast("array<string>")), c(source)), name_key)).alias("names"))
    found = graph.shared_name_components(named.withColumn("names", F.filter("names", lambda n: n != "")))
    return rows.join(found.select(c("node").alias(position), "component"), position)


class _Scope:
    """The open records of a scope: source, kind and names of each by the number of its first row."""

    def __init__(self, most: int):
        self.most, self.seen = most, 0
        self.records: dict[int, tuple[str, str, list[str], int]] = {}
        self.holders: dict[str, set[int]] = {}
        self.taken_by: dict[int, int] = {}

    def take(self, kind: str, source: str, aliases: list[str]) -> tuple[int, int]:
        self.seen += 1
        names = {n for n in (source, *aliases) if n}
        near = sorted(r for r in set().union(*(self.holders.get(n, ()) for n in names)) if OTHER in (kind, self.records[r][1]) or self.records[r][1] == kind)
        if not near:
            self._hold(self.seen, (source, kind, aliases, 1))
            return self.seen, self.seen
        parts = [self._release(r) for r in near]
        first = parts[0]
        gained = [n for s, _, more, _ in [*parts[1:], (source, kind, aliases, 1)] for n in (*more, s)]
        kept = [n for n in dict.fromkeys([*first[2], *gained]) if n and n != first[0]][: self.most]
        self._hold(near[0], (first[0], first[1], kept, sum(p[3] for p in parts) + 1))
        self.taken_by.update(dict.fromkeys(near[1:], near[0]))
        return self.seen, near[0]

    def _hold(self, number: int, record: tuple[str, str, list[str], int]) -> None:
        self.records[number] = record
        for n in {record[0], *record[2]} - {""}:
            self.holders.setdefault(n, set()).add(number)

    def _release(self, number: int) -> tuple[str, str, list[str], int]:
        record = self.records.pop(number)
        for n in {record[0], *record[2]} - {""}:
            self.holders[n].discard(number)
            if not self.holders[n]:
                del self.holders[n]
        return record

    def closed(self) -> Iterator[tuple]:
        """The records, and which record holds at the end what another took."""
        for number, (source, kind, aliases, members) in self.records.items():
            yield "record", None, number, number, kind, source, aliases, members
        final: dict[int, int] = {}
        # a record is taken by an earlier one, whose own end is known first
        for number in sorted(self.taken_by):
            by = self.taken_by[number]
            final[number] = final.get(by, by)
            yield "moved", None, number, final[number], None, None, None, None


FOUND = "what string, position long, number long, record long, kind string, source string, aliases array<string>, members long"


def _pass(rows: DataFrame, scope: list[str], most: int) -> DataFrame:
    names = [f.split()[0] for f in FOUND.split(", ")]
    ordered = in_order(rows, scope, ["position", "source", "kind", "aliases"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_scope = None, None
        for frame in frames:
            out = []
            for own, position, kind, source, aliases in zip(group_keys(frame, scope), frame["position"], frame["kind"], frame["source"], frame["aliases"], strict=True):
                if own != key or open_scope is None:
                    if open_scope is not None:
                        out += [(*key, *x) for x in open_scope.closed()]
                    key, open_scope = own, _Scope(most)
                number, record = open_scope.take(kind, source, list(aliases))
                out.append((*own, "row", position, number, record, kind, source, None, None))
            yield _frame(out)
        if open_scope is not None:
            yield _frame([(*key, *x) for x in open_scope.closed()])

    def _frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=[*scope, *names])
        return made.astype({x: "Int64" for x in ("position", "number", "record", "members")})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*scope).schema.fields)
    return ordered.mapInPandas(read, f"{types}, {FOUND}")


def merged(rows: DataFrame, scope: list[str], position: str, kind: str, source: str, aliases: str, most_aliases: int = MOST_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(scope, position, number, record) of each row, numbered in order within its scope, with the number of its record's first row; and
    (scope, record, kind, source, aliases, members) of the records.  Names are keys."""
    found = _pass(keyed(rows, scope, position, kind, source, aliases), scope, most_aliases)
    moved = found.where("what = 'moved'").select(*[c(s).alias(f"_{s}") for s in scope], c("number").alias("_was"), c("record").alias("_now"))
    same = c("record") == c("_was")
    for s in scope:
        same = same & c(s).eqNullSafe(c(f"_{s}"))
    placed = found.where("what = 'row'").join(moved, same, "left").select(*scope, "position", "number", F.coalesce("_now", "record").alias("record"))
    return placed, found.where("what = 'record'").select(*scope, "record", "kind", "source", "aliases", "members")
