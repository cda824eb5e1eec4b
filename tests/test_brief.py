"""What a batch may know of a book's memory, against each batch judged by itself."""

from __future__ import annotations

import random

from textloom.operators import brief

SEGMENTS, MENTIONS = "book string, batch long, ordinal long, text string", "book string, batch long, ordinal long, name string"
FACTS, ALIASES, EVIDENCE = "book string, name string, confirmed boolean", "book string, name string, alias string", "book string, name string, batch long"


def state(batch: int, name: str, sure: bool, others: set[str], stands: dict[str, set[int]], proof: set[int]) -> str:
    before = lambda x: any(b < batch for b in stands.get(x, ()))
    here = lambda x: batch in stands.get(x, ())
    if not sure and not all(before(x) or here(x) for x in others):
        return "excluded_alias"
    if not (before(name) or sure and (here(name) or any(map(here, others)))):
        return "excluded_name"
    return "visible" if sure or any(b < batch for b in proof) else "excluded_evidence"


def plain(segments: list, mentions: list, facts: list, aliases: list, evidence: list, budget: int) -> dict:
    out = {}
    for book, batch in {(s[0], s[1]) for s in segments}:
        held = sorted({f[1] for f in facts if f[0] == book})
        stands: dict[str, set[int]] = {}
        for m in mentions:
            if m[0] == book:
                stands.setdefault(m[3], set()).add(m[1])
        counts, found = dict.fromkeys(brief.STATES, 0), []
        for name in held:
            sure = any(f[2] for f in facts if f[:2] == (book, name))
            others = {a[2] for a in aliases if a[:2] == (book, name)}
            s = state(batch, name, sure, others, stands, {e[2] for e in evidence if e[:2] == (book, name)})
            counts[s] += 1
            uses = lambda x: len({m[2] for m in mentions if m[0] == book and m[1] == batch and m[3] == x})
            score = 4 * uses(name) + sum(2 * uses(o) for o in others)
            if s == "visible" and score:
                near = sorted(o for o in others if uses(o))
                found.append((-score, name, name + (f" ({', '.join(near)})" if near else "")))
        total, entries = 0, []
        for _, _, entry in sorted(found):
            total += -(-len(entry) // 4)
            if total > budget:
                break
            entries.append(entry)
        where = [s[2] for s in segments if s[:2] == (book, batch)]
        out[book, batch] = (len(where), min(where), max(where), *counts.values(), len(found), len(entries), sum(-(-len(e) // 4) for e in entries), "; ".join(entries))
    return out


def tables(seed: int, books: int = 6) -> tuple[list, ...]:
    rng = random.Random(seed)
    names = [f"N{i}" for i in range(9)] + ["Long Name", "Never"]
    segments, mentions = [], []
    for b in range(books):
        for ordinal in range(rng.randrange(1, 40)):
            batch = ordinal // 4 + 1
            segments.append((f"b{b}", batch, ordinal, "t"))
            mentions += [(f"b{b}", batch, ordinal, n) for n in rng.choices(names[:-1], k=rng.randrange(4))]
    facts = [(f"b{b}", n, rng.random() < 0.3) for b in range(books) for n in names if rng.random() < 0.7]
    aliases = [(*f[:2], n) for f in facts for n in rng.sample(names, rng.randrange(3)) if n != f[1]]
    evidence = [(*f[:2], rng.randrange(1, 10)) for f in facts for _ in range(rng.randrange(3))]
    return segments, mentions, facts, aliases, evidence


def found(spark, parts: tuple[list, ...], budget: int) -> dict:
    made = [spark.createDataFrame(rows, schema) for rows, schema in zip(parts, (SEGMENTS, MENTIONS, FACTS, ALIASES, EVIDENCE), strict=True)]
    return {(r[0], r[1]): tuple(r[2:]) for r in brief.briefs(*made, budget).collect()}


def test_each_batch_knows_what_it_may(spark):
    parts = tables(4)
    expected = plain(*parts, budget=7)
    assert found(spark, parts, 7) == expected
    for place in range(3, 7):
        assert any(row[place] for row in expected.values())
    assert any(row[7] > row[8] for row in expected.values())


def test_repeats_nulls_and_empty_tables(spark):
    segments, mentions, facts, aliases, evidence = tables(8, 2)
    nulls = (mentions + mentions[:5] + [("b0", 1, 0, None), (None, 1, 0, "N1")], facts + facts[:2] + [("b0", None, True)], aliases + aliases[:2] + [("b0", None, "N1")], evidence + evidence[:3] + [(None, "N1", 1)])
    assert found(spark, (segments, *nulls), 50) == plain(segments, mentions, facts, aliases, evidence, 50)
    assert found(spark, ([], [], [], [], []), 50) == {}
    assert all(v[3:] == (0, 0, 0, 0, 0, 0, 0, "") for v in found(spark, (segments, [], [], [], []), 50).values())
