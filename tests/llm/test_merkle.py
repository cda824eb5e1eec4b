"""The Merkle manifest against plain Python, over edge cases and more than one tier."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import SCHEMA, documents, folder
from textloom.llm import merkle


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row) -> str:
    i, text, lang, source, n = row
    return h(field(i), field(source), field(lang), field(n), field(text))


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each node its (side, sibling) by level ('-' without one)."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, own in enumerate(members):
            j = i ^ 1
            found = ("-", "") if j >= len(nodes) else ("L" if j < i else "R", nodes[j])
            for m in own:
                paths[m].append(found)
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        members = [sum(members[i : i + 2], []) for i in range(0, len(members), 2)]
    return nodes[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *plain_tree([leaf(r) for r in own]))
    root, upper = plain_tree([trees[x][1] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            path = path + upper[k]
            marked = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            cur = leaf((*r[:4], r[4] + 1)) if marked else leaf(r)
            for side, sibling in path:
                cur = h(sibling, cur) if side == "L" else h(cur, sibling)
            out.append((r[0], leaf(r), subroot, root, h(*[s for _, s in path]), cur, cur == root))
    return sorted(out, key=repr)


def found(spark, rows: list[tuple]) -> list[tuple]:
    df = merkle.op11_manifest(spark, folder(spark, rows, schema=SCHEMA))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_cases(spark):
    rows = [*documents(60), (-5, "x", "", "s", None), (0, "lone", "xx", None, 4), (7**5, "😀" * 3000, "en", "é", 3000), (None, None, None, None, None)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {True, False} == {r[-1] for r in got}


def test_more_than_one_tier(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20_000), f"t{i % 7000}", "en" if i % 13 else "de", "s", i % 5) for i in range(9000)]
    assert max(sum(r[2] == x for r in rows) for x in ("en", "de")) > 2**merkle.HEIGHT
    assert found(spark, rows) == brute(rows)


def test_copies_of_one_row(spark):
    rows = [(1, "same", "en", "s", 4)] * 50 + [(2, "other", "en", "s", 5)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    one = [(3, "a", None, None, 1)]
    assert found(spark, one) == brute(one)
    assert found(spark, one)[0][1] == found(spark, one)[0][3]


def test_columns_of_clashing_names(spark):
    rows = documents(20)
    names = ["grp", "idx", "n", "digest", "block", "part"]
    df = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], SCHEMA + "".join(f", {x} int" for x in names))
    got = merkle.manifest(df, merkle.COLUMNS, "lang", "doc_id").collect()
    roots = {r[3] for r in brute(rows)}
    assert len(got) == len(rows) and {bytes(r["folded"]).hex() for r in got} == roots


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 3))
def test_fractal_traversal(n, more):
    nodes = [h(str(i)).encode() for i in range(n)]
    levels = (n - 1).bit_length() + more
    rows, want = [list(nodes)], []
    for _ in range(levels):
        rows.append([merkle.node(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    for i in range(n):
        want.append([rows[k][j] if (j := (i >> k) ^ 1) < len(rows[k]) else None for k in range(levels)])
    assert list(merkle.traverse(nodes, levels)) == want


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097])
def test_levels(n):
    assert merkle.levels_in_block(n) == min(12, sum(1 << k < n for k in range(40)))
