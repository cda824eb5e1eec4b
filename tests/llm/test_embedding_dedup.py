from __future__ import annotations

import numpy as np

from textloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def near(rng, x, c):
    r = rng.normal(size=x.shape)
    r -= (r @ x) * x
    return c * x + np.sqrt(1 - c * c) * r / np.linalg.norm(r)


def brute(ids, vectors, labels, threshold=0.93):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (x @ x.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(ids))
    while True:
        low = np.where(linked | np.eye(len(ids), dtype=bool), root[None, :], len(ids)).min(axis=1)
        if (low == root).all():
            return linked.sum(axis=1), ids[root]
        root = low


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = {c: np.array([near(rng, v, c) for v in x[:200]]) for c in (0.935, 0.95, 0.98)}
    hot = np.array([near(rng, x[0], 0.985) for _ in range(300)] + [x[1]] * 40)
    vectors = np.vstack([x, *pairs.values(), hot]).astype(np.float32).astype(np.float64)
    labels = np.r_[np.arange(700) % 2, *[np.arange(200) % 2] * 3, np.zeros(300, int), np.ones(40, int)]
    ids = np.arange(len(vectors))
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, vectors, labels, strict=True)], SCHEMA)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    links, roots = brute(ids, vectors, labels)
    mine = np.array([got[i].n_links for i in ids])
    assert (mine <= links).all()
    assert mine.sum() >= 0.97 * links.sum()
    assert mine[700:900].sum() >= 0.9 * links[700:900].sum()  # at the threshold
    assert np.mean([got[i].component_id == c for i, c in zip(ids, roots, strict=True)]) > 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [], 0), (10, [1.0, 0.0], None),
        (11, [1.0, 0.0, 0.0], 0), (12, [0.93, 0.3675], 0), (12, [0.93, 0.3675], 0), (None, [1.0, 0.0], 0),
    ]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows)
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False)
    assert by[12] == (3, 1, False) and sum(g[0] == 12 for g in got) == 2
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert by[None] == (0, None, False)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_that_repeat_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    x = [rng.normal(size=16) for _ in range(3)]
    rows = [(1, x[0].tolist(), 0), (2, near(rng, x[0] / np.linalg.norm(x[0]), 0.99).tolist(), 0), (1, x[1].tolist(), 0), (3, near(rng, x[1] / np.linalg.norm(x[1]), 0.99).tolist(), 0), (4, x[2].tolist(), 0)]
    names = ["_g", "_e1", "g", "node", "n_links", "row", "vec"]
    df = spark.createDataFrame([(*r, *range(7)) for r in rows], SCHEMA + "".join(f", {c} int" for c in names))
    got = embedding_dedup.near_vectors(df)
    assert got.columns == ["vec_id", "embedding", "label", "_g", "_e1", "g", "node", "row", "vec", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_the_order_of_points_decides():
    orders = [bytes([1, 2, 3, 4, 5, 6]), bytes([1, 2, 3, 7, 8, 9]), bytes([7, 8, 9, 3, 2, 1]), bytes([6, 5, 4, 3, 2, 1])]
    found = embedding_dedup.candidate_pairs(orders, 3, 3, 7)
    assert found[0, 1] and not found[0, 2]  # the same three points, near the front or not
    assert found[1, 2]  # all six, in another order
    assert not embedding_dedup.candidate_pairs(orders, 6, 3, 7)[0, 3]  # shares smaller points than this list's


def test_small_blocks_change_nothing(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=16)
    rows = [(i, near(rng, x / np.linalg.norm(x), 0.97).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert embedding_dedup.near_vectors(df, block=4).exceptAll(embedding_dedup.near_vectors(df)).count() == 0
