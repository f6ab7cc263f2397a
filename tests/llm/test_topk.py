import numpy as np
import pandas as pd
import pytest

from loamdex.llm.topk import BallTree, CoarseTree, _reached, top_k, whole_vectors


def brute(rows, k=5):
    good = {i: np.floor(256 * np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % 50 == 0):
        def score(i):
            n = min(len(good[q]), len(good[i]))
            return int(good[q][:n] @ good[i][:n])

        ranked = sorted((-score(i), i) for i in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return out


def run(spark, rows, **sizes):
    vectors = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, shard int"))
    asked = vectors.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v")
    return sorted(tuple(r) for r in top_k(vectors, asked, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"shard": 60, "block": 3}, {"shard": 20, "block": 2, "balls": 4}])
def test_exact_with_ties_and_odd_rows(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], "z", 1) for i in range(220)]
    # equal vectors tie, in numbers beyond k
    rows += [(i, [0.5] * 8, None, None) for i in range(300, 360)]
    rows += [(400, None, "z", 1), (450, [], "z", 1), (500, [float("nan")] * 8, "z", 1), (501, [1.0, None], "z", 1), (502, [float("inf")], "z", 1), (550, [2.0, -1.0], "z", 1), (None, [9.0] * 8, "z", 1)]
    assert run(spark, rows, **sizes) == brute([r[:2] for r in rows])


def test_few_or_no_candidates(spark):
    assert run(spark, [(50, [1.0], "z", 1)]) == []
    assert run(spark, [(50, [1.0], "z", 1), (3, [2.0], "z", 1)]) == [(50, 1, 3, 256 * 512)]
    vectors = whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_k(vectors, vectors.selectExpr("vec_id AS query_id", "v")).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    rows = np.concatenate([np.floor(rng.normal(c, 3, size=(200, 6))) for c in (0, 200, -300)])
    tree = BallTree(np.arange(600), rows, leaf=16)
    for centre, radius, start, end, *_ in tree.nodes:
        q = rng.normal(size=6) * 50
        assert (tree.rows[start:end] @ q <= q @ centre + np.linalg.norm(q) * radius + 1e-6).all()
    scored = []
    plain = tree._score
    tree._score = lambda node, *a: (scored.append(node), plain(node, *a))
    scores, found = np.full((1, 5), -np.inf), np.full((1, 5), np.iinfo(np.int64).max)
    tree.search(np.full((1, 6), 100.0), np.array([-1]), 5, scores, found)
    assert 0 < len(scored) < sum(n[4] < 0 for n in tree.nodes) / 3
    assert scores[0].tolist() == sorted((rows @ np.full(6, 100.0)).tolist(), reverse=True)[:5]


def test_queries_go_only_where_balls_reach():
    """Of clusters far apart, only the balls that may beat what a query has are named, and its own shard never is."""
    rng = np.random.default_rng(6)
    centres = [rng.normal(size=8) * 100 for _ in range(12)]
    balls = pd.DataFrame({"shard": range(12), "centre": centres, "radius": [5.0] * 12})
    asked = pd.DataFrame({"query_id": range(12), "w": centres, "floor": [float(c @ c) - 500 for c in centres], "home": [*range(11), 0], "block": [1] * 12})
    got = _reached(asked, balls)
    want = {(q, s) for q in range(12) for s in range(12) if s != asked.home[q] and centres[q] @ centres[s] + np.linalg.norm(centres[q]) * 5 >= asked.floor[q]}
    assert set(zip(got.query_id, got.shard)) == want and (11, 11) in want and len(want) < 60
    assert len(_reached(asked.assign(floor=np.nan), balls)) == 12 * 11


def test_coarse_cells_are_near_and_even():
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.normal(c, 1, size=(300, 5)) for c in (0, 50, -70, 200)])
    cells = CoarseTree(rows[rng.permutation(1200)[:400]], 4).cell(rows)
    assert len(np.bincount(cells)) == 4 and np.bincount(cells).min() > 200
    # a vector lies in the cell of nearly all of its cluster
    assert all(np.bincount(cells[i : i + 300]).max() > 240 for i in range(0, 1200, 300))
    assert (CoarseTree(np.ones((50, 3)), 8).cell(np.ones((9, 3))) == 0).all()
