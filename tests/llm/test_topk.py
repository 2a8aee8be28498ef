import math

import numpy as np
import pytest

from plumbline.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int, block string, score string"


def brute(rows, k=20):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(u, v)), c) for b, (c, v) in enumerate(good) if b != a)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=20):
    vectors = topk.quantised(spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], VECTORS))
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)


def test_random_vectors_over_several_blocks(spark, small_blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_one_task_share_the_score_to_beat(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 0.2, 12) * (4 if i % 50 == 0 else 1)).tolist()) for i in range(900)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_clusters_and_ties(spark, small_blocks):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.3, (6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.02, 16)).tolist()) for i in range(240)] + [(1000 + i, centres[0].tolist()) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.25]), (None, [1.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (4, [None, 1.0]), (5, [-0.01, 0.0]), (6, [1.0]), (7, []), (8, [0.1, 0.2, 0.3]), (9, [1e30, 0.0])]
    assert run(spark, rows[:-1]) == brute(rows[:-1])
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, rows)


def test_large_components_and_repeated_rows_take_part(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(topk, "BLOCKS_HELD", 2)
    rng = np.random.default_rng(4)
    rows = [(i % 90, (rng.normal(0, 0.2, 8) * (1 << (i % 24 if i % 7 == 0 else 0))).tolist()) for i in range(200)]
    rows += [(5, [2.0**22, 0.0, -(2.0**23)]), (20, [2.0**22, 1.0]), (20, [2.0**22, 1.0]), (40, [0.0] * 8)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(20, [2.0**40]), (1, [2.0**40])])


def test_processing_stops_on_proof_and_stays_exact():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-3, 4, (500, 32))
    matrix[:25] *= 20  # a few vectors stand out
    queries = matrix[:5].copy()
    ids = np.arange(500)
    q, v, s, share = topk.best(ids, matrix, topk.postings(matrix), ids[:5], queries, 4)
    assert share < 1
    for k in range(5):
        order = sorted(((-int(matrix[c] @ queries[k]), c) for c in range(500) if c != k))[:4]
        assert sorted((-int(x), int(c)) for a, c, x in zip(q, v, s) if a == k) == order
