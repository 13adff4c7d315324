import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finscan.llm import pivot_topk as P

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k, divisor):
    good = [(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in sorted(good):
        if i % divisor == 0:
            queries.setdefault(i, v)
    for i, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, divisor=5, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in P.top_k(df, F.col("vec_id") % divisor == 0, k=k, **options).collect())


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_equals_brute_force(spark, dim):
    rng = random.Random(dim)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(dim)]) for i in range(120)]
    rows += rows[:3] + [(10, [9.0] * dim)]  # repeated rows, and one id with two vectors
    assert run(spark, rows, query_block=7, pivots=4) == brute(rows, 5, 5)


def test_unusable_rows_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [3.0, 1.0]), (10, None)]
    assert run(spark, rows) == brute(rows, 5, 5) == [(0, 1, 7, 327680)]


def test_ties_few_candidates_and_empty(spark):
    rows = [(i, [1.0, 1.0]) for i in range(8)]
    assert [r[2] for r in run(spark, rows) if r[0] == 5] == [0, 1, 2, 3, 4]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2.0**18 * (i + 1)), float(-(2.0**17) * i)]) for i in range(12)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_parts_and_blocks(spark):
    """Many blocks by many parts of the stored table give what one of each gives."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    want = brute(rows, 5, 5)
    for block, part in ((3, 1), (50, 4000), (1000, 1 << 30)):
        assert run(spark, rows, query_block=block, part_bytes=part) == want


def test_bounds_spare_candidates():
    """On clustered vectors most candidates are cut by the pivots, and the result is the exact one."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (20, 16))
    c = np.round(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 4, (4000, 16))).astype(np.int64)
    ids = np.arange(4000)
    top = float((c.astype(float) ** 2).sum(1).max())
    at = P.choose_pivots(c[:512], 32)
    block = P._Block(ids[:10], c[:10], ids[at], c[at], top, 5)
    best = ([np.zeros(0, np.int64)] * 10, [np.zeros(0, np.int64)] * 10, block.first.copy())
    looked = []
    scores = P._scores
    try:
        P._scores = lambda q, x: looked.append(len(x)) or scores(q, x)
        P._search(block, ids, c, P._distances(P._lift(c[at], top), P._lift(c, top)), best, 5)
    finally:
        P._scores = scores
    for i in range(10):
        s = c @ c[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        assert best[0][i].tolist() == order
    assert sum(looked) < 0.5 * 10 * 4000
