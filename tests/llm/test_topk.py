import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.llm import topk


def brute(rows, k, every):
    usable = [(n, i, [math.floor(64 * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, a in usable:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for m, c, b in usable if m != n and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, every=4, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, k, **sizes).collect())


def vectors(n, seed, dim=8, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (5, dim))
    return [(i, (centres[i % 5] + spread * r.normal(0, 1, dim)).astype("f4").tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(300, 1) + [(300, [0.5] * 8), (301, [0.5] * 8), (302, [0.5] * 8)]
    assert run(spark, rows) == brute(rows, 5, 4)
    assert run(spark, rows, 7, 4, block_rows=40, group_rows=20, sample=30, pivots=4) == brute(rows, 7, 4)


def test_nulls_repeats_ties_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, None), (8, [None, 1.0]), (12, [float("nan"), 1.0]), (16, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [1.0]), (24, []), (7, [2.0, 1.0]), (3, [2.0, 1.0]), (-4, [-1.0, 0.25])]
    assert run(spark, rows) == brute(rows, 5, 4)
    assert run(spark, []) == []


def test_large_finite_components_take_part(spark):
    rows = [(0, [1e16, 1.0]), (4, [0.001, 2.0]), (1, [-1e16, 3.0]), (2, [1.0, 1.0])]
    rows = [(i, np.array(v, "f4").tolist()) for i, v in rows]
    small = [(i, v) for i, v in rows if i != 0] + [(3, rows[0][1])]
    assert run(spark, small) == brute(small, 5, 4)
    with pytest.raises(Exception, match="beyond the range"):
        run(spark, [(0, [1e16, 1.0]), (4, [1e16, 2.0])])


def test_many_copies(spark):
    rows = [(i, [0.1, 0.2, 0.3]) for i in range(2000)]
    assert run(spark, rows, 3, 500, block_rows=300) == brute(rows, 3, 500)


def test_elimination_stops_early_and_is_exact():
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(-3, 4, (4000, 16)), r.integers(40, 60, (300, 16))])
    ids = np.arange(len(v))
    pivots = topk.choose_pivots(v, 8)
    table = topk.PivotTable(ids, ids, v, pivots)
    q = v[-5:]
    for i, (best, done) in enumerate(table.top(ids[-5:], q, 10, np.full(5, -np.inf))):
        score = v @ q[i]
        want = sorted((-s, c) for c, s in enumerate(score.tolist()) if c != ids[-5 + i])[:10]
        assert best == [(-s, c) for s, c in want]
        assert done < 600


def test_large_numbers_stay_exact():
    v = np.array([[10**9, 3], [10**9, 4]], float)
    assert topk.dot(v, np.array([10**9, 1])).tolist() == [10**18 + 3, 10**18 + 4]
