import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import neighbours, registry

SCHEMA = "vec_id long, values array<float>, key string, data int, rank int"


def brute(rows, k, is_query=lambda i: i % 20 == 0):
    """Every pair of distinct (id, vector) of one length, summed in order in double precision."""
    good = set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.add((i, tuple(float(x) + 0.0 for x in v)))
    out = []
    for i, v in good:
        if not is_query(i):
            continue
        near = []
        for j, w in good:
            if (j, w) != (i, v) and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w):
                    total += a * b
                near.append((-total, j))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def _got(df):
    return sorted(map(tuple, df.collect()))


def _single(v):
    return [float(np.float32(x)) for x in v]


def test_query_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = _got(registry.op11_block_matrix_join(spark, "/root/testdata/sf0.001"))
    assert got == brute(rows, 20) and len(got) == 20 * 25


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_blocks_change_nothing(spark, block):
    rng = random.Random(block)
    centre = [rng.gauss(0, 1) for _ in range(9)]
    rows = [(i, _single([rng.gauss(0, 1) for _ in range(9)])) for i in range(150)]
    # a third near one point, so that bounds cannot tell them apart, and ties by permuted and repeated vectors
    rows += [(i, _single([c + rng.gauss(0, 1e-4) for c in centre])) for i in range(150, 230)]
    rows += [(i, [1.0, 2.0] + [0.0] * 7 if i % 2 else [2.0, 1.0] + [0.0] * 7) for i in range(230, 260)]
    rows += [(i, [1.0] * 9) for i in range(260, 330)] + rows[:3]
    got = neighbours.nearest(_frame(spark, rows), 5, is_query=F.col("vec_id") % 10 == 0, block=block)
    assert _got(got) == brute(rows, 5, lambda i: i % 10 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [-0.0, -1.0]), (40, [0.0, -1.0]), (1, None), (2, [0.0, -0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (None, [1.0, 1.0])]
    rows += [(7, [3.0, 3.0, 3.0]), (60, [1.0, 1.0, 1.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (80, [1e-45, 0.0]), (81, [3e38, 3e38]), (100, [5.0])]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = _got(neighbours.nearest(_frame(spark, rows), 3, is_query=F.col("vec_id") % 20 == 0))
    assert got == brute(rows, 3)
    assert not any(r[0] == 100 for r in got)  # no other vector of its length
    assert neighbours.nearest(_frame(spark, []), 3).count() == 0
    assert neighbours.nearest(_frame(spark, [(1, [0.0])]), 3).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(_frame(spark, []), 0)


def test_doubles_keep_their_precision(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, values array<double>")
    assert _got(neighbours.nearest(df, 4, is_query=F.col("vec_id") % 20 == 0)) == brute(rows, 4)


def test_hot_class(spark):
    """Copies of one vector, queries among them, are one class; each query still leaves only itself out."""
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(i, [float(i % 7), 1.0]) for i in range(3000, 3050)]
    got = _got(neighbours.nearest(_frame(spark, rows), 20, is_query=F.col("vec_id") % 20 == 0))
    assert got == brute(rows, 20)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    for d in (1, 3, 64, 1500):
        a, b = rng.normal(size=(40, d)), rng.normal(size=(300, d)) * rng.uniform(1e-3, 1e3, (300, 1))
        a[0] = 0.0
        a[0, 0] = 1e-300
        low, high = neighbours.bounds(neighbours.codes(a), neighbours.codes(b))
        exact = np.array([[math.fsum(x * y) for y in b] for x in a])
        assert (low <= exact).all() and (exact <= high).all()
    # at 64 components the bounds leave few pairs beside the nearest
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(5000, 64))
    low, high = neighbours.bounds(neighbours.codes(a), neighbours.codes(b))
    cut = np.partition(low, 5000 - 21, axis=1)[:, 5000 - 21]
    assert (high >= cut[:, None]).sum() / 50 < 60


def test_products_are_exact():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-127, 128, (5, 3000)).astype(np.int8), np.full((4, 3000), 127, np.int8)
    a[0] = 127
    assert (neighbours.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
