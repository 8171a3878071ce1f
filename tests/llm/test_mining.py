"""Hard negatives by the index of vantage-point trees against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import mining


def plainly(rows, anchors, positives=5, k=3, low=50, high=95):
    one = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        one.setdefault(i, (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a in filter(anchors, one):
        label, v = one[a]
        scored = sorted((-dot(v, w), i) for i, (_, w) in one.items() if i != a)
        for p, i in [x for x in scored if one[x[1]][0] == label][:positives]:
            found = [x for x in scored if one[x[1]][0] != label and low * -p <= 100 * -x[0] <= high * -p][:k]
            out |= {(a, i, n, j, -p, -s) for n, (s, j) in enumerate(found, 1)}
    return out


def vectors(seed, n, dims, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims)) * spread
    return [np.floor(40 * (centres[k % 6] + rnd.normal(size=dims))).astype(int).tolist() for k in range(n)]


@pytest.mark.parametrize(("dims", "spread"), [(3, 3), (16, 1), (1, 2)])
def test_equals_all_scores(spark, dims, spread):
    rnd = random.Random(dims)
    rows = [(k, rnd.randint(0, 3), v) for k, v in enumerate(vectors(dims, 900, dims, spread))]
    rows += [(900 + k, rnd.randint(0, 3), rows[7][2]) for k in range(300)]  # one vector holds a quarter: ties by id
    rows += [(1300 + k, 9, [0] * dims) for k in range(5)] + [(3, 0, [1] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vec array<bigint>").repartition(5)
    small = dict(sample_rows=200, most_leaves=8, block_rows=100, leaf_rows=16)
    got = [tuple(r) for r in mining.hard_negatives(df, F.col("vec_id") % 20 == 0, **small).collect()]
    want = plainly(rows, lambda i: i % 20 == 0)
    assert len(got) == len(set(got)) and set(got) == want
    assert want


def test_bounds_rule_out_most_leaves_of_clustered_rows():
    x = np.array(vectors(1, 4000, 8, 20), float)
    top = float((x * x).sum(1).max())
    tree, leaves = mining.grown(x, top, 64)
    assert sorted(np.concatenate(leaves)) == list(range(4000)) and max(map(len, leaves)) <= 64
    q = x[5]
    span = float((q * q).sum() + top)
    best = sorted((x @ q).tolist())[-10]
    seen = list(mining.nearest_first(tree, q, span, 0.0, math.sqrt(span - 2 * best)))
    assert len(seen) < len(leaves) / 2 and [d for d, _ in seen] == sorted(d for d, _ in seen)
    least, most = tree.bounds(q, span)
    d = np.sqrt(np.maximum(span - 2 * (x @ q), 0))
    assert all(least[n] <= d[at].min() + 1e-6 and most[n] >= d[at].max() - 1e-6 for n, at in enumerate(leaves))


def test_large_numbers_stay_exact(spark):
    rows = [(k, k % 2, [2**30 + k, -(2**30) + 3 * k, k]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vec array<bigint>")
    got = {tuple(r) for r in mining.hard_negatives(df, F.col("vec_id") % 20 == 0, low=0, high=100, block_rows=20, leaf_rows=8).collect()}
    assert got == plainly(rows, lambda i: i % 20 == 0, low=0, high=100)


def test_rows_that_take_no_part_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.1]), (1, 1, [0.5, 0.2]), (2, 2, [0.3, 0.1]), (3, None, [0.4, 0.1]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (None, 2, [0.4, 0.1]), (9, 2, []), (10, 2, [0.3])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rank", F.lit("clash"))
    q = mining.quantised(df, "embedding")
    got = sorted(map(tuple, mining.hard_negatives(q, F.col("vec_id") % 50 == 0).collect()))
    a, b = [128, 25], [128, 51]
    p = sum(x * y for x, y in zip(a, b, strict=True))
    assert got == [(0, 1, 1, 2, p, 128 * 76 + 25 * 25), (0, 1, 2, 10, p, 128 * 76)]
    assert mining.hard_negatives(q.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mining.hard_negatives(q.where("label = 1"), F.col("vec_id") % 50 == 0).count() == 0
