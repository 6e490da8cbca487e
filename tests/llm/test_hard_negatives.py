"""Hard negatives against brute force, and sorted access that ends early."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evidentia.llm import hard_negatives as h

ROWS = "vec_id long, label int, embedding array<float>, score int, rank string"


def plain(rows, is_anchor):
    one = {}
    for k, label, v in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one[k] = min(one.get(k, (str(label), v)), (str(label), v))
    own = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in one.items()}
    out = []
    for a, (label, v) in own.items():
        if not is_anchor(a):
            continue
        s = {k: sum(x * y for x, y in zip(v, w, strict=False)) for k, (_, w) in own.items() if k != a}
        first = sorted((k for k in s if own[k][0] == label), key=lambda k: (-s[k], k))[:5]
        for p in first:
            hard = sorted((k for k in s if own[k][0] != label and 50 * s[p] <= 100 * s[k] <= 95 * s[p]), key=lambda k: (-s[k], k))[:3]
            out += [(a, p, j + 1, k, s[p], s[k]) for j, k in enumerate(hard)]
    return sorted(out)


def some_rows(n=700, dim=8, seed=1):
    r = np.random.default_rng(seed)
    rows = [(k, int(r.integers(4)), [float(np.float32(x)) for x in (r.normal(size=dim) * (r.random(dim) < 0.7)).round(1)]) for k in range(n)]
    rows += [(3, 1, rows[3][2]), (4, 0, [0.5] * dim), (4, 0, [0.5] * dim), (n + 1, None, [1.0] * dim), (n + 2, 1, None), (n + 3, 1, [float("nan")] + [0.0] * (dim - 1)), (n + 4, 2, [None] * dim), (n + 5, 2, [float("inf")] * dim)]
    rows += [(None, 1, [1.0] * dim), (n + 6, 1, [1.0, 2.0]), (n + 7, 1, []), (n + 50, 9, [1.0] * dim), (n + 51, 1, [0.0] * dim), (n + 60, 2, [1.0] * (dim + 3))]
    return rows


def test_equals_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    for shard_rows in (40, 16384):
        got = sorted(tuple(r) for r in h.mine(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows).collect())
        assert got == plain(rows, lambda k: k % 10 == 0) and len(got) > 500


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert h.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    assert h.mine(spark.createDataFrame([(0, 1, [1.0], 0, "")], ROWS), F.col("vec_id") == 0).count() == 0


def test_sorted_access_ends_early():
    """A few rows near the anchor, many far from it: most rows are never met."""
    r = np.random.default_rng(2)
    x = r.normal(size=(5000, 16)) * 0.02
    x[:50] += 1
    row = h.shard(pd.DataFrame({"shard": 0, "_id": range(5000), "_label": "a", "_v": list(x)})).iloc[0]
    lists, met = h.Lists(row), np.empty(0)
    for _, scores, threshold in lists.scan(h.integers([x[0]])[0], np.ones(5000, bool)):
        met = np.sort(np.concatenate([met, scores]))
        if len(met) >= 5 and threshold < met[-5]:
            break
    assert len(met) < 1000
    rows, scores = h.best(lists, h.integers([x[0]])[0], np.ones(5000, bool), 7)
    every = h.integers(list(x)).astype(np.int64) @ h.integers([x[0]])[0].astype(np.int64)
    assert rows.tolist() == np.lexsort((np.arange(5000), -every))[:7].tolist() and scores.tolist() == every[rows].tolist()


def test_large_components_are_exact():
    x = np.array([[2.0**17, 3.0], [2.0**17, 3.0 + 1 / 256], [1.0, 2.0]])
    lists = h.Lists(h.shard(pd.DataFrame({"shard": 0, "_id": range(3), "_label": "a", "_v": list(x)})).iloc[0])
    rows, scores = h.best(lists, h.integers([x[1]])[0], np.ones(3, bool), 3)
    assert rows.tolist() == [1, 0, 2] and scores.tolist() == [2**50 + 769**2, 2**50 + 768 * 769, 2**33 + 512 * 769]
