"""Nearest neighbours beside brute force over every pair of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import vptree as VP


def brute(rows, k=20):
    """Sorted (query_id, [(vec_id, score)]) of every query row, over all rows of its length."""
    out = []
    for i, (a, x) in enumerate(rows):
        if a % 20:
            continue
        scores = []
        for j, (b, y) in enumerate(rows):
            if i != j and len(x) == len(y):
                with np.errstate(all="ignore"):
                    scores.append((b, float(np.cumsum(np.array(x) * np.array(y))[-1])))
        scores.sort(key=lambda s: (np.inf if np.isnan(s[1]) else -s[1], s[0]))
        out.append((a, scores[:k]))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in VP.nearest(df, F.col("id") % 20 == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_every_row_of_any_size_takes_part(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(900, 8)), 2)
    x[50:90] = x[50]  # equal vectors: ties go to the smaller id
    x[3] *= 9
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] * 8), (2005, [float("inf")] * 8), (None, [1.0] * 8)]
    got = found(spark, rows + odd, shard_bytes=200 * 8 * 8, block=16, most_asked=30)
    want = dict(brute(rows))
    assert set(got) == set(want)
    for q, best in want.items():
        assert [(v, s) for _, v, s in got[q]] == best


def test_repeated_ids_lengths_and_extreme_sizes(spark):
    rows = [(20, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [0.5, 0.0]), (3, [2.0, 0.0]), (40, [1e-200, 1e-201]), (5, [1e-200, 1e-200]), (61, [0.0, 0.0, 1.0]), (80, [-1e308, 1e308]), (81, [1e308, 1e308])]
    got = found(spark, rows)
    for q, best in brute(rows):
        assert [v for _, v, _ in got[q]] == [v for v, _ in best]
        assert np.array_equal([s for _, _, s in got[q]], [s for _, s in best], equal_nan=True)
    twice = found(spark, [(60, [1.0, 2.0, 3.0]), (60, [5.0, 1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (100, [1.0, 1.0])])
    assert twice == {60: [(1, 60, 10.0), (1, 60, 10.0), (2, 7, 1.0), (2, 7, 5.0)]}
    assert found(spark, rows[:0]) == {}


@pytest.mark.parametrize("spread", [1.0, 1e150])
def test_cells_rule_out_shards_and_lose_nothing(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 5
    x = (centres[rng.integers(0, 12, 2400)] + rng.normal(size=(2400, 6)) * 0.1) * spread
    x[:800] = x[0]  # a third of all rows are one vector
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    got = found(spark, rows, shard_bytes=300 * 6 * 8, k=5)
    for q, best in brute(rows, 5):
        assert [v for _, v, _ in got[q]] == [v for v, _ in best]


def test_relaxed_pruning_visits_less_and_one_is_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 6)) * 4
    x = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 6)) * 0.2
    q = np.arange(0, 6000, 60)
    exact = {i: {v for v, _ in best} for i, best in ((int(i), sorted(((int(j), -s) for j, s in enumerate(x @ x[i]) if j != i), key=lambda v: (v[1], v[0]))[:10]) for i in q)}
    shard, seen = VP.Shard(np.arange(6000), np.arange(6000), x), {}
    for factor in (1.0, 3.0):
        a, r, _, visits = shard.search(q, x[q], 10, factor)
        got = {int(q[i]): set(r[a == i].tolist()) for i in range(len(q))}
        seen[factor] = (np.mean([len(got[i] & exact[i]) / 10 for i in exact]), visits)
    leaves = sum(not isinstance(n, tuple) for n in shard.nodes)
    assert seen[1.0][0] == 1.0 and seen[3.0][1] <= seen[1.0][1] < leaves * len(q)
