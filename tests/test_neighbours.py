"""Nearest neighbours against brute force, and how many pairs are compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import neighbours


def frame(spark, groups):
    rows = [(g, i, list(map(float, v))) for g, x in groups.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g long, id long, x array<double>").repartition(4)


def brute(x, k):
    d = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - x[None, :, j]) ** 2
    out = {}
    for i, row in enumerate(d):
        out[i] = sorted((j for j in range(len(x)) if j != i), key=lambda j: (row[j], j))[:k]
    return out


@pytest.mark.parametrize("block", [7, 25, 1000])
def test_nearest_equal_brute_force(spark, block):
    """Clusters, one point with a third of all rows, ties on a grid, groups of one and of k rows."""
    rng = np.random.default_rng(3)
    grid = np.array([(i % 9, i // 9) for i in range(81)], float)
    groups = {
        1: np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (5, 5, 5), (9, 0, 4))]), 2: np.concatenate([np.tile([1.0, 2.0, 3.0], (60, 1)), rng.normal(size=(90, 3))]),
        3: np.concatenate([grid, np.zeros((81, 1))], axis=1), 4: np.array([[1.0, 2.0, 3.0]]), 5: rng.normal(size=(4, 3)),
    }
    got = {(r.g, r.id): r.near for r in neighbours.nearest(frame(spark, groups), 4, block).collect()}
    for g, x in groups.items():
        for i, near in brute(x, 4).items():
            assert got.get((g, i), []) == near, (g, i)


def test_null_counts_as_zero_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, 1, [None, 1.0]), (1, 2, [0.0, 1.0]), (1, 3, [float("nan"), 5.0])], "g long, id long, x array<double>")
    assert {r.id: r.near for r in neighbours.nearest(df, 1).collect()} == {1: [2], 2: [1], 3: [1]}
    assert neighbours.nearest(df.limit(0), 2).count() == 0


def test_compared_pairs_stay_below_the_square(spark):
    """Four times the rows in clustered data: far fewer than sixteen times the pairs; no ring above the bound."""
    counts = []
    for n in (1000, 4000):
        rng = np.random.default_rng(1)
        x = rng.uniform(0, 1000, (n // 50, 2))[rng.integers(0, n // 50, n)] + rng.normal(size=(n, 2))
        rows = frame(spark, {1: x})
        pivots = neighbours._pivots(rows, 50)
        bounded = neighbours._bounded(neighbours._placed(rows, pivots, 50), 5)
        sizes = bounded.groupBy("g", "cell", "ring").agg(F.count(F.lit(1)).alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= 50
        pairs = neighbours._ring_pairs(bounded, pivots)
        a, b = sizes.toDF("g", "a_cell", "a_ring", "n_a"), sizes.toDF("g", "b_cell", "b_ring", "n_b")
        counts.append(pairs.join(a, ["g", "a_cell", "a_ring"]).join(b, ["g", "b_cell", "b_ring"]).agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0])
        assert counts[-1] < 0.5 * n * n
    assert counts[1] < 9 * counts[0]


def odd_rows(rng):
    """Spread, clustered, equal and tied rows; far from 0, some with a wild one, tiny ones."""
    spread = rng.normal(size=(400, 12))
    yield spread
    yield np.concatenate([np.tile(spread[:1], (150, 1)), spread[:100], spread[:100]])
    yield rng.integers(0, 3, (400, 4)).astype(float)
    yield 1e7 + rng.normal(size=(300, 5)) * 1e-3
    yield np.concatenate([spread[:300], np.full((1, 12), 1e9)])
    yield spread * 1e-30
    yield np.concatenate([spread[:300], np.full((2, 12), 1e200)])


@pytest.mark.parametrize("kind", range(7))
def test_products_leave_out_no_neighbour(kind, monkeypatch):
    for name, n in (("LEAF", 8), ("TILE", 3), ("FIRST", 1)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(8)
    x = list(odd_rows(rng))[kind]
    ids = rng.permutation(10 * len(x))[: len(x)]
    d = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        d += (x[:, j, None] - x[None, :, j]) ** 2
    best = [sorted((g, i) for g, i in zip(row, ids, strict=True) if i != own)[:5] for row, own in zip(d, ids, strict=True)]
    gaps, near, there = neighbours._nearest_of(x, ids, x, ids, 5)
    assert there.all() and [list(zip(*r, strict=True)) for r in zip(gaps, near, strict=True)] == best
    # Within a bound, of other rows: at it still counts.
    bound = np.array([r[2][0] for r in best])
    _, near, there = neighbours._nearest_of(x, ids, x[::2], ids[::2], 5, bound)
    for row, own, b, got, some in zip(d, ids, bound, near, there, strict=True):
        assert got[some].tolist() == [i for g, i in sorted((g, i) for g, i in zip(row[::2], ids[::2], strict=True) if i != own and g <= b)[:5]]


def test_few_distances_are_measured(monkeypatch):
    """Rows without clusters, in which no ring could be left out: a small part of all pairs is measured."""
    n, sizes, gaps = 3000, [], neighbours._gaps
    monkeypatch.setattr(neighbours, "_gaps", lambda x, y: sizes.append((out := gaps(x, y)).size) or out)
    x = np.random.default_rng(2).normal(size=(n, 10))
    neighbours._nearest_of(x, np.arange(n), x, np.arange(n), 5)
    assert sum(sizes) < n * n / 10


def test_rings_cross_in_parts(spark, monkeypatch):
    """Neighbours from other parts, and no more copies of a row than other parts, whatever the number of its rings."""
    monkeypatch.setattr(neighbours, "WIDE", 4)
    x = np.random.default_rng(6).normal(size=(600, 6))
    assert {r.id: r.near for r in neighbours.nearest(frame(spark, {1: x}), 4, 30).collect()} == brute(x, 4)
    rows = frame(spark, {1: x})
    pivots = neighbours._pivots(rows, 30)
    bounded = neighbours._bounded(neighbours._placed(rows, pivots, 30), 4)
    parts = [r.n for r in bounded.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) > 2 and max(parts) <= 5 * 30
    pairs = neighbours._ring_pairs(bounded, pivots).filter("a_part <> b_part")
    assert pairs.count() > 100
    assert neighbours._compared(bounded, pairs, 4).groupBy("id").count().agg(F.max("count")).first()[0] <= 4 * (len(parts) - 1)
    assert pairs.select("a_part", "b_part").distinct().count() <= len(parts) * (len(parts) - 1)
