"""Exact nearest neighbours within groups, below all pairs.

Rows go to the nearest of some pivots of their group, and a pivot's rows to rings
by their distance from it, each of a bounded number of rows, also where very many
rows are equal. Rings that follow one another form a part, which one task holds. A
row's nearest rows of its own part bound how far its neighbours can be; by the
triangle inequality only rings whose distances from their pivot fit that bound can
hold a nearer row, and only those meet, a pair of parts in a task. In a task a
product of matrices gives each distance from below, within the rounding of its short
numbers, and only pairs within a row's bound are measured. In many dimensions or
without clusters few rings can be left out, and the work grows with the square of a
group; the result is exact in any case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ranking import with_position
from netloom.sources.sinks import small_side, stored

#: Rows of a ring at most; pivots of a group, and of all groups together; a part's rows in rings, but for the rest of its last one.
BLOCK, PIVOTS, MOST_PIVOTS, WIDE = 1000, 512, 8192, 32
#: Rows of a leaf, in which a task compares; leaves that are compared at once; leaves that bound a row at first.
LEAF, TILE, FIRST = 256, 16, 4
#: Bounds are widened by this part, more than distances lose by rounding.
SLACK = 1e-9
#: Numbers from here on, whose squares might not be numbers, are compared one by one.
MOST = 1e150


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows side by side, added up in the order of the columns, so that a pair of rows has the same one wherever it is compared."""
    d = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for j in range(x.shape[-1]):
        d += (x[..., j] - y[..., j]) ** 2
    return d


def _leaves(z: np.ndarray) -> list[np.ndarray]:
    """Rows halved along their widest column until at most LEAF are together."""
    out, stack = [], [np.arange(len(z))]
    while stack:
        at = stack.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        column = z[at, z[at].var(0).argmax()]
        order = np.argpartition(column, len(at) // 2)
        stack += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _distinct(y: np.ndarray, k: int) -> np.ndarray:
    """The places of rows but those with more than k equal ones before them."""
    if not y.shape[1]:
        return np.arange(min(len(y), k + 1))
    _, inverse = np.unique(np.ascontiguousarray(y).view(f"V{y.dtype.itemsize * y.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    firsts = np.flatnonzero(np.diff(inverse[order], prepend=-1))
    place = np.arange(len(y)) - np.repeat(firsts, np.diff([*firsts, len(y)]))
    return np.sort(order[place <= k])


class _Held:
    """Rows that others are compared with: in leaves with the corners of their boxes, along the axes of their spread, widest first.

    ``lower`` gives squared distances less a margin for rounding, in units of ``scale`` squared; ``reach`` turns a
    squared distance into one that no such value of a pair within it exceeds.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.middle = y.mean(0)
        off = y - self.middle
        self.axes = np.linalg.eigh(off.T @ off)[1][:, ::-1]
        z, ends = off @ self.axes, (x - self.middle) @ self.axes
        self.scale = max(np.abs(z).max(), np.abs(ends).max()) or 1.0
        z, self.sought = z / self.scale, ends / self.scale
        n = z.shape[1]
        self.margin = 8 * (n + 8) * 2.0**-24
        self.off = 8 * n * 2.0**-52 * (np.sqrt((x * x).sum(1).max()) + np.sqrt((y * y).sum(1).max()) + self.scale * n**0.5) / self.scale
        leaves = _leaves(z)
        self.order = np.concatenate(leaves)
        self.cuts = np.cumsum([0, *map(len, leaves)])
        z = z[self.order]
        self.low, self.high = (f.reduceat(z, self.cuts[:-1]) for f in (np.minimum, np.maximum))
        self.right = np.concatenate([z, np.ones((len(z), 1)), (1 - self.margin) * (z * z).sum(1)[:, None]], axis=1).astype(np.float32)

    def left(self, z: np.ndarray) -> np.ndarray:
        return np.concatenate([-2 * z, (1 - self.margin) * (z * z).sum(1)[:, None], np.ones((len(z), 1))], axis=1).astype(np.float32)

    def boxes(self, z: np.ndarray) -> np.ndarray:
        """Squared distances of rows from the leaves' boxes; a few axes give nearly all of them."""
        d = np.zeros((len(z), len(self.low)))
        for j in range(min(16, z.shape[1])):
            d += np.maximum(np.maximum(self.low[:, j] - z[:, j, None], z[:, j, None] - self.high[:, j]), 0) ** 2
        return d

    def places(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.cuts[i], self.cuts[i + 1]) for i in leaves])

    def reach(self, gaps: np.ndarray) -> np.ndarray:
        return (np.sqrt(gaps) / self.scale + self.off) ** 2 * (1 + SLACK) + 1e-30


def _nearest_of(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the k nearest of y but itself, by distance, then id.

    Matrices of k columns: squared distances, ids, and whether there is a row. within: squared distances beyond which none is sought.
    """
    order = np.argsort(ids, kind="stable")
    order = order[_distinct(y[order], k)]
    y, ids = y[order], ids[order]
    gaps, best = np.full((len(x), k), np.inf), np.full((len(x), k), len(y))
    bounds = np.full(len(x), np.inf) if within is None else within
    if not (x.shape[1] and np.abs(x).max() < MOST and np.abs(y).max() < MOST):
        for at in range(len(x)):
            row = np.where(ids == own[at], np.nan, _gaps(x[at], y))
            some = np.flatnonzero(row <= bounds[at])
            some = some[np.argsort(row[some], kind="stable")[:k]]
            gaps[at, : len(some)], best[at, : len(some)] = row[some], some
    else:
        held = _Held(x, y)
        for at in _leaves(held.sought):
            gaps[at], best[at] = _seek(held, at, x[at], own[at], y, ids, k, bounds[at])
    return gaps, np.append(ids, 0)[best], best < len(y)


def _seek(held: _Held, at: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places in y of what is nearest to the rows ``at``, which lie together; y in the order of ids."""
    left, boxes = held.left(held.sought[at]), held.boxes(held.sought[at])
    leaves = np.argsort(boxes.min(0) + boxes.mean(0), kind="stable")
    if np.isinf(bound).any():
        # Any k + 1 rows bound the distance of the k-th other one.
        some = held.places(leaves[:FIRST])
        if len(some) > k:
            pick = np.argpartition(left @ held.right[some].T, k, axis=1)[:, : k + 1]
            bound = np.minimum(bound, _gaps(x[:, None], y[held.order[some[pick]]]).max(1))
    gaps, best = np.full((len(at), k), np.inf), np.full((len(at), k), len(y))
    for i in range(0, len(leaves), TILE):
        reach = held.reach(bound)
        need = boxes[:, leaves[i : i + TILE]] <= reach[:, None]
        if not need.any():
            continue
        rows, places = np.flatnonzero(need.any(1)), held.places(leaves[i : i + TILE][need.any(0)])
        near = left[rows] @ held.right[places].T <= np.nextafter(reach[rows].astype(np.float32), np.float32(np.inf))[:, None]
        r, c = np.divmod(np.flatnonzero(near), len(places))
        r, c = rows[r], held.order[places[c]]
        gap = _gaps(x[r], y[c])
        kept = (gap <= bound[r]) & (ids[c] != own[r])
        changed = np.unique(r[kept])
        r, c, gap = np.concatenate([np.repeat(changed, k), r[kept]]), np.concatenate([best[changed].ravel(), c[kept]]), np.concatenate([gaps[changed].ravel(), gap[kept]])
        order = np.lexsort((c, gap, r))
        r, c, gap = r[order], c[order], gap[order]
        top = np.flatnonzero(np.diff(r, prepend=-1))[:, None] + np.arange(k)
        best[changed], gaps[changed] = c[top], gap[top]
        bound = np.minimum(bound, gaps[:, k - 1])
    return gaps, best


@dataclass(frozen=True)
class Pivots:
    """A few rows of each group: x[g] is a matrix, one pivot a row."""

    x: dict[int, np.ndarray]

    def between(self, g: int, cell: int) -> np.ndarray:
        """The distances of one pivot from all of its group."""
        return np.sqrt(((self.x[g] - self.x[g][cell]) ** 2).sum(1))


def _pivots(rows: DataFrame, block: int) -> Pivots:
    """Rows chosen by hash: about one for four rings, at least one a group; a bounded number, so they may come to the driver."""
    sizes = {r.g: r.n for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {g: min(PIVOTS, -(-n // (4 * block))) for g, n in sizes.items()}
    share = min(1.0, MOST_PIVOTS / max(1, sum(want.values())))
    part = [F.lit(x) for g, n in sizes.items() for x in (g, want[g] * share / n)]
    h = F.xxhash64("g", "id")
    place = (h / 2.0**64) + 0.5
    first = rows.groupBy("g").agg(F.min_by("x", h).alias("x"))
    more = rows.filter(place < F.create_map(*part)[F.col("g")]).select("g", "x") if part else rows.select("g", "x").limit(0)
    found: dict[int, list] = {}
    for r in first.unionByName(more).distinct().sort("g", "x").collect():
        found.setdefault(r.g, []).append(r.x)
    return Pivots({g: np.array(x, float) for g, x in found.items()})


def _placed(rows: DataFrame, pivots: Pivots, block: int) -> DataFrame:
    """(g, id, x, cell, far, ring, part): the nearest pivot, the distance from it, the ring and its part."""

    def assign(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            cell, far = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            x = np.stack(frame.x) if len(frame) else np.zeros((0, 0))
            for g in frame.g.unique():
                at, p = np.flatnonzero(frame.g == g), pivots.x[g]
                for some in np.array_split(at, -(-len(at) // 2000)):
                    cell[some] = ((p**2).sum(1)[None] - 2 * x[some] @ p.T).argmin(1)
                far[at] = np.sqrt(((x[at] - p[cell[at]]) ** 2).sum(1))
            yield frame.assign(cell=cell, far=far)

    assigned = rows.mapInPandas(assign, "g long, id long, x array<double>, cell int, far double")
    places = with_position(assigned, [F.col("g"), F.col("cell"), F.col("far")], "place")
    firsts = places.groupBy("g", "cell").agg(F.min("place").alias("first"))
    # A row for each pivot.
    firsts = firsts.withColumn("before", F.col("first") - F.min("first").over(Window.partitionBy("g")))
    placed = places.join(small_side(firsts, "cells"), ["g", "cell"]).withColumn("ring", F.floor((F.col("place") - F.col("first")) / block).cast("int"))
    part = F.floor((F.col("before") + F.col("ring") * block) / (WIDE * block)).cast("int")
    return placed.select("g", "id", "x", "cell", "far", "ring", part.alias("part"))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys of much work and few bytes, which Spark must not put together by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _bounded(placed: DataFrame, k: int) -> DataFrame:
    """``placed`` with each row's nearest of its own part (gaps, near) and bound, the distance beyond which none is needed."""

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(frame.x), frame.id.to_numpy()
        gaps, near, there = _nearest_of(x, ids, x, ids, k)
        pick = lambda own: [row[:n] for row, n in zip(own, there.sum(1), strict=True)]
        return frame.assign(bound=np.sqrt(gaps[:, k - 1]), gaps=pick(gaps), near=pick(near))

    schema = "g long, id long, x array<double>, cell int, far double, ring int, part int, bound double, gaps array<double>, near array<long>"
    return stored(_dealt(placed, "g", "part").groupBy("g", "part").applyInPandas(own, schema), "bounded")


def _ring_pairs(bounded: DataFrame, pivots: Pivots) -> DataFrame:
    """(g, a_part, a_cell, a_ring, b_part, b_cell, b_ring): rings of which b may hold a row that one of a needs; a and b differ."""
    rings = bounded.groupBy("g", "cell", "ring").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.max("bound").alias("reach"), F.min("part").alias("part"))
    rings = stored(rings, "rings")
    # A row for each pivot.
    ends = {(r.g, r.cell): (r.lo, r.hi) for r in rings.groupBy("g", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}

    def wanted(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            out = []
            for g, cell, ring, lo, hi, reach, part in frame[["g", "cell", "ring", "lo", "hi", "reach", "part"]].itertuples(index=False):
                away = pivots.between(g, cell)
                for other in range(len(away)):
                    if (g, other) not in ends:
                        continue
                    low, high = (lo, hi) if other == cell else (away[other] - hi, away[other] + hi)
                    widen = reach + SLACK * (1 + abs(away[other]) + hi)
                    low, high = low - widen, high + widen
                    least, most = ends[g, other]
                    if low <= most and high >= least:
                        out.append((g, part, cell, ring, other, low, high))
            yield pd.DataFrame(out, columns=["g", "a_part", "a_cell", "a_ring", "b_cell", "low", "high"])

    found = rings.mapInPandas(wanted, "g long, a_part int, a_cell int, a_ring int, b_cell int, low double, high double")
    others = rings.select("g", F.col("part").alias("b_part"), F.col("cell").alias("b_cell"), F.col("ring").alias("b_ring"), "lo", "hi")
    pairs = found.join(others, ["g", "b_cell"]).filter((F.col("hi") >= F.col("low")) & (F.col("lo") <= F.col("high")))
    pairs = pairs.filter((F.col("a_cell") != F.col("b_cell")) | (F.col("a_ring") != F.col("b_ring")))
    return stored(pairs.select("g", "a_part", "a_cell", "a_ring", "b_part", "b_cell", "b_ring"), "ring-pairs")


def _compared(bounded: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(g, id, gap, near) from other parts: the nearest k of each part within a row's bound. A ring goes to a pair of parts at most once for either side."""
    keys = ["g", "a_part", "b_part"]
    pairs = pairs.filter("a_part <> b_part")
    sides = [pairs.select(*keys, F.col(f"{s}_cell").alias("cell"), F.col(f"{s}_ring").alias("ring")).distinct() for s in "ab"]
    rows = bounded.select("g", "cell", "ring", "id", "x", "bound")
    seek, held = (rows.join(small_side(side, "sides"), ["g", "cell", "ring"]).select(*keys, "id", "x", "bound", F.lit(s).alias("seeks")) for side, s in zip(sides, (True, False), strict=True))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame.seeks], frame[~frame.seeks]
        ids, bound = left.id.to_numpy(), left.bound.to_numpy()
        gaps, near, there = _nearest_of(np.stack(left.x), ids, np.stack(right.x), right.id.to_numpy(), k, bound * bound * (1 + SLACK))
        return pd.DataFrame({"g": key[0], "id": np.repeat(ids, there.sum(1)), "gap": gaps[there], "near": near[there]})

    return _dealt(seek.unionByName(held), *keys).groupBy(*keys).applyInPandas(compare, "g long, id long, gap double, near long")


def nearest(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(g, id, near): the ids of each row's k nearest others of its group, nearest first, of equally near ones the smaller id.

    rows: (g, id, x): a group, an id that is unique in it, and an array of numbers as
    long for every row. A null or NaN counts as 0. Groups of k rows or fewer give
    what there is. The groups' number is taken to be small (classes), and so are the
    pivots, which the driver and all tasks hold.
    """
    x = F.transform("x", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    rows = stored(rows.select(F.col("g").cast("long").alias("g"), F.col("id").cast("long").alias("id"), x.alias("x")), "points")
    pivots = _pivots(rows, block)
    bounded = _bounded(_placed(rows, pivots, block), k)
    tops = _compared(bounded, _ring_pairs(bounded, pivots), k)
    first = bounded.select("g", "id", F.explode(F.arrays_zip("gaps", "near")).alias("t")).select("g", "id", F.col("t.gaps").alias("gap"), F.col("t.near").alias("near"))
    # At most k from each part that was compared.
    best = F.slice(F.sort_array(F.collect_list(F.struct("gap", "near"))), 1, k)
    return first.unionByName(tops).groupBy("g", "id").agg(F.transform(best, lambda t: t["near"]).alias("near"))
