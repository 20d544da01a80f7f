"""Nearest rows of a large table: space is dealt out in tiles, and each tile's rows are searched in their task by a k-d tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, about; rows of a leaf; rows of either table that lay out the tiles; points searched at once; tasks at most.
TILE, LEAF, LAID, AT_ONCE, MOST_TASKS = 50_000, 16, 1 << 16, 4096, 512


class Tree:
    """A k-d tree of rows (rows, coordinates), halved along the longer side until leaves have about `leaf` rows.

    A node's box is that of its rows, or with `whole` all of the space that falls to it.
    """

    def __init__(self, at: np.ndarray, leaf: int, whole: bool = False):
        n, k = at.shape
        self.depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
        self.first = 2**self.depth - 1  # leaves begin here
        self.side, self.value = np.zeros(self.first, np.int64), np.zeros(self.first)
        order, ends = np.arange(n), [(0, n)]
        low, high = np.full((2 * self.first + 1, k), -np.inf), np.full((2 * self.first + 1, k), np.inf)
        for node in range(self.first):
            a, b = ends[node]
            mid = (a + b) // 2
            rows = order[a:b]
            side = int(np.argmax(np.ptp(at[rows], axis=0))) if b > a else 0
            if b > a:
                rows = rows[np.argpartition(at[rows, side], mid - a)]
                order[a:b] = rows
                self.value[node] = at[rows[mid - a], side]
            self.side[node] = side
            ends += [(a, mid), (mid, b)]
            if whole:
                for child in (2 * node + 1, 2 * node + 2):
                    low[child], high[child] = low[node], high[node]
                high[2 * node + 1, side] = low[2 * node + 2, side] = self.value[node]
        self.order, self.start = order, np.array([a for a, _ in ends[self.first :]] + [n])
        self.at = at[order]
        if not whole:
            for leaf_node, (a, b) in enumerate(ends[self.first :], self.first):
                some = self.at[a:b]
                low[leaf_node], high[leaf_node] = (some.min(axis=0), some.max(axis=0)) if b > a else (np.inf, -np.inf)
            for node in range(self.first - 1, -1, -1):
                low[node], high[node] = np.minimum(low[2 * node + 1], low[2 * node + 2]), np.maximum(high[2 * node + 1], high[2 * node + 2])
        self.low, self.high = low, high

    def leaf_of(self, q: np.ndarray) -> np.ndarray:
        node = np.zeros(len(q), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (q[np.arange(len(q)), self.side[node]] >= self.value[node])
        return node - self.first

    def near(self, q: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points (ascending) and the leaves whose box is within the point's squared distance."""
        i, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        limit = d2 * (1 + 1e-9)
        for _ in range(self.depth):
            i, node = np.repeat(i, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
            gap = np.maximum(np.maximum(self.low[node] - q[i], q[i] - self.high[node]), 0.0)
            keep = (gap * gap).sum(axis=1) <= limit[i]
            i, node = i[keep], node[keep]
        return i, node - self.first

    def _least(self, q: np.ndarray, i: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least squared distance of each point in its leaves (i ascending, each point there), and the first row that has it."""
        n = self.start[leaf + 1] - self.start[leaf]
        to = np.cumsum(n)
        rows = np.arange(to[-1]) - np.repeat(to - n - self.start[leaf], n)
        who = np.repeat(i, n)
        d2 = np.zeros(len(rows))
        for c in range(q.shape[1]):
            gap = q[who, c] - self.at[rows, c]
            d2 += gap * gap
        begins = np.flatnonzero(np.diff(who, prepend=-1))
        least = np.minimum.reduceat(d2, begins)
        first = np.minimum.reduceat(np.where(d2 == least[who], self.order[rows], len(self.order)), begins)
        return least, first

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The squared distance of each point's nearest row, and that row, the first on ties."""
        d2, row = np.empty(len(q)), np.empty(len(q), np.int64)
        for a in range(0, len(q), AT_ONCE):
            some = q[a : a + AT_ONCE]
            bound, _ = self._least(some, np.arange(len(some)), self.leaf_of(some))
            d2[a : a + AT_ONCE], row[a : a + AT_ONCE] = self._least(some, *self.near(some, bound))
        return d2, row


def _coordinates(rows: pa.Table | pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    return np.stack([np.asarray(rows.column(k), float) for k in keys], axis=1)


def by_tiles(points: DataFrame, grid: DataFrame, keys: tuple[str, ...], key: str) -> DataFrame:
    """The key and idx of the nearest row of `grid` (_idx, keys), the lower on ties; coordinates are doubles without nulls.

    1. At most about `LAID` rows of each table, picked by hash, visit the driver: they lay out tiles of about equally many
       rows, and those of the grid give each point a distance within which its nearest row lies. Results don't depend on them.
    2. A grid row is sent to its tile, a point to every tile within that distance: mostly one.
    3. A tile's task finds its points' nearest rows; the least of a point's tiles is the answer.
    So a row of either table is shuffled about once. Very many rows at one place are one task's.
    """
    n_grid, n_points = grid.count(), points.count()

    def picked(df: DataFrame, name: str, n: int) -> np.ndarray:
        every = max(1, math.ceil(n / LAID))
        rows = df if every == 1 else df.filter(F.pmod(F.xxhash64(name), F.lit(every)) == 0)
        return rows.select(*keys).toPandas().to_numpy(float).reshape(-1, len(keys))  # about LAID rows

    known, some = picked(grid, "_idx", n_grid), picked(points, key, n_points)
    # Each table by its own weight, so that a tile's rows of both are about TILE.
    each = max(n_grid / len(known), n_points / max(1, len(some)))
    even = lambda rows, n: rows[np.linspace(0, len(rows) - 1, min(len(rows), math.ceil(n / each))).astype(int)] if len(rows) else rows
    both = np.concatenate([even(known, n_grid), even(some, n_points)])
    count = min(len(both), max(1, math.ceil((n_grid + n_points) / TILE)))
    tiles, bounds = Tree(both, max(1, len(both) // count), whole=True), Tree(known, LEAF)
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, min(tiles.first + 1, MOST_TASKS))
    places = ", ".join(f"{k} double" for k in keys)
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((key, points), ("_idx", grid))}

    def deal_grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            tile = pa.array(tiles.leaf_of(_coordinates(rows, keys)), pa.int32())
            yield pa.RecordBatch.from_arrays([tile, *rows.columns], names=["_tile", *rows.schema.names])

    def deal_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = _coordinates(rows, keys)
            for a in range(0, len(at), AT_ONCE):
                part = at[a : a + AT_ONCE]
                i, tile = tiles.near(part, bounds.nearest(part)[0])
                mine = rows.slice(a, AT_ONCE).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), *mine.columns], names=["_tile", *mine.schema.names])

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({key: asked.column(key).slice(0, 0), "_d2": pa.array([], pa.float64()), "idx": held.column("_idx").slice(0, 0)})
        held = held.sort_by("_idx")  # the first row is the lower on ties
        d2, row = Tree(_coordinates(held, keys), LEAF).nearest(_coordinates(asked, keys))
        return pa.table({key: asked.column(key), "_d2": pa.array(d2), "idx": held.column("_idx").take(pa.array(row))})

    left = grid.select("_idx", *keys).mapInArrow(deal_grid, f"_tile int, _idx {kinds['_idx']}, {places}").repartition(tasks, "_tile")
    right = points.select(key, *keys).mapInArrow(deal_points, f"_tile int, `{key}` {kinds[key]}, {places}").repartition(tasks, "_tile")
    found = left.groupBy("_tile").cogroup(right.groupBy("_tile")).applyInArrow(search, f"`{key}` {kinds[key]}, _d2 double, idx {kinds['_idx']}")
    return found.groupBy(key).agg(F.min(F.struct("_d2", "idx")).alias("_best")).select(key, F.col("_best.idx").alias("idx"))
