"""Gini trees on one feature each, for many features together, over all distinct values.

The rows are summed by value (one shuffle) and kept in order over the partitions. A round finds the best split of a leaf of
every feature, from the running sums that each partition starts with; a row for each leaf reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import long_form
from ..functions.kernels import INF

FOUND = "leaf int, gain double, x double, next double, bad double, good double"


@dataclass
class Leaf:
    """Values in (lo, hi], with the bad and good rows below and up to its end."""

    lo: float
    hi: float
    before: tuple[float, float]
    upto: tuple[float, float]
    depth: int = 0
    split: tuple | None = None
    """gain, threshold, largest value below it, bad and good rows up to there"""
    last: float = INF
    """The largest value that may be in it."""
    first: float = -INF
    """Its values lie above."""
    least: float = -INF
    largest: float = INF
    """Of a tree of one leaf: its values."""

    @property
    def bad(self) -> int:
        return int(self.upto[0] - self.before[0])

    @property
    def good(self) -> int:
        return int(self.upto[1] - self.before[1])


def _impurity(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    n = bad + good
    return np.where(n > 0, 2.0 * bad * good / np.maximum(n, 1), 0.0)


def _best_splits(leaves: list[tuple], before: dict, following: dict):
    """leaves: (number, feature, first, last, rows below, rows up to the end, fewest rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        held: tuple | None = None
        sums: dict[int, np.ndarray] = {}
        part = 0

        def look(v: np.ndarray, x: np.ndarray, bad: np.ndarray, good: np.ndarray, after: np.ndarray) -> None:
            """Rows in order; after: the value that follows each, infinite at a feature's end."""
            edges = np.flatnonzero(np.diff(v)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(v)], strict=True):
                feature = int(v[lo])
                start = sums.get(feature, before.get((part, feature)))
                b, g = start[0] + np.cumsum(bad[lo:hi]), start[1] + np.cumsum(good[lo:hi])
                sums[feature] = np.array([b[-1], g[-1]])
                own = x[lo:hi]
                for number, of, first, last, low, high, fewest in leaves:
                    if of != feature:
                        continue
                    i, j = np.searchsorted(own, first, side="right"), np.searchsorted(after[lo:hi], last, side="right")
                    if i >= j:
                        continue
                    lb, lg, rb, rg = b[i:j] - low[0], g[i:j] - low[1], high[0] - b[i:j], high[1] - g[i:j]
                    gain = _impurity(high[0] - low[0], high[1] - low[1]) - _impurity(lb, lg) - _impurity(rb, rg)
                    gain = np.where((lb + lg >= fewest) & (rb + rg >= fewest), gain, -1.0)
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-12 and (number not in best or gain[k] > best[number][0]):
                        best[number] = (float(gain[k]), float(own[i + k]), float(after[lo + i + k]), float(b[i + k]), float(g[i + k]))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            if held is not None:
                rows = [np.concatenate([[h], r]) for h, r in zip(held, rows, strict=True)]
            v, x, bad, good = rows
            if len(v) > 1:
                after = np.where(v[1:] == v[:-1], x[1:], [following.get((part, int(a)), INF) for a in v[:-1]] if (v[1:] != v[:-1]).any() else INF)
                look(v[:-1], x[:-1], bad[:-1], good[:-1], after)
            held = v[-1], x[-1], bad[-1], good[-1]
        if held is not None:
            v, x, bad, good = (np.array([h]) for h in held)
            look(v, x, bad, good, np.array([following.get((part, int(v[0])), INF)]))
        if best:
            table = np.array([(k, *r) for k, r in best.items()], float)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0].astype(np.int32)), *(pa.array(c) for c in table[:, 1:].T)], [x.split()[0] for x in FOUND.split(", ")])

    return run


def grow(df: DataFrame, target: str, columns: dict[str, Column], fewest: dict[str, int], max_leaves: int | dict[str, int] | None = None, max_depth: int | None = None) -> dict[str, list[Leaf]]:
    """column -> leaves in order, NULLs left out. Thresholds are midpoints; the first of equal gains wins. With max_leaves a tree
    grows best first, else to max_depth. No leaves without values; fewest: rows of a leaf."""
    names = list(columns)
    if not names:
        return {}
    cells = long_form(df, {str(i): x.cast("double") for i, x in enumerate(columns.values())}, {"y": F.col(target)})
    cells = cells.select(F.col("variable").cast("int").alias("v"), F.col("value").alias("x"), "y").where("x IS NOT NULL AND NOT isnan(x)")
    cells = cells.groupBy("v", "x").agg(F.sum("y").cast("double").alias("bad"), F.sum(1 - F.col("y")).cast("double").alias("good"))
    cells = cells.repartitionByRange("v", "x").sortWithinPartitions("v", "x").select(F.spark_partition_id().alias("part"), "v", "x", "bad", "good").persist()
    try:
        ranges = cells.groupBy("v", "part").agg(F.min("x").alias("x"), F.max("x").alias("largest"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("v", "part").collect()
        before, following, total = {}, {}, {}
        for a, b in zip(ranges, [*ranges[1:], None], strict=True):
            so_far = total.get(a.v, (0.0, 0.0))
            before[(a.part, a.v)] = so_far
            total[a.v] = (so_far[0] + a.bad, so_far[1] + a.good)
            if b is not None and b.v == a.v:
                following[(a.part, a.v)] = b.x
        held = {v: [r for r in ranges if r.v == v] for v in total}
        trees = {v: [Leaf(-INF, INF, (0.0, 0.0), total[v], least=own[0].x, largest=own[-1].largest)] for v, own in held.items()}
        fresh = [(v, leaf) for v, leaves in trees.items() for leaf in leaves]
        while fresh:
            asked = [(k, v, leaf.first, leaf.last, leaf.before, leaf.upto, fewest[names[v]]) for k, (v, leaf) in enumerate(fresh) if max_depth is None or leaf.depth < max_depth]
            if not asked:
                break
            found = cells.mapInArrow(_best_splits(asked, before, following), FOUND)
            best = F.max(F.struct("gain", (-F.col("x")).alias("x"), "next", "bad", "good"))
            for k, r in found.groupBy("leaf").agg(best).collect():
                # of an infinite last value the threshold lies between two finite ones all the same
                fresh[k][1].split = (r.gain, (-r.x + r.next) / 2, -r.x, (r.bad, r.good))
            fresh = []
            for v, leaves in trees.items():
                most = max_leaves[names[v]] if isinstance(max_leaves, dict) else max_leaves
                options = [(leaf.split[0], -k) for k, leaf in enumerate(leaves) if leaf.split]
                if most is not None:
                    options = [max(options)] if options and len(leaves) < most else []
                for _, k in sorted(options, key=lambda o: o[1]):
                    leaf = leaves.pop(-k)
                    _, at, x, upto = leaf.split
                    pair = Leaf(leaf.lo, at, leaf.before, upto, leaf.depth + 1, None, x, leaf.first), Leaf(at, leaf.hi, upto, leaf.upto, leaf.depth + 1, None, leaf.last, x)
                    leaves += pair
                    fresh += [(v, p) for p in pair]
        return {c: sorted(trees.get(i, []), key=lambda leaf: leaf.lo) for i, c in enumerate(names)}
    finally:
        cells.unpersist()
