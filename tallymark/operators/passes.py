"""Counts of many numeric columns in one pass: each task sums in numpy, so that only tables of bounded size leave it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

MAIN, APART, MISSING, VALUE, MANY = range(5)
"""Kinds of cells: of main values, of one value that stands apart, of NULLs; of one main value, of columns with few; or the sign
that a task saw more."""
CELLS = "variable int, kind int, at double, n double, bad double, lo double, hi double"
SAMPLED, EDGES, FINER, AT_ONCE, ROUNDS = 32_768, 1_024, 64, 1_000_000, 30
"""Rows sampled to choose cells, cells of a column chosen so, parts that a cell is cut to, values in all that are fetched at once."""


@contextmanager
def kept(df: DataFrame, view: DataFrame | None = None) -> Iterator[DataFrame]:
    """A view of df (or df), persisted while it is read several times; not where it reads only what is persisted already."""
    view = df if view is None else view
    leaves = view._jdf.queryExecution().withCachedData().collectLeaves()
    if all(leaves.apply(i).nodeName() in ("InMemoryRelation", "LocalRelation", "LogicalRDD") for i in range(leaves.size())):
        yield view
        return
    view = view.persist()
    try:
        yield view
    finally:
        view.unpersist()


def _numbers(df: DataFrame, columns: dict[str, Column], y: Column | None = None) -> DataFrame:
    """_0, _1, ... as double and y; NULL and NaN are alike from here on."""
    return df.select(*(x.cast("double").alias(f"_{i}") for i, x in enumerate(columns.values())), (F.lit(0.0) if y is None else y.cast("double")).alias("y"))


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def _batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _within(lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether x lies in one of some intervals, which are closed, disjoint and in order."""
    if not len(lo):
        return np.zeros(len(x), bool)
    at = np.searchsorted(lo, x, side="right") - 1
    return (at >= 0) & (x <= hi[np.maximum(at, 0)])


def _summed(cuts: list[np.ndarray | None], apart: list[np.ndarray], right: bool, few: int = 0, inside: list[tuple[np.ndarray, np.ndarray]] | None = None):
    """Sums by cut, or without cuts by value. few: by value too, while a task sees no more. inside: only values in these intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(cuts)
        held = [None if c is None else (np.zeros(len(c) + 1), np.zeros(len(c) + 1), np.full(len(c) + 1, np.inf), np.full(len(c) + 1, -np.inf)) for c in cuts]
        loose: dict[tuple[int, int, float], list[float]] = {}
        seen = [0 if few else few + 1] * k

        def add(i: int, kind: int, at: float, n: float, bad: float) -> None:
            own = loose.setdefault((i, kind, at), [0.0, 0.0])
            own[0] += n
            own[1] += bad

        for batch in batches:
            target = _column(batch, k)
            for i in range(k):
                x, y = _column(batch, i), target
                gone = np.isnan(x)
                if gone.any():
                    add(i, MISSING, 0.0, int(gone.sum()), float(y[gone].sum()))
                    x, y = x[~gone], y[~gone]
                if len(apart[i]):
                    out = np.isin(x, apart[i])
                    for v in np.unique(x[out]):
                        add(i, APART, float(v), int((x == v).sum()), float(y[x == v].sum()))
                    x, y = x[~out], y[~out]
                if inside is not None:
                    own = _within(*inside[i], x)
                    x, y = x[own], y[own]
                if not len(x):
                    continue
                if held[i] is None or seen[i] <= few:
                    values, place = np.unique(x, return_inverse=True)
                    kind = MAIN if held[i] is None else VALUE
                    if kind == VALUE and len(values) > few:
                        seen[i] = few + 1
                    else:
                        for v, n, bad in zip(values.tolist(), np.bincount(place).tolist(), np.bincount(place, y).tolist(), strict=True):
                            seen[i] += (i, kind, v) not in loose
                            add(i, kind, v, n, bad)
                if held[i] is not None:
                    n, bad, lo, hi = held[i]
                    place = np.searchsorted(cuts[i], x, side="left" if right else "right")
                    n += np.bincount(place, minlength=len(n))
                    bad += np.bincount(place, y, minlength=len(n))
                    np.minimum.at(lo, place, x)
                    np.maximum.at(hi, place, x)
        rows = [(i, kind, at, n, bad, at, at) for (i, kind, at), (n, bad) in loose.items() if kind != VALUE or seen[i] <= few]
        rows += [(i, MANY, 0.0, 1, 0, 0.0, 0.0) for i in range(k) if few and seen[i] > few]
        parts = [np.array(rows, float).reshape(-1, 7)]
        for i, own in enumerate(held):
            if own is not None:
                used = np.flatnonzero(own[0])
                parts.append(np.column_stack([np.full(len(used), i), np.zeros(len(used)), used, *(a[used] for a in own)]))
        table = np.concatenate(parts)
        if len(table):
            yield _batch(CELLS, [table[:, 0].astype(np.int32), table[:, 1].astype(np.int32), *table[:, 2:].T])

    return run


def _added(cells: DataFrame) -> DataFrame:
    sums = F.sum("n").cast("long").alias("n"), F.sum("bad").cast("long").alias("bad"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    return cells.groupBy("variable", "kind", "at").agg(*sums)


def histograms(df: DataFrame, columns: dict[str, Column], cuts: dict[str, list[float] | None], apart: dict[str, list[float]] | None = None, target: Column | None = None, right: bool = True, few: int = 0) -> dict[str, list[Row]]:
    """column -> rows (kind, at, n, bad, lo, hi) in order: of the main values by bin (at: its number, lo and hi: its least and largest
    value), or without cuts by value; of each value that stands apart; of NULLs. bad is the sum of the target."""
    if not columns:
        return {}
    names = list(columns)
    ends = [None if cuts[c] is None else np.array(cuts[c], float) for c in names]
    own = [np.array(sorted((apart or {}).get(c, ())), float) for c in names]
    cells = _added(_numbers(df, columns, target).mapInArrow(_summed(ends, own, right, few), CELLS))
    out: dict[str, list[Row]] = {c: [] for c in names}
    for r in cells.orderBy("variable", "kind", "at").collect():
        out[names[r.variable]].append(r)
    return out


def _fetched(inside: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _column(batch, len(inside))
            for i, (lo, hi) in enumerate(inside):
                x = _column(batch, i)
                own = _within(lo, hi, x)
                if own.any():
                    values, place = np.unique(x[own], return_inverse=True)
                    n, bad = np.bincount(place).astype(float), np.bincount(place, y[own])
                    yield _batch(CELLS, [np.full(len(values), i, np.int32), np.full(len(values), MAIN, np.int32), values, n, bad, values, values])

    return run


def _finer(lo: float, hi: float) -> np.ndarray:
    """Points that cut [lo, hi]; both ends become cells of their own."""
    if np.isfinite(hi - lo):
        inner = np.linspace(lo, hi, FINER + 1)[1:-1]
    else:
        inner = np.array([-1e300, -1e150, -1.0, 0.0, 1.0, 1e150, 1e300])
    points = np.unique(np.concatenate([[lo], inner, [np.nextafter(hi, -np.inf)]]))
    return points[(points >= lo) & (points < hi)]


class Survey:
    """What one pass tells about numeric columns: counts, few values, and cells of all values in order, from which exact quantiles
    and histograms at any cuts follow. Where one cuts through a cell, the values in that cell are fetched, after it has been cut
    finer if it holds many: state is bounded at any size. The cells are chosen by a sample of rows; what is counted is all rows.
    """

    def __init__(self, df: DataFrame, columns: dict[str, Column], target: Column | None = None, apart: dict[str, list[float]] | None = None, few: int = 0, total: int | None = None, at_once: int = AT_ONCE) -> None:
        """few: values are counted one by one in columns with no more distinct ones. apart: values that are counted by themselves."""
        self.names, self.at_once = list(columns), at_once
        self.rows = _numbers(df, columns, target)
        empty = np.zeros((0, 4))
        self.cells = dict.fromkeys(self.names, empty)  # n, bad, lo, hi
        self.apart: dict[str, list[tuple[float, int, int]]] = {c: [] for c in self.names}
        self.missing = dict.fromkeys(self.names, (0, 0))
        self.few: dict[str, list[tuple[float, int, int]] | None] = {c: [] if few else None for c in self.names}
        if not self.names:
            return
        total = df.count() if total is None else total
        sample = self.rows.where(F.rand(7) < min(1.0, SAMPLED / max(1, total))).toArrow()
        own = [np.array(sorted((apart or {}).get(c, ())), float) for c in self.names]
        edges = []
        for i in range(len(self.names)):
            x = sample.column(i).to_numpy()
            x = np.sort(x[~np.isnan(x) & ~np.isin(x, own[i])])
            x = np.unique(x[np.linspace(0, len(x) - 1, min(len(x), EDGES)).astype(int)]) if len(x) else x
            edges.append(np.unique(np.concatenate([x, np.nextafter(x, -np.inf)])))
        found = _added(self.rows.mapInArrow(_summed(edges, own, True, few), CELLS)).toArrow()
        of, kind, table = found["variable"].to_numpy(), found["kind"].to_numpy(), np.column_stack([found[k].to_numpy().astype(float) for k in ("at", "n", "bad", "lo", "hi")])
        for i, c in enumerate(self.names):
            part = lambda k, i=i: table[(of == i) & (kind == k)]
            self._set(c, part(MAIN)[:, 1:])
            self.apart[c] = sorted((r[0], int(r[1]), int(r[2])) for r in part(APART).tolist())
            self.missing[c] = next(((int(r[1]), int(r[2])) for r in part(MISSING).tolist()), (0, 0))
            values = part(VALUE)
            self.few[c] = None if not few or len(part(MANY)) or len(values) > few else sorted((r[0], int(r[1]), int(r[2])) for r in values.tolist())

    def _set(self, c: str, cells: np.ndarray) -> None:
        self.cells[c] = cells[np.lexsort((cells[:, 3], cells[:, 2]))]

    def n(self, c: str) -> int:
        """Main values."""
        return int(self.cells[c][:, 0].sum())

    def range(self, c: str) -> tuple[float, float] | None:
        return (float(self.cells[c][0, 2]), float(self.cells[c][-1, 3])) if len(self.cells[c]) else None

    def _resolve(self, open_cells) -> None:
        """Until no cell is open; open_cells: column -> whether each of its cells is."""
        for turn in range(ROUNDS + 1):
            wanted = {c: open_cells(c) & (self.cells[c][:, 2] < self.cells[c][:, 3]) for c in self.names}
            names = [c for c in self.names if wanted[c].any()]
            if not names:
                return
            inside = [(self.cells[c][wanted[c], 2], self.cells[c][wanted[c], 3]) for c in names]
            rows = self.rows.select(*(F.col(f"_{self.names.index(c)}") for c in names), "y")
            if turn == ROUNDS or sum(self.cells[c][wanted[c], 0].sum() for c in names) <= self.at_once:
                found = rows.mapInArrow(_fetched(inside), CELLS)
            else:
                cuts = [np.unique(np.concatenate([np.append(_finer(a, b), b) for a, b in zip(lo, hi, strict=True)])) for lo, hi in inside]
                found = rows.mapInArrow(_summed(cuts, [np.zeros(0)] * len(names), True, 0, inside), CELLS).where(F.col("kind") == MAIN)
            found = _added(found).toArrow()
            of, table = found["variable"].to_numpy(), np.column_stack([found[k].to_numpy().astype(float) for k in ("n", "bad", "lo", "hi")])
            for i, c in enumerate(names):
                self._set(c, np.concatenate([self.cells[c][~wanted[c]], table[of == i]]))

    def order_statistics(self, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
        """column -> rank (from 0, among its main values in order) -> value."""

        def at(c: str) -> np.ndarray:
            return np.searchsorted(np.cumsum(self.cells[c][:, 0]), ranks[c], side="right")

        def open_cells(c: str) -> np.ndarray:
            out = np.zeros(len(self.cells[c]), bool)
            if ranks.get(c):
                out[at(c)] = True
            return out

        self._resolve(open_cells)
        return {c: dict(zip(ranks[c], self.cells[c][at(c), 2].tolist(), strict=True)) if ranks[c] else {} for c in ranks}

    def quantiles(self, probs: dict[str, list[float]]) -> dict[str, list[float]]:
        """Exact quantiles with linear interpolation; none of a column without values."""
        places = {c: [p * (self.n(c) - 1) for p in probs[c]] if self.n(c) else [] for c in probs}
        found = self.order_statistics({c: sorted({r for at in places[c] for r in (math.floor(at), math.ceil(at))}) for c in probs})

        def value(c: str, at: float) -> float:
            lo, hi = math.floor(at), math.ceil(at)
            a, b = found[c][lo], found[c][hi]
            return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b

        return {c: [value(c, at) for at in places[c]] for c in probs}

    def edges(self, n_bins: dict[str, int]) -> dict[str, list[float]]:
        """Distinct quantiles at 0, 1/n, ..., 1."""
        return {c: sorted(set(q)) for c, q in self.quantiles({c: [i / n for i in range(n + 1)] for c, n in n_bins.items()}).items()}

    def histogram(self, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int, int, float, float]]]:
        """column -> (bin, n, bad, least, largest value) of the bins (lo, hi] that have values."""
        ends = {c: np.array(v, float) for c, v in cuts.items()}
        below = lambda c, x: np.searchsorted(ends[c], x, side="left")
        self._resolve(lambda c: below(c, self.cells[c][:, 2]) < below(c, self.cells[c][:, 3]) if c in ends else np.zeros(len(self.cells[c]), bool))
        out = {}
        for c in cuts:
            n, bad, lo, hi = self.cells[c].T
            place = below(c, hi)
            out[c] = [(int(i), int(n[place == i].sum()), int(bad[place == i].sum()), float(lo[place == i].min()), float(hi[place == i].max())) for i in np.unique(place)]
        return out
