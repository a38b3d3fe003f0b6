"""Sharding by sampled splitters: DataFrame operations only.

Records are ordered by (hash of the text, id), so equal texts are neighbours. A sample of that key, drawn with probability in
proportion to size, gives quantile boundaries of many more ranges than there are shards; a key that fills several quantiles
(a group of copies) has its boundary repeated, and its records are subdivided among those ranges by a hash of the id. Ranges
that turn out to hold more than OVERFULL times their due (a single record aside) are subdivided by a sample of their own, until none is left or
ROUNDS are over. Exact sizes of the ranges then give each record its place in the whole order, and the place decides the shard.

Only the samples (at most about SAMPLE_PER_RANGE * MAX_RANGES rows a round), the sizes of the ranges and one number per shard
reach the driver, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, uniform

MAX_RANGES, SAMPLE_PER_RANGE, ROWS_PER_RANGE = 4096, 32, 20_000
OVERFULL, ROUNDS = 2, 4
LARGE_GROUP = 0.01
"""Equal texts of at most this part of a shard stay together; larger groups are cut where the shard is full."""


def record_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def quantile_bounds(sample: list[tuple[int, int]], ranges: int) -> list[int]:
    """Boundaries of `ranges` ranges of near-equal weight; sample: (key, weight) in any order."""
    sample = sorted(sample)
    sums = list(accumulate(w for _, w in sample))
    if not sums:
        return []
    return [sample[bisect_left(sums, sums[-1] * j / ranges)][0] for j in range(1, ranges)]


def below(key: Column, bounds: list[int], or_equal: bool = False) -> Column:
    """How many of the sorted bounds are below (or equal to) the key, by binary search in a constant array."""
    steps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]
    full = long_array(bounds + [(1 << 63) - 1] * (2 * steps[0] - 1 - len(bounds)))

    def step(at: Column, by: Column) -> Column:
        bound = F.element_at(full, at + by)
        return at + F.when((bound <= key) if or_equal else (bound < key), by).otherwise(F.lit(0))

    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
    return F.least(found, F.lit(len(bounds)))


def _ranged(keyed: DataFrame, bounds: list[int]) -> DataFrame:
    """keyed with the `_range` of each record: 0 to len(bounds). A key that is a boundary several times is dealt among the ranges there by _sub."""
    low, high = below(F.col("_key"), bounds), below(F.col("_key"), bounds, or_equal=True)
    spread = F.col("_low") + F.pmod(F.col("_sub"), (F.col("_high") - F.col("_low") + 1).cast("long")).cast("int")
    return keyed.withColumns({"_low": low, "_high": high}).withColumn("_range", spread).drop("_low", "_high")


def _sizes(keyed: DataFrame, bounds: list[int]) -> dict[int, tuple[int, int, int]]:
    """Size, rows and largest record of each range that has rows."""
    return {r[0]: tuple(r[1:]) for r in _ranged(keyed, bounds).groupBy("_range").agg(F.sum("size"), F.count("*"), F.max("size")).collect()}


def assign_shards(docs: DataFrame, shards: int = 16, text: str = "text", id_: str = "doc_id", seed: int = 8) -> DataFrame:
    """docs with `size`, `shard` (0 to shards - 1) and `slot` (0, 1, ... within each shard), in place of columns so named.

    Law `bytes`: the shards' summed sizes differ by about LARGE_GROUP of a shard or the largest record. Null texts count as
    empty; equal rows get different slots; null ids are ids like others; an empty table gives an empty result. Reruns agree
    but for the order of rows that are equal throughout.
    """
    keyed = docs.withColumns({
        "size": record_size(F.col(text)),
        "_key": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "_sub": F.xxhash64(F.lit(seed), F.col(id_)),
    })
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(4 * shards, rows // ROWS_PER_RANGE + 1))
    rate = ranges * SAMPLE_PER_RANGE / max(1, total)
    drawn = keyed.select("_key", F.floor(F.col("size") * rate + uniform("_key", "_sub", seed=seed)).alias("w")).where("w > 0")
    sample = drawn.groupBy("_key").agg(F.sum("w").alias("w")).collect()
    bounds = quantile_bounds([tuple(r) for r in sample], ranges)

    due = -(-total // ranges)
    for turn in range(ROUNDS):
        held = _sizes(keyed, bounds)
        overfull = {r for r, (size, _, largest) in held.items() if size > OVERFULL * due and size - largest > due}
        if turn == ROUNDS - 1 or not overfull:
            break
        own = _ranged(keyed, bounds).where(F.element_at(long_array([int(r in overfull) for r in range(len(bounds) + 1)]), F.col("_range") + 1) == 1)
        own = own.select("_range", "_key", F.floor(F.col("size") * (SAMPLE_PER_RANGE / due) + uniform("_key", "_sub", seed=seed + turn + 1)).alias("w"))
        finer: dict[int, list[tuple[int, int]]] = {}
        for r, key, w in own.where("w > 0").groupBy("_range", "_key").agg(F.sum("w").alias("w")).collect():
            finer.setdefault(r, []).append((key, w))
        added = [x for r, rows in finer.items() for x in quantile_bounds(rows, -(-held[r][0] // due))]
        if not added:
            break
        bounds = sorted(bounds + added)
    keyed = _ranged(keyed, bounds)
    per_range = [held.get(r, (0, 0, 0)) for r in range(len(bounds) + 1)]
    size_before = [0, *accumulate(s for s, _, _ in per_range)][: len(per_range)]
    rows_before = [0, *accumulate(n for _, n, _ in per_range)][: len(per_range)]

    order = Window.partitionBy("_range").orderBy("_key", "_sub", id_)
    group = Window.partitionBy("_range", "_key")
    placed = keyed.withColumns({
        "_end": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_rank": F.row_number().over(order),
    }).withColumns({"_first": F.min(F.col("_end") - F.col("size")).over(group), "_group": F.sum("size").over(group)})
    whole = F.col("_group") <= LARGE_GROUP * total / shards
    middle = F.when(whole, F.col("_first") * 2 + F.col("_group")).otherwise(F.col("_end") * 2 - F.col("size"))
    at = F.col("_range") + 1
    placed = placed.withColumns({
        "shard": F.least(F.lit(shards - 1), F.floor((F.element_at(long_array(size_before), at) * 2 + middle) * (shards / max(1, 2 * total)))).cast("int"),
        "_rank": F.element_at(long_array(rows_before), at) + F.col("_rank") - 1,
    })
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_rank")).collect()}
    starts = long_array([first.get(s, 0) for s in range(shards)])
    slotted = placed.withColumn("slot", F.col("_rank") - F.element_at(starts, F.col("shard") + 1))
    return slotted.drop("_key", "_sub", "_range", "_end", "_rank", "_first", "_group")
