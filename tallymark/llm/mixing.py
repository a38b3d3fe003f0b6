"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected in target / source size copies. In a fixed order within the source the expected copies
are prefix-summed, one random offset is added, and a document is emitted once per integer boundary that its interval crosses.
The order is random but fixed: by a hash of the id. Some offsets are tried, and since each takes other documents, one of them comes near
the target in words, even where a few long documents hold much of a source. A source is cut into cells by the first digits of
the hash, ranked each by itself: no task ranks a whole source.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS, MAX_COPIES, OFFSETS = (1, 2, 3), 3, 64
DIGITS = 3
"""Hexadecimal digits of the hash that make a cell."""
CELL = ["_none", "_source", "_cell"]


def offsets(seed: int) -> list[float]:
    return [x.random() for x in [random.Random(seed)] for _ in range(OFFSETS)]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_COPIES) -> DataFrame:
    """sizes: _none, _source, source_size, one row a source. Adds `target`.

    Weights repeat over the sources in code-point order, null last. All sizes are shared by weight; a target stops at `limit`
    times the source's size and the excess is shared among the others: sources are capped in the order of cap over weight
    for as long as the level that the rest would get lies above that quotient. All sums but the last division are of integers.
    """
    by_name, everything = Window.orderBy("_none", "_source"), Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_none", "_source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    place = F.array(*map(F.lit, weights))
    out = sizes.withColumns({
        "_weight": F.element_at(place, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"),
        "_cap": F.col("source_size") * limit,
    })
    out = out.withColumns({
        "_all": F.sum("source_size").over(everything),
        "_capped_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weight_left": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)),
    })
    out = out.withColumn("_full", F.col("_cap") / F.col("_weight") < (F.col("_all") - F.col("_capped_before")) / F.col("_weight_left"))
    out = out.withColumns({
        "_rest": F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0)),
        "_rest_weight": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(everything),
    })
    target = F.when(F.col("_full") | (F.col("_rest_weight") == 0), F.col("_cap").cast("double")).otherwise(
        F.col("_rest").cast("double") * F.col("_weight") / F.col("_rest_weight")
    )
    return out.select("_none", "_source", "source_size", target.alias("target"))


def copies(offset: Column) -> Column:
    """Integer boundaries that the document's interval of expected copies crosses."""
    rank = F.col("_before") + F.col("_rank")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor((rank + 1) * each + offset) - F.floor(rank * each + offset)).cast("long")


def with_copies(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", seed: int = 6) -> DataFrame:
    """docs with `size`, `source_size`, `target` and `copies`, in place of columns so named.

    A null source is a source of its own, the last; null texts have size 0; a document that occurs twice is two documents; an
    empty table gives an empty result. copies is at most MAX_COPIES. Of OFFSETS random offsets each source gets the one
    whose words come nearest its target. Reruns agree.
    """
    keyed = docs.withColumns({
        "size": n_words(F.col(text)),
        "_none": F.col(source).isNull(),
        "_source": F.coalesce(F.col(source), F.lit("")),
        "_hash": F.md5(F.coalesce(F.col(id_).cast("string"), F.lit(""))),
    }).withColumn("_cell", F.coalesce(F.substring("_hash", 1, DIGITS), F.lit("")))  # never null: else joins would look for nulls first, and count words again for that
    keyed = keyed.drop("source_size", "target", "copies")
    cells = written(keyed.groupBy(*CELL).agg(F.count("*").alias("_rows"), F.sum("size").alias("_words")), "cells")
    targets = source_targets(cells.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size")))
    in_source = Window.partitionBy("_none", "_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(in_source), F.lit(0))).join(targets, ["_none", "_source"])
    cells = cells.select(*CELL, "_before", "source_size", "target")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*CELL).orderBy("_hash", "size")) - 1)

    tried = offsets(seed)
    sums = [F.sum(F.col("size") * copies(F.lit(o))).alias(f"_{i}") for i, o in enumerate(tried)]
    taken = ranked.select(*CELL, "size", "_rank").join(cells, CELL).groupBy("_none", "_source", "target").agg(*sums)
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_{i}") - F.col("target")), F.lit(i), F.lit(o).alias("offset")) for i, o in enumerate(tried))))
    best = written(taken.select("_none", "_source", nearest["offset"].alias("_offset")), "offsets")
    cells = cells.join(best, ["_none", "_source"])
    return ranked.join(cells, CELL).withColumn("copies", copies(F.col("_offset"))).drop(*CELL, "_hash", "_before", "_rank", "_offset")


def mixed(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", seed: int = 6) -> DataFrame:
    """The mix itself: each document once per copy, with the columns of docs, whatever their names."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("text"), F.col(id_).alias("id"), F.col(source).alias("source"))
    taken = with_copies(packed, "text", "id", "source", seed).where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")
