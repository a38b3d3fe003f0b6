"""Benchmark decontamination by a prefix-filtered set join: DataFrame operations only.

A window is WINDOW consecutive words of a benchmark item (the whole item if it is shorter). Its shingles are its pairs of
neighbouring words. A document that contains the window contains all its shingles, so at a containment of 1 the necessary
prefix is one shingle: the rarest in the documents. A bitmap of those shingles is tested at every word of every document;
where it holds, the words around (at most twice a window) are joined to the windows by the shingle, windows that would begin
before the document or end after it are passed over, and the rest are compared word by word.

Documents are read twice (for shingle counts, and for candidates), never shuffled with their texts. The benchmark's shingles are
broadcast only while they number at most BROADCAST_ROWS; beyond that they are joined by shuffle. Bitmaps have at most MAX_BITS bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_array, written

WINDOW, BROADCAST_ROWS, MAX_BITS = 10, 200_000, 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALL = 1 << 30


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS), "")


def small(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def bitmap(hashes: DataFrame) -> list[int] | None:
    """A bitmap of the hashes in column h, None if they are too many for one."""
    n = hashes.limit(MAX_BITS // 4 + 1).count()
    if n > MAX_BITS // 4:
        return None
    bits = 1 << max(12, (16 * n).bit_length())
    bits = min(bits, MAX_BITS)
    cell = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1))
    out = [0] * (bits // 64)
    for at, in hashes.select(cell).distinct().collect():
        out[at >> 6] |= 1 << (at & 63)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def in_bitmap(h: Column, bits: list[int]) -> Column:
    cell = F.shiftrightunsigned(h, 64 - ((len(bits) * 64).bit_length() - 1))
    word = F.element_at(long_array(bits), (F.shiftright(cell, 6) + 1).cast("int"))
    return F.expr("1L").bitwiseAND(_shift(word, cell)) == 1


def _shift(word: Column, cell: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, cell.bitwiseAND(F.lit(63)).cast("int"))


def pair_hashes(own: Column) -> Column:
    """A hash for each word and its successor, the last with ''."""
    return F.zip_with(own, F.concat(F.slice(own, 2, ALL), F.array(F.lit(""))), lambda a, b: F.xxhash64(a, b))


def places(own: Column, bits: list[int] | None, lone: list[int] | None = None) -> Column:
    """0-based places of words whose pair (or, with lone, which themselves) may be in a bitmap."""
    if bits is None:
        return F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(pair_hashes(own), lambda h, i: F.when(in_bitmap(h, bits), i))
    if lone is not None:
        found = F.zip_with(found, own, lambda p, w: F.coalesce(p, F.when(in_bitmap(F.xxhash64(w, F.lit("")), lone), F.lit(-1))))
        found = F.transform(found, lambda p, i: F.when(p.isNotNull(), i))
    return F.array_compact(found)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item, win (words), and pairs (place, first, second) of each window; a window of one word has the pair (word, '')."""
    items = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    wins = items.select("item", F.explode(starts).alias("i"), "w").select("item", F.slice("w", F.col("i") + 1, WINDOW).alias("win")).distinct()
    inner = F.zip_with(F.slice("win", 1, F.greatest(F.size("win") - 1, F.lit(1))), F.slice("win", 2, ALL), lambda a, b: F.struct(a.alias("first"), F.coalesce(b, F.lit("")).alias("second")))
    return wins.select("item", "win", F.transform(inner, lambda p, i: F.struct(i.alias("place"), p["first"].alias("first"), p["second"].alias("second"))).alias("pairs"))


def pair_counts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """first, second, n: how often each of the pairs occurs in all documents."""
    bits = bitmap(pairs.select(F.xxhash64("first", "second").alias("h")))
    own = docs.select(words(F.col("text")).alias("w"))
    own = own.select(F.transform(places(F.col("w"), bits), lambda i: F.struct(F.get("w", i).alias("first"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("second"))).alias("p"))
    own = own.select(F.inline_outer("p")).where("first IS NOT NULL")  # inline() would have p computed once more, in a filter
    return own.groupBy("first", "second").agg(F.count("*").alias("n")).join(small(pairs), ["first", "second"])


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """first, second, wins: the windows whose rarest pair it is, with the pair's place in each (ties: by the pair, then the place)."""
    each = windows.select("item", "win", F.explode("pairs").alias("p")).select("item", "win", "p.*")
    each = each.join(counts, ["first", "second"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "first", "second", "place"))
    chosen = each.groupBy("item", "win").agg(rarest.alias("r"))
    held = F.collect_list(F.struct("item", F.col("r.place").alias("place"), "win")).alias("wins")
    return chosen.groupBy("r.first", "r.second").agg(held)


def marked(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, n_words, n_hit, n_items, items (sorted ids of items with occurring windows) for each row of docs.

    Null texts have no words, and items without words no windows; an item with a null id marks words but is in no list.
    Equal rows and equal ids get results of their own; an empty table of documents gives an empty result, and an empty
    benchmark no hits.
    """
    windows = written(benchmark_windows(benchmark), "windows")
    pairs = windows.select(F.inline("pairs")).select("first", "second").distinct()
    chosen = written(prefixes(windows, pair_counts(docs, pairs)), "prefixes")
    hashed = chosen.select(F.xxhash64("first", "second").alias("h"), "second")
    lone = chosen.where("second = ''").limit(1).count() > 0
    bits = bitmap(hashed.where("second != ''"))
    lone_bits = bitmap(hashed.where("second = ''")) if lone else None
    if lone and lone_bits is None:  # too many for a bitmap: every place is to be joined, whatever its pair
        bits = None

    own = docs.select(*columns, words(F.col("text")).alias("w"))
    reach = WINDOW - 2
    around = lambda i: F.struct(
        i.alias("place"), F.greatest(i - reach, F.lit(0)).alias("from"), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, reach + WINDOW).alias("near")
    )
    found = own.select(*columns, F.monotonically_increasing_id().alias("_row"), F.size("w").cast("long").alias("n_words"), F.transform(places(F.col("w"), bits, lone_bits), around).alias("near"))
    found = written(found, "candidates")

    near = found.select("_row", "n_words", F.inline("near"))
    at = F.col("place") - F.col("from") + 1
    near = near.select("*", F.element_at("near", at).alias("first"), F.coalesce(F.try_element_at("near", at + 1), F.lit("")).alias("second"))
    if lone:
        both = F.array_distinct(F.array(F.col("second"), F.lit("")))
        near = near.withColumn("second", F.explode(both))
    near = near.withColumnRenamed("place", "at").join(small(chosen), ["first", "second"])

    def occurs(w: Column) -> Column:
        start = F.col("at") - w["place"]
        inside = (start >= 0) & (start + F.size(w["win"]) <= F.col("n_words"))
        return F.when(inside, F.slice("near", start - F.col("from") + 1, F.size(w["win"])) == w["win"]).otherwise(F.lit(False))

    hits = near.withColumn("wins", F.filter("wins", occurs)).where(F.size("wins") > 0)
    spans = F.transform("wins", lambda w: F.struct((F.col("at") - w["place"]).alias("s"), (F.col("at") - w["place"] + F.size(w["win"])).alias("e")))
    hits = hits.select("_row", F.array_distinct(spans).alias("spans"), F.array_distinct(F.transform("wins", lambda w: w["item"].cast("string"))).alias("items"))
    hits = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("items"))))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["end"], s["s"]))).alias("n")),
    )["n"]
    hits = hits.select("_row", covered.cast("long").alias("n_hit"), "items")
    out = found.select("_row", *columns, "n_words").join(hits, "_row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*columns, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
