"""Removal of repeated passages: a distributed merge sort of suffixes, with common prefixes known throughout.

A passage is LENGTH bytes. Sorting every suffix is not needed: each passage has an anchor, the place in it of the GRAM bytes of
least hash (the leftmost of equals), and equal passages have their anchors at the same place. So only suffixes that start at anchors are
sorted, about one in 35, each up to the end of the last passage that it anchors and followed by the bytes before it down to the
first such passage: equal strings mean that all passages of two anchors are equal.

1. Hashes of all anchors are counted; an anchor whose hash occurs once anchors no repeated passage and is left out. The hashes that
   repeat go to the tasks as a bitmap of their last bits, of 16 bits each up to 2 ** MOST_BITS in all: what it lets through
   too much costs work, never a result.
2. Each task sorts its suffixes into runs, keeps the earliest of equal ones, and sends the runs, front-coded, to ranges of the order
   (splitters are sampled grams, so suffixes with the same gram meet).
3. A loser tree merges the runs of a range without comparing known prefixes again. Equal strings give up all passages but the
   earliest's. Among different strings with one gram, passages are compared one by one; where a gram has more than
   GROUP_LIMIT strings, its passages go on as rows, by a 128-bit hash, so that no task holds them.
4. The ranges of bytes, joined in each task where they touch, are gathered by document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .runs import Entry, decode, encode, merge
from .shingles import BLOCK_BYTES, U64, _powers, mix

LENGTH, GRAM = 100, 32
RUN_ENTRIES, GROUP_LIMIT = 60_000, 50_000
BITS_EACH, MOST_BITS = 16, 29
SAMPLED, PER_TASK, RANGE_ENTRIES = 16_384, 256, 250_000
NO_ID = -(1 << 63)
FOUND = "doc long, row long, start long, end long, h1 long, h2 long"


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each anchor of some texts, in order: text, hash, place, first passage and last passage (places in its text)."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64)
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    up, down = _powers(1 << max(16, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((data + U64(1)) * up[: len(data)], dtype=U64)])
    least = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    hashes, place, span = least, np.arange(len(least), dtype=np.int32 if len(least) < 1 << 31 else np.int64), 1
    while span < width:  # the least of `span` hashes from each place, and where it is
        step = min(span, width - span)
        left = least[:-step] <= least[step:]
        least, place = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
        span += step
    of = np.repeat(np.arange(len(raw)), sizes)
    starts = np.flatnonzero(of[:n] == of[LENGTH - 1 :])
    at, owner = place[starts], of[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else np.zeros(0, np.int64)
    base = (np.cumsum(sizes) - sizes)[owner[new]]
    last = starts[np.append(new[1:], len(starts))[: len(new)] - 1] if len(new) else starts
    return owner[new], hashes[at[new]], at[new] - base, starts[new] - base, last - base


def text_blocks(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    group, raw, held = [], [], 0
    for i, text in enumerate(texts):
        own = text.encode()
        if group and held + len(own) > BLOCK_BYTES:
            yield group, raw
            group, raw, held = [], [], 0
        group.append(i)
        raw.append(own)
        held += len(own)
    if group:
        yield group, raw


def _anchor_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hash and n of each frame's anchors; gram too for the task's PER_TASK least hashes."""
    sample: dict[int, bytes] = {}
    for frame in frames:
        found = []
        for _, raw in text_blocks(frame["text"].tolist()):
            of, hashes, place, _, _ = anchors(raw)
            found.append(hashes)
            for j in np.argsort(hashes)[:PER_TASK]:
                sample[int(hashes[j])] = raw[of[j]][place[j] : place[j] + GRAM]
        sample = dict(sorted(sample.items())[:PER_TASK])
        if found:
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"hash": hashes.view(np.int64), "n": n, "gram": None})
    if sample:
        yield pd.DataFrame({"hash": np.array(list(sample), U64).view(np.int64), "n": 0, "gram": list(sample.values())})


def joined(spans: np.ndarray) -> np.ndarray:
    """Rows (doc, row, start, end) in order, those of one text that touch or overlap made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    new = np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])
    text = np.cumsum(new) - 1
    reach = int(spans[:, 3].max()) + 1
    upto = np.maximum.accumulate(spans[:, 3] + text * reach) - text * reach  # the end so far in the text
    first = np.flatnonzero(new | np.concatenate([[True], spans[1:, 2] > upto[:-1]]))
    out = spans[first].copy()
    out[:, 3] = upto[np.append(first[1:], len(spans)) - 1]
    return out


def _bitmap(repeated: DataFrame, n: int, most: int) -> tuple[int, np.ndarray]:
    """(bits, map): whether a hash has the last `bits` bits of one of n repeated hashes; built on the executors.

    The last ones, since anchors are the least hashes of their passages and so share their first bits.
    """
    bits = max(15, min(most, (BITS_EACH * max(1, n)).bit_length()))
    last = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    rows = repeated.select(F.shiftright(last, 15).alias("part"), F.bitmap_bit_position(last % 32768 + 1).alias("at"))
    held = rows.groupBy("part").agg(F.bitmap_construct_agg("at").alias("map")).toArrow()
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for part, own in zip(held["part"].to_pylist(), held["map"], strict=True):
        out[part] = np.frombuffer(own.as_py(), np.uint8)
    return bits, out.ravel()


def _runs(known, splitters: list[bytes]):
    """Front-coded runs of the task's suffixes with repeated anchors, a row for each range; and ranges already known to repeat."""
    bounds = np.array(splitters, dtype=object)

    def flush(entries: list[Entry]) -> Iterator[tuple[int, bytes, bytes | None]]:
        entries.sort()
        kept: list[Entry] = []
        again: list[tuple[int, int, int, int]] = []
        for e in entries:  # of equal strings, the earliest comes first
            if kept and kept[-1][0] == e[0] and kept[-1][1] == e[1]:
                again.append((e[2], e[3], e[4] + e[1] - len(e[0]), e[4] + e[1]))
            else:
                kept.append(e)
        cuts = np.searchsorted(bounds, np.array([e[0][:GRAM] for e in kept], dtype=object), side="right") if len(kept) else []
        edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(kept)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield int(cuts[a]), encode(kept[a:b]), None
        if again:
            yield again[0][0] % (len(splitters) + 1), b"", joined(np.array(again, np.int64)).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, held = known.value
        entries: list[Entry] = []
        for frame in frames:
            docs, rows = frame["doc"].tolist(), frame["row"].tolist()
            for group, raw in text_blocks(frame["text"].tolist()):
                of, hashes, place, first, last = anchors(raw)
                at = hashes & U64((1 << bits) - 1)
                keep = np.flatnonzero(held[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1)
                for t, p, s1, s2 in zip(of[keep].tolist(), place[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                    text, end = raw[t], s2 + LENGTH
                    entries.append((text[p:end] + text[s1:p], end - p, docs[group[t]], rows[group[t]], p))
                if len(entries) >= RUN_ENTRIES:
                    yield pd.DataFrame(list(flush(entries)), columns=["part", "run", "again"])
                    entries = []
        if entries:
            yield pd.DataFrame(list(flush(entries)), columns=["part", "run", "again"])

    return run


def _passages(e: Entry) -> Iterator[tuple[int, bytes]]:
    """Start and bytes of each passage that an entry anchors."""
    string, split, _, _, place = e
    before = len(string) - split
    text = string[split:] + string[:split]
    for s in range(len(text) - LENGTH + 1):
        yield place - before + s, text[s : s + LENGTH]


def compared(group: list[Entry]) -> Iterator[tuple[int, int, int, int]]:
    """doc, row, start, end of bytes of passages that occur earlier, among different strings with one gram."""
    seen: set[bytes] = set()
    for e in sorted(group, key=lambda e: e[2:]):
        open_, end = None, None
        for start, passage in _passages(e):
            if passage in seen:
                open_ = start if open_ is None else open_
                end = start + LENGTH
            else:
                seen.add(passage)
                if open_ is not None:
                    yield e[2], e[3], open_, end
                    open_ = None
        if open_ is not None:
            yield e[2], e[3], open_, end


def _merged(limit: int):
    def resolve(runs: list[bytes]) -> Iterator[tuple]:
        """Rows of FOUND for one range of the order."""
        group: list[Entry] = []
        over, before, equal = False, b"", {}

        def as_rows(entries: list[Entry]) -> Iterator[tuple]:
            for e in entries:
                for start, passage in _passages(e):
                    h = np.frombuffer(blake2b(passage, digest_size=16).digest(), np.int64)
                    yield e[2], e[3], start, start + LENGTH, int(h[0]), int(h[1])

        def close_equal() -> Iterator[tuple]:
            """Of equal strings (by where they split) all but the earliest are given up; the earliest joins the group."""
            nonlocal equal, over, group
            for split, own in equal.items():
                own.sort(key=lambda e: e[2:])
                group.append(own[0])
                for string, _, doc, row, place in own[1:]:
                    yield doc, row, place + split - len(string), place + split, None, None
            equal = {}
            if over or len(group) > limit:
                over = True
                yield from as_rows(group)
                group = []

        def close_group() -> Iterator[tuple]:
            nonlocal over, group
            yield from close_equal()
            if len(group) > 1:
                for doc, row, start, end in compared(group):
                    yield doc, row, start, end, None, None
            over, group = False, []

        for h, e in merge([decode(r) for r in runs]):
            if h < GRAM:
                yield from close_group()
            elif h < len(e[0]) or h < len(before):
                yield from close_equal()
            equal.setdefault(e[1], []).append(e)
            before = e[0]
        yield from close_group()

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, runs, out, spans = None, [], [], []
        columns = [x.split()[0] for x in FOUND.split(", ")]

        def ready(force: bool = False) -> Iterator[pd.DataFrame]:
            """What was found, spans of one text joined as far as they are at hand."""
            if len(out) + len(spans) < 200_000 and not force:
                return
            if spans:
                own = pd.DataFrame(joined(np.array(spans, np.int64)), columns=columns[:4])
                yield own.assign(h1=None, h2=None)
                spans.clear()
            if out:
                yield pd.DataFrame(out, columns=columns)
                out.clear()

        def add(row: tuple) -> None:
            spans.append(row[:4]) if row[4] is None else out.append(row)

        for frame in frames:
            for p, run, again in frame.itertuples(index=False):
                if p != part:
                    for row in resolve(runs):
                        add(row)
                        yield from ready()
                    part, runs = p, []
                if run:
                    runs.append(run)
                if again is not None:
                    spans.extend(map(tuple, np.frombuffer(again, np.int64).reshape(-1, 4).tolist()))
                    yield from ready()
        for row in resolve(runs):
            add(row)
            yield from ready()
        yield from ready(True)

    return merged


def keyed(docs: DataFrame, text: str, id_: str) -> DataFrame:
    """doc, row, text: doc is the id (a null comes first), row tells rows of one id apart (0 where ids are unique)."""
    own = docs.select(F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if own.groupBy("doc").count().where("count > 1").limit(1).count() == 0:
        return own.select("doc", F.lit(0).cast("long").alias("row"), "text")
    return written(own.select("doc", F.monotonically_increasing_id().alias("row"), "text"), "rows")


def repeated_spans(own: DataFrame, group_limit: int = GROUP_LIMIT, most_bits: int = MOST_BITS) -> DataFrame:
    """doc, row, start, end of bytes to remove; spans of one document may touch or overlap."""
    spark = own.sparkSession
    found = written(own.select("text").mapInPandas(_anchor_rows, "hash long, n long, gram binary"), "anchors")
    repeated = written(found.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    n, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ENTRIES)
    sample = found.where("gram IS NOT NULL").select("hash", "gram").orderBy("hash").limit(SAMPLED).collect()
    grams = sorted({bytes(r.gram) for r in sample})
    splitters = sorted({grams[len(grams) * i // parts] for i in range(1, parts)}) if grams else []
    known = spark.sparkContext.broadcast(_bitmap(repeated, n, most_bits))
    discard(found)
    discard(repeated)

    runs = own.mapInPandas(_runs(known, splitters), "part int, run binary, again binary")
    runs = runs.repartition(parts, "part").sortWithinPartitions("part")
    out = written(runs.mapInPandas(_merged(group_limit), FOUND), "spans")
    passages = out.where("h1 IS NOT NULL")
    spans = out.where("h1 IS NULL").select("doc", "row", "start", "end")
    if passages.limit(1).count():
        first = passages.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "start")).alias("first"))
        later = passages.join(first, ["h1", "h2"]).where(F.struct("doc", "row", "start") != F.col("first"))
        spans = spans.union(later.select("doc", "row", "start", "end"))
    return spans


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text, spans in zip(frame["doc"], frame["text"], frame["spans"], strict=True):
            raw = text.encode()
            kept, at, removed = [], 0, 0
            own = [] if spans is None else joined(np.array([(0, 0, s["start"], s["end"]) for s in spans], np.int64)).tolist()
            for _, _, start, end in own:
                kept.append(raw[at:start])
                removed += end - start
                at = end
            kept.append(raw[at:])
            rows.append((doc, len(raw), removed, len(own), b"".join(kept)))
        yield pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, text: str = "text", id_: str = "doc_id", **options: int) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the remaining bytes, concatenated) of each row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller id, or earlier in the same text.
    Null texts are empty. Rows with one id keep their own results and come in some fixed order among themselves; a null id
    comes before all others. Texts shorter than LENGTH lose nothing; an empty table gives an empty result.
    """
    own = keyed(docs, text, id_)
    spans = repeated_spans(own, **options).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = own.join(spans.hint("merge"), ["doc", "row"], "left").select("doc", "text", "spans")  # by shuffle at every size
    out = out.mapInPandas(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias(id_), "n_bytes", "n_removed", "n_spans", "kept")
