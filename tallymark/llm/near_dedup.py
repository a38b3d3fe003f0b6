"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, in bands, verified by weighted Jaccard similarity.

Shingles are five words. A shingle weighs 1 + ln of its count in the text, so that one line repeated hundreds of times does not make
texts alike, times an inverse document frequency between 1 and 1 + DAMPING; document frequencies of all documents come from a sketch of 2 ** SKETCH_BITS counters, less its mean load. The damping keeps the weighted
similarity close to the plain one (of sets of shingles): in a group of thousands of near copies, what they share is frequent, and undamped weights
would hide it. A pair is linked if its weighted Jaccard similarity is THRESHOLD or more.

1. Equal texts become one node. Each node gets SAMPLES samples in BANDS bands; at 0.8, all bands miss with 1 - 0.64 each, 0.0003 in all.
2. Nodes of a band's bucket are joined to the bucket's smallest node; components of that graph hold all candidates, without pairs.
   Buckets of texts that share a line chain most of a corpus into one component. In components of over WHOLE nodes, nodes of a bucket
   are joined only where they share a token of their prefixes too, the rarest tokens of a text that make up a fifth of its weight.
   Two texts of similarity THRESHOLD share one, so no such pair is lost, whatever the bucket's size. Buckets of up to BUCKET nodes
   are joined in one pass over their nodes' tokens; in larger ones, nodes are joined that tokens connect, directly or by others.
3. Nodes of a component are ordered by signature and compared, all pairs within CHUNK nodes, with the last OVERLAP nodes of the
   chunk before. Components of up to WHOLE nodes stay together and are compared in full, block by block; in larger ones a second, different order
   links what the first one separates.
4. In a larger component, the nodes outside its largest class so far are then compared with all nodes that share a band with one of
   them, in a join of blocks of up to about ROUND nodes or ROUND_BYTES of text a side: no link between nodes of a common band is left
   out, whatever the component's size.
5. Components of the verified links are the classes. Texts of nodes that share a bucket are kept once, and read from there by each step.

Memory per task: the sketch, two blocks of texts, one chunk's shingles, the prefixes of BUCKET texts. No larger bucket, component or class meets in one task, and no text
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .shingles import U64, Block, blocks, mix

THRESHOLD, DAMPING = 0.8, 0.25
SAMPLES, BANDS = 16, 8
SKETCH_BITS, SEGMENTS = 20, 64
CHUNK, OVERLAP, WHOLE, BUCKET = 64, 16, 512, 256
ROUND, ROUND_BYTES = 2048, 16 << 20
BROADCAST_ROWS = 200_000


def digest(text: Column) -> Column:
    """What tells different texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for frame in frames:
        n += len(frame)
        for block in blocks(frame["text"].tolist()):
            counts += np.bincount(_cells(block.hash), minlength=len(counts))
    parts = np.split(counts, SEGMENTS)
    yield pd.DataFrame({"segment": range(SEGMENTS), "docs": [n] + [0] * (SEGMENTS - 1), "counts": [x.tobytes() for x in parts]})


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list] = {}
    for frame in frames:
        for segment, docs, counts in frame.itertuples(index=False):
            own = held.setdefault(segment, [0, 0])
            own[0] += docs
            own[1] = own[1] + np.frombuffer(counts, np.int64)
    yield pd.DataFrame([(k, d, c.tobytes()) for k, (d, c) in held.items()], columns=["segment", "docs", "counts"])


def idf(texts: DataFrame) -> np.ndarray:
    """The weight of a shingle by its cell of the sketch: 2 ** SKETCH_BITS numbers, whatever the input."""
    schema = "segment int, docs long, counts binary"
    rows = texts.mapInPandas(_sketch, schema).repartition(SEGMENTS, "segment").mapInPandas(_summed, schema).collect()
    if not rows:
        return np.full(1 << SKETCH_BITS, 1 + DAMPING, np.float32)
    total = max(2, sum(r.docs for r in rows))
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in sorted(rows)])
    frequency = np.clip(counts - counts.mean(), 1, total)
    return (1 + DAMPING * (1 - np.log(frequency) / np.log(total))).astype(np.float32)


def _unit(bits: np.ndarray) -> np.ndarray:
    """32 bits each as a number above 0, up to 1."""
    return (bits.astype(np.float32) + np.float32(1)) * np.float32(2.0**-32)


def signatures(block: Block, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the block that have shingles, and BANDS band keys of each.

    Sample k of a text: each shingle of weight S draws r and c from Gamma(2, 1) and b from U(0, 1) by its hash; with
    t = floor(ln S / r + b) and ln y = r (t - b), the shingle of least c / (y e^r) and its t are the sample. Two texts agree
    in it with a probability of their weighted Jaccard similarity.
    """
    texts, starts = np.unique(block.text, return_index=True)
    sizes = np.diff(np.append(starts, len(block.text)))
    log_weight = np.log((1 + np.log(block.count.astype(np.float32))) * weights[_cells(block.hash)])
    keys = np.zeros((len(texts), BANDS), U64)
    low = U64(0xFFFFFFFF)
    for k in range(SAMPLES if len(texts) else 0):
        z1 = mix(block.hash + U64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        z2 = mix(z1 ^ U64(0xD1B54A32D192ED03))
        r = -np.log(_unit(z1 & low) * _unit(z1 >> U64(32)))
        c = -np.log(_unit(z2 & low) * _unit(z2 >> U64(32)))
        b = _unit((z1 ^ z2 * U64(0xBF58476D1CE4E5B9)) >> U64(32))
        r, c = np.maximum(r, np.float32(1e-9)), np.maximum(c, np.float32(1e-9))
        t = np.floor(log_weight / r + b)
        a = np.log(c) - r * (t - b) - r
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        owner = np.searchsorted(starts, least, side="right") - 1
        chosen = least[np.unique(owner, return_index=True)[1]]
        sample = mix(block.hash[chosen] + t[chosen].astype(np.int64).view(U64) * U64(0xD6E8FEB86659FD93))
        band = k % BANDS
        keys[:, band] = mix(keys[:, band] * U64(31) + sample + U64(band + 1))
    return texts, keys.view(np.int64)


def _signed(weights):
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys: list = [None] * len(frame)
            for block in blocks(frame["text"].tolist()):
                for i, own in zip(*signatures(block, weights.value), strict=True):
                    keys[block.texts[i]] = own
            yield pd.DataFrame({"node": frame["node"], "bands": [[] if x is None else x for x in keys]})

    return sign


Member = tuple[np.ndarray, np.ndarray]
"""Tokens of a text and what each weighs.

A token is a shingle and the number of its occurrence in the text; the k-th occurrence weighs ln k - ln (k - 1) times as much
as the first, so sums of minima are sums over common tokens.
"""


def similar(chunk: list[Member], old: int) -> list[tuple[int, int]]:
    """Pairs (i, j), i < j and j >= old, of similar members of a chunk."""
    tokens, weight = (np.concatenate([m[k] for m in chunk]) for k in range(2))
    owner = np.repeat(np.arange(len(chunk)), [len(m[0]) for m in chunk])
    found, first, place, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    common = times[place] > 1
    rows, columns, own = owner[common], column[place[common]], weight[first[times > 1]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    shared = np.zeros((len(chunk), len(chunk)))
    width = 1 << 13
    for at in range(0, len(own), width):
        lo, hi = np.searchsorted(columns, [at, at + width])
        x = np.zeros((len(chunk), min(width, len(own) - at)), np.float32)
        x[rows[lo:hi], columns[lo:hi] - at] = 1
        shared += (x * own[at : at + width]) @ x.T
    size = np.bincount(owner, weight, len(chunk))
    alike = shared >= (THRESHOLD - 1e-6) * (size[:, None] + size[None, :] - shared)
    i, j = np.nonzero(np.triu(alike, 1))
    return [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if b >= old]


def _members(texts: list[str], weights: np.ndarray) -> list[Member]:
    out: list = [(np.zeros(0, U64), np.zeros(0, np.float32))] * len(texts)
    for block in blocks(texts):
        which, starts = np.unique(block.text, return_index=True)
        for i, a, b in zip(which, starts, np.append(starts[1:], len(block.text)), strict=True):
            hashes, counts = block.hash[a:b], block.count[a:b]
            weight = weights[_cells(hashes)]
            if counts.max() > 1:
                turn = np.concatenate([np.arange(n) for n in counts])
                hashes, weight = np.repeat(hashes, counts), np.repeat(weight, counts)
                hashes = np.where(turn > 0, mix(hashes + turn.astype(U64)), hashes)
                weight = weight * np.where(turn > 0, np.log1p(turn) - np.log(np.maximum(turn, 1)), 1).astype(np.float32)
            out[block.texts[i]] = hashes, weight
    return out


def prefix(member: Member) -> np.ndarray:
    """The first tokens of a text, heaviest (rarest) first, without which what is left weighs less than THRESHOLD of the whole.

    The order is one of tokens, the same in every text. Of two similar texts, what they share weighs THRESHOLD of either or
    more, so the first token that they share is in both prefixes.
    """
    tokens, weight = member
    order = np.lexsort((tokens, -weight))
    own = weight[order].astype(np.float64)
    left = own[::-1].cumsum()[::-1]
    return tokens[order[left >= (THRESHOLD - 1e-5) * own.sum()]]


def _prefixed(weights):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                tokens = [prefix(x).view(np.int64) for x in _members(part["text"].tolist(), weights.value)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "root": part["root"].to_numpy(), "tokens": tokens})

    return cut


def _verified(weights):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rest, done, whole = None, [], 0, False
        pairs: list[tuple[bytes, bytes]] = []

        def compare() -> None:
            nonlocal rest, done
            if len(rest) > done:
                pairs.extend((rest[i][0], rest[j][0]) for i, j in similar([m for _, m in rest], done))
            rest, done = (rest, len(rest)) if whole else (rest[-OVERLAP:], min(OVERLAP, len(rest)))

        for frame in frames:
            texts = frame["text"].tolist()
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                for root, node, small, member in zip(part["root"], part["node"], part["small"], _members(texts[at : at + CHUNK], weights.value), strict=True):
                    if root != group:
                        compare()
                        group, rest, done, whole = root, [], 0, small
                    if not rest or rest[-1][0] != node:
                        rest.append((node, member))
                    if len(rest) - done >= CHUNK:
                        compare()
            yield pd.DataFrame(pairs, columns=["a", "b"])
            pairs.clear()
        compare()
        yield pd.DataFrame(pairs, columns=["a", "b"])

    return verify


def _against(weights):
    """Links between a block of outsiders and a block of other nodes of their component."""

    def compare(outsiders: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        pairs: list[tuple[bytes, bytes]] = []
        if len(outsiders) and len(others):
            nodes, theirs = outsiders["_node"].tolist(), _members(outsiders["_text"].tolist(), weights.value)
            for at in range(0, len(others), CHUNK):
                part = others.iloc[at : at + CHUNK]
                own, ids = _members(part["text"].tolist(), weights.value), part["node"].tolist()
                for b in range(0, len(nodes), CHUNK):
                    held = theirs[b : b + CHUNK]
                    pairs += [(nodes[b + i], ids[j - len(held)]) for i, j in similar(held + own, len(held)) if i < len(held)]
        return pd.DataFrame(pairs, columns=["a", "b"])

    return compare


def _outsiders(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of large components (node, root, ...) that are outside the component's largest class in roots (node, root)."""
    classed = large.select("node", "root").join(roots.withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = classed.groupBy("root", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    return large.join(classed.join(largest, "root").where("class != largest").select("node"), "node", "left_semi")


def _rest_links(texts: DataFrame, weights) -> DataFrame:
    """Links of the outsiders among texts (node, root, outside, text) with all of texts of the same root."""
    bytes_ = F.sum(F.octet_length("text"))
    parts = F.greatest(F.ceil(F.count("*") / ROUND), F.ceil(bytes_ / ROUND_BYTES), F.lit(1)).cast("int")
    blocks_, cells = (texts.where(c).groupBy("root").agg(parts.alias(name)) for c, name in (("outside", "blocks"), ("true", "cells")))
    counts = blocks_.join(cells, "root")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keyed = texts.join(counts, "root")
    named = [F.col(c).alias(f"_{c}") for c in ("root", "node", "text")]
    outsiders = keyed.where("outside").select(*named, part("blocks").alias("block"), every("cells").alias("cell"))
    others = keyed.select("root", "node", "text", part("cells").alias("cell"), every("blocks").alias("block"))
    sides = outsiders.groupBy("_root", "block", "cell").cogroup(others.groupBy("root", "block", "cell"))
    return sides.applyInPandas(_against(weights), "a binary, b binary")


def _few(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found (node, ...) with the text of each node; the nodes are broadcast while they are few."""
    return texts.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "node")


def _texts(own: DataFrame, found: DataFrame) -> DataFrame:
    """node, text of each of found (node, id), from a row of that id alone: copies meet in no task."""
    found = found.select(F.col("node").alias("_node"), F.col("id").alias("_id"))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = own.join(found, (own["node"] == found["_node"]) & own["id"].eqNullSafe(found["_id"]), "left_semi")
    return rows.select("node", "text").dropDuplicates(["node"])


def _hubs(rows: DataFrame, key: str) -> DataFrame:
    """key and hub (the smallest node) of each key of rows (key, node) that has several nodes."""
    return rows.groupBy(key).agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub != _last").drop("_last")


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Edges (a, b) that connect all nodes of rows (key, node) that share a key."""
    return rows.join(_hubs(rows, key), key).select(F.col("node").alias("a"), F.col("hub").alias("b"))


def tied(nodes: list[bytes], tokens: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Edges that connect all nodes that share a token, one a node at most."""
    owner, every = np.repeat(np.arange(len(nodes)), [len(x) for x in tokens]), np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    owner, same = owner[order], every[order][1:] == every[order][:-1]
    up = list(range(len(nodes)))
    for code in np.unique(owner[:-1][same] * len(nodes) + owner[1:][same]).tolist():
        a, b = divmod(code, len(nodes))
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    return [(nodes[i], nodes[j]) for i, j in enumerate(up) if i != j]


def _tied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """tied of the rows (key, node, tokens) of each key, which come together."""
    key, nodes, tokens = None, [], []
    for frame in frames:
        pairs: list[tuple[bytes, bytes]] = []
        for own, node, held in zip(frame["key"], frame["node"], frame["tokens"], strict=True):
            if own != key:
                pairs += tied(nodes, tokens) if len(nodes) > 1 else []
                key, nodes, tokens = own, [], []
            nodes.append(node)
            tokens.append(held)
        yield pd.DataFrame(pairs, columns=["a", "b"])
    yield pd.DataFrame(tied(nodes, tokens) if len(nodes) > 1 else [], columns=["a", "b"])


def _meeting(cut: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all nodes of cut (node, root, tokens) that share both a token and a key of shared (node, key).

    In a bucket of up to BUCKET nodes, those that share a token. In a larger one, those that tokens connect, by whatever nodes of
    larger buckets of their component; that may connect more, never less. A row for each key or token of a node, not for each pair of both.
    """
    keys = written(shared.select("node", "key").join(cut.select("node", "tokens"), "node"), "keys")
    large = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key"), "large")
    n = large.count()
    hot = F.broadcast(large) if n <= BROADCAST_ROWS else large
    placed = keys.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    edges = placed.select("key", "node", "tokens").mapInPandas(_tied, "a binary, b binary")
    if not n:
        return edges
    busy = written(keys.select("node", "key").join(hot, "key", "left_semi"), "busy")
    tokens = cut.join(busy.select("node").distinct(), "node", "left_semi").select("node", "root", F.explode("tokens").alias("token"))
    tokens = written(tokens.select("node", F.xxhash64("root", "token").alias("token")), "tokens")
    by_token = components(_met(tokens, "token"))
    spots = written(busy.join(by_token, "node").select("node", F.xxhash64("key", "root").alias("spot")), "spots")
    return edges.union(_met(spots, "spot"))


def classes(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, _node (digest of the text), class_id (the smallest id of the class) and class_size (documents) of each row of docs.

    Equal texts are of one class, null and empty ones of one too; a text without words resembles only equal ones. Rows that
    repeat are documents of their own in class_size; null ids are never a class_id unless the class has no other.
    """
    own = docs.select(F.col(id_).alias("id"), digest(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(idf(own.select("text")))
    signed = own.select("node", "text").mapInPandas(_signed(weights), "node binary, bands array<long>")
    nodes = written(signed.groupBy("node").agg(F.max("bands").alias("bands")), "nodes")
    copies = written(own.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n")), "copies")

    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(rows.join(_hubs(rows, "key"), "key"), "shared")
    candidates = components(shared.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    texts = written(_texts(own, candidates.join(copies.select("node", "id"), "node")), "texts")
    crowds = candidates.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE)
    crowded = written(candidates.join(crowds.select("root"), "root", "left_semi"), "crowded")
    if not crowded.isEmpty():
        cut = _few(crowded, texts).mapInPandas(_prefixed(weights), "node binary, root binary, tokens array<long>")
        parted = components(_meeting(written(cut, "prefixes"), shared))
        candidates = candidates.join(crowded.select("node"), "node", "left_anti").union(parted.select("node", "root"))
    sizes = candidates.groupBy("root").agg((F.count("*") <= WHOLE).alias("small"))
    candidates = written(candidates.join(nodes, "node").join(sizes, "root"), "candidates")

    edges = None
    for turn in range(2):
        mine = candidates if turn == 0 else candidates.where(~F.col("small"))
        if mine.isEmpty():
            continue
        half = BANDS // 2
        order = F.col("bands") if turn == 0 else F.concat(F.slice("bands", half + 1, half), F.slice("bands", 1, half))
        mine = mine.select("node", "root", "small", F.when(~F.col("small"), order).alias("order"))
        placed = _few(mine, texts).repartitionByRange("root", "order").sortWithinPartitions("root", "order", "node")
        found = placed.select("root", "node", "small", "text").mapInPandas(_verified(weights), "a binary, b binary")
        edges = found if edges is None else edges.union(found)
    roots = components(edges) if edges is not None else candidates.select("node", "root")
    large = candidates.where(~F.col("small"))
    if not large.isEmpty():
        outside = written(_outsiders(large.select("node", "root", "bands"), roots), "outside")
        keys = outside.select(F.explode("bands").alias("key")).distinct()
        near = large.select("node", "root", F.explode("bands").alias("key")).join(keys, "key", "left_semi").drop("key").distinct()
        near = written(near.join(outside.select("node", F.lit(True).alias("outside")), "node", "left").fillna(False, ["outside"]), "near")
        met = written(_few(near, texts), "met")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_rest_links(met, weights)))

    ids = own.select("id", "node")
    per_node = copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = per_node.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    per_node = per_node.select("node", "root").join(found, "root").select("node", "class_id", "class_size")
    return ids.join(per_node, "node").select(F.col("id").alias(id_), F.col("node").alias("_node"), "class_id", "class_size")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs (with doc_id and text) without all but one document of each class, its columns kept."""
    found = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = written(found.groupBy("_node", F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")), "kept")
    own = docs.withColumn("_node", digest(F.col("text")))
    out = own.join(kept.drop("_n"), (own["_node"] == kept["_node"]) & own["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    if kept.where("_n > 1").limit(1).count():
        out = out.dropDuplicates(["_node", "doc_id"])
    return out.drop("_node")
