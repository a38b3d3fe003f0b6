"""Decontamination, mixing, sharding and WARC against plain versions."""

import io
import math
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, mixing, sharding, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items):
    own = plain_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = plain_words(item)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            window = w[i : i + size]
            for s in range(len(own) - size + 1):
                if own[s : s + size] == window:
                    hit.update(range(s, s + size))
                    found.add(item_id)
    return len(own), len(hit), sorted(str(x) for x in found if x is not None)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["a", "the", "of", "Été", "x9", *("w%d" % i for i in range(30))]
    sentence = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "!\n"]) for _ in range(n))
    items = [(i, sentence(r.choice([2, 3, 7, 9, 10, 11, 14, 25]))) for i in range(25)] + [(90, "Solo"), (91, ""), (92, None), (None, sentence(12)), (93, "the the the the"), (94, "a A a a a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "solo"), (3, "the " * 40), (4, "a " * 30), (5, "word" * 20000)]
    for i in range(6, 150):
        parts = [sentence(r.randint(0, 15)) for _ in range(r.randint(0, 3))]
        for _ in range(r.randint(0, 2)):
            item = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(item) - 10))
            parts.insert(r.randint(0, len(parts)), " ".join(item[a : a + r.randint(8, 14)]).upper())
        docs.append((i, " ".join(parts)))
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, w string").repartition(4)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    rows = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.marked(table, benchmark).collect()}
    for i, t in docs:
        assert rows[i] == plain_hits(t, items), (i, t)


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "MAX_BITS"])
def test_decontamination_beyond_its_limits(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, limit, 4)
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "alpha beta")]
    docs = [(1, "say one two three four five six seven eight nine ten now"), (2, "alpha, BETA"), (3, "none")]
    rows = decontaminate.marked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_hit, x["items"]) for x in rows) == [(1, 10, ["1"]), (2, 2, ["2"]), (3, 0, [])]


def test_decontamination_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [x.n_hit for x in decontaminate.marked(docs, empty).collect()] == [0, 0]
    assert decontaminate.marked(docs.where("false"), empty).collect() == []


def plain_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[k] for k in capped)
        free = [k for k in names if k not in capped]
        level = rest / sum(weight[k] for k in free) if free else 0
        over = {k for k in free if weight[k] * level > 3 * sizes[k]}
        if not over:
            return {k: 3.0 * sizes[k] if k in capped else weight[k] * level for k in names}
        capped |= over


def test_mixing(spark):
    r = random.Random(7)
    docs = []
    for i in range(1200):
        source = r.choice(["big", "big", "big", "big", "a", "b", "tiny" if i % 60 == 0 else "c", None, "é", ""])
        docs.append((i, r.choice([None, "", "w " * r.randint(1, 60)]) if r.random() < 0.1 else "w " * r.randint(1, 60), source, "x"))
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, size string").repartition(5)
    rows = mixing.with_copies(table).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in docs:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for x in rows:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-9)
        assert 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60), (s, taken[s], t)
    again = {x.doc_id: x.copies for x in mixing.with_copies(table.repartition(3)).collect()}
    assert again == {x.doc_id: x.copies for x in rows}
    out = mixing.mixed(table)
    assert out.columns == table.columns and out.count() == sum(x.copies for x in rows)


def test_mixing_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.with_copies(spark.createDataFrame([], schema)).collect() == []
    rows = mixing.with_copies(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()
    assert {(x.size, x.target, x.copies) for x in rows} == {(0, 0.0, 0)}
    rows = mixing.with_copies(spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s")], schema)).collect()
    assert sum(x.size * x.copies for x in rows) == 4


@pytest.mark.parametrize("shards", [1, 16])
def test_sharding(spark, shards):
    r = random.Random(8)
    texts = ["same text " * 30] * 900 + ["x" * r.randint(0, 900) + str(i) for i in range(1500)] + [None, "", "", "y" * 30_000]
    table = spark.createDataFrame([(None if i % 500 == 7 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, size int").repartition(6)
    rows = sharding.assign_shards(table, shards).collect()
    assert len(rows) == len(texts)
    held, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in rows:
        assert x.size == len((x.text or "").encode()) + 1
        held[x.shard] += x.size
        slots[x.shard].append(x.slot)
        groups[x.text].add(x.shard)
    quota = sum(held.values()) / shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(held[s] - quota) for s in range(shards)) <= 0.02 * quota + 30_001
    assert sum(len(s) > 1 for t, s in groups.items() if t and len(t) < 1000 and t != texts[0]) == 0
    again = sharding.assign_shards(table.repartition(3), shards).select("doc_id", F.xxhash64("text"), "shard", "slot").where("doc_id IS NOT NULL").collect()
    assert set(again) == set(sharding.assign_shards(table, shards).select("doc_id", F.xxhash64("text"), "shard", "slot").where("doc_id IS NOT NULL").collect())


@pytest.mark.parametrize("sample", [32, 1])
def test_sharding_equals_plain_version(spark, monkeypatch, sample):
    """Distinct texts; a sample of one a range leaves overfull ranges, which are subdivided: no range changes the result."""
    monkeypatch.setattr(sharding, "SAMPLE_PER_RANGE", sample)
    used, ranged = [], sharding._ranged
    monkeypatch.setattr(sharding, "_ranged", lambda keyed, bounds: used.append(len(bounds)) or ranged(keyed, bounds))
    r = random.Random(9)
    texts = [f"{i} " + "z" * r.choice([0, 5, 50, 400]) for i in range(3000)] + ["w" * 20_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    keyed = table.select("doc_id", (F.octet_length("text") + 1).alias("size"), F.xxhash64("text").alias("key")).orderBy("key").collect()
    total, before, want, slots = sum(x.size for x in keyed), 0, {}, defaultdict(int)
    for x in keyed:
        shard = min(15, int((before * 2 + x.size) * (16 / (2 * total))))
        want[x.doc_id] = shard, slots[shard]
        slots[shard] += 1
        before += x.size
    assert {x.doc_id: (x.shard, x.slot) for x in sharding.assign_shards(table).collect()} == want
    assert (len(set(used)) > 1) == (sample == 1)


def test_sharding_of_small_tables(spark):
    schema = "doc_id long, text string"
    assert sharding.assign_shards(spark.createDataFrame([], schema)).collect() == []
    rows = sharding.assign_shards(spark.createDataFrame([(1, None)], schema)).collect()
    assert [(x.size, x.slot) for x in rows] == [(1, 0)]


def test_bounds_by_binary_search(spark):
    bounds = sorted(random.Random(1).choices(range(-50, 50), k=37))
    values = spark.range(-60, 60).select(F.col("id").alias("v"), sharding.below(F.col("id"), bounds).alias("lo"), sharding.below(F.col("id"), bounds, True).alias("hi"))
    for v, lo, hi in values.collect():
        assert (lo, hi) == (sum(b < v for b in bounds), sum(b <= v for b in bounds))


def test_archives_round_trip(spark, tmp_path):
    big, odd = "<p>é𝒳</p>" * 20_000, "http://h/a b?é=%20\r\n"
    pages = [(1, "http://a", big), (2, None, big), (3, odd, "s" * 99), (4, "u", "s" * 99), (5, "u", None), (6, "u", ""), (None, "n", big), (2, "again", big), (7, "u", "t" * 100), (9, "u", "t" * 100)]
    table = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    rows = warc.read_archives(spark, warc.write_archives(table)).collect()
    raw = {(p, u): (h or "").encode() for p, u, h in pages}
    assert len(rows) == len(pages)
    for x in rows:
        body = raw[x.page_id, x.url]
        assert (x.payload_bytes, x.payload_digest) == (len(body), sha256(body).hexdigest())
    kinds = {(x.page_id, x.url): (x.record_type, x.refers_to) for x in rows}
    assert kinds[1, "http://a"] == ("response", None) and kinds[2, None] == kinds[2, "again"] == ("revisit", 1)
    assert kinds[3, odd] == kinds[4, "u"] == kinds[None, "n"] == ("response", None) and kinds[9, "u"] == ("revisit", 7)
    assert warc.read_archives(spark, warc.write_archives(table.where("false"))).collect() == []


def test_reader_finds_damage():
    row = {"page_id": 1, "url": "u", "html": b"payload" * 50, "digest": sha256(b"payload" * 50).hexdigest(), "refers_to": None}
    good = warc.record_bytes(row) + warc.record_bytes(row | {"page_id": 2})
    assert [f["WARC-Record-ID"][-2] for f, _ in warc.read_records(io.BytesIO(good))] == ["1", "2"]
    with pytest.raises(warc.WarcError, match="ends within"):
        list(warc.read_records(io.BytesIO(good[:-3])))
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(warc.record_bytes(row | {"digest": "0" * 64}))))
    text = zlib.decompress(warc.record_bytes(row), 31)
    for changed, why in ((text.replace(b"Content-Length: 350", b"Content-Length: 349"), "end after"), (text.replace(b"Content-Length: 350", b"Content-Length: 360"), "shorter|end after")):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError, match=why):
            list(warc.read_records(io.BytesIO(packer.compress(changed) + packer.flush())))


def test_more_one_word_items_than_a_bitmap_holds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BITS", 1 << 12)  # bitmaps of up to 1024 hashes
    items = [*((i, f"w{i}") for i in range(1100)), (2000, "alpha beta")]
    docs = [(1, "here stands w7 alone"), (2, "alpha beta"), (3, "nothing of it")]
    rows = decontaminate.marked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: (x.n_hit, x["items"]) for x in rows} == {1: (1, ["7"]), 2: (2, ["2000"]), 3: (0, [])}
