import random
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import near_dedup, shingles
from tallymark.llm.components import components


def words(r, n):
    return ["".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edited(r, own, n):
    own = list(own)
    for _ in range(n):
        own[r.randrange(len(own))] = "edit" + str(r.randrange(10**6))
    return own


def jaccard(a, b):
    grams = lambda t: set(zip(*(t.split()[i:] for i in range(5)))) if len(t.split()) >= 5 else {tuple(t.split())}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def brute(texts):
    root = {i: i for i in range(len(texts))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i] or "", texts[j] or ""
            if a == b or (a.split() and b.split() and jaccard(a, b) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_classes_equal_brute_force(spark):
    r = random.Random(5)
    bases = [words(r, r.randint(60, 300)) for _ in range(40)]
    texts = [None, "", "", "a b c", "a b c", "one", "x " * 4000]
    for b in bases:
        texts.append(" ".join(b))
        for _ in range(r.randint(0, 3)):
            texts.append(" ".join(edited(r, b, max(1, len(b) // 100))))
        if r.random() < 0.3:
            texts.append(" ".join(b))
        if r.random() < 0.5:
            texts.append(" ".join(edited(r, b, len(b) // 8)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(4)
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    want = brute(texts)
    clear = [i for i in want if not any(0.77 < jaccard(texts[i] or "", texts[j] or "") < 0.83 for j in want if j != i)]
    assert len(got) == len(texts) and {i: got[i] for i in clear} == {i: want[i] for i in clear}
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(got.values())


def test_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "WHOLE", 20)
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    monkeypatch.setattr(near_dedup, "OVERLAP", 3)
    r = random.Random(6)
    base = words(r, 150)
    docs = spark.createDataFrame([(i, " ".join(edited(r, base, 2))) for i in range(150)], "doc_id long, text string")
    assert {x.class_id for x in near_dedup.classes(docs).collect()} == {0}


def test_outsiders_meet_all_others_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUND", 7)
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    r = random.Random(8)
    bases = [words(r, 80) for _ in range(3)]
    texts = [" ".join(edited(r, bases[i % 3], 1)) for i in range(60)]
    rows = [(bytes([i]), b"root" if i < 45 else b"other", i % 5 == 0, t) for i, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "node binary, root binary, outside boolean, text string").repartition(3)
    weights = spark.sparkContext.broadcast(np.ones(1 << near_dedup.SKETCH_BITS, np.float32))
    got = {(bytes(x.a)[0], bytes(x.b)[0]) for x in near_dedup._rest_links(found, weights).collect() if x.a != x.b}
    together = lambda i, j: (i < 45) == (j < 45) and i != j
    want = {(i, j) for i in range(0, 60, 5) for j in range(60) if together(i, j) and jaccard(texts[i], texts[j]) >= 0.8}
    assert got == want


def test_texts_that_share_a_line_are_not_compared_with_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "WHOLE", 20)
    names, real = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: names.append(name) or real(df, name))
    r = random.Random(14)
    line = words(r, 60)
    texts = [" ".join(line + words(r, 30)) for _ in range(150)]
    texts += [" ".join(edited(r, t.split(), 1)) for t in texts[::10]]
    got = {x.doc_id: x.class_id for x in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute(texts)
    assert "crowded" in names and "near" not in names  # one component by buckets, none of over WHOLE nodes by prefixes


def test_similar_texts_share_a_token_of_their_prefixes():
    r = np.random.default_rng(15)
    pool = r.integers(1, 1 << 62, 300).astype(np.uint64)
    weight = r.choice(np.linspace(0.3, 1.25, 40), 300).astype(np.float32)
    similar = 0
    for _ in range(3000):
        own = np.sort(r.choice(300, r.integers(1, 40), replace=False))
        other = np.union1d(own[r.random(len(own)) < 0.93], r.choice(300, r.integers(0, 4), replace=False))
        a, b = (weight[x].astype(float).sum() for x in (own, other))
        common = weight[np.intersect1d(own, other)].astype(float).sum()
        if common and common >= 0.8 * (a + b - common):
            similar += 1
            assert np.intersect1d(near_dedup.prefix((pool[own], weight[own])), near_dedup.prefix((pool[other], weight[other]))).size
    assert similar > 500


@pytest.mark.parametrize("bucket", [256, 5])
def test_parting_makes_no_row_for_each_pair_of_key_and_token(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    r = random.Random(16)
    name = lambda i: bytes([i // 256, i % 256])
    held = {i: (r.sample(range(60), 6), [i % 2 * 1000 + x for x in r.sample(range(120), 5)] + [10_000 + i]) for i in range(300)}
    held |= {i: ([60, 61, 62], list(range(i // 4 * 50 + 5000, i // 4 * 50 + 5030))) for i in range(300, 340)}
    cut = spark.createDataFrame([(name(i), b"root", tokens) for i, (_, tokens) in held.items()], "node binary, root binary, tokens array<long>").repartition(3)
    shared = spark.createDataFrame([(name(i), key) for i, (keys, _) in held.items() for key in keys], "node binary, key long").repartition(3)
    edges = near_dedup._meeting(cut, shared)
    assert edges.count() <= shared.count()  # 10 groups of 4 with 30 tokens in 3 buckets alone made 3600 rows, of 1920 keys
    part = {bytes(x.node): bytes(x.root) for x in components(edges).collect()}
    pairs = [(i, j) for i in held for j in held if i < j and all(set(held[i][k]) & set(held[j][k]) for k in range(2))]
    assert len(pairs) > 500 and all(part[name(i)] == part[name(j)] for i, j in pairs)
    assert len({part[name(i)] for i in range(300, 340)}) == 10
    assert not {part[name(i)] for i in range(300)} & {part[name(i)] for i in range(300, 340)}
    if bucket == 256:
        up = {i: i for i in held}
        for i, j in pairs * 20:
            up[i] = up[j] = min(up[i], up[j])
        assert len({part[name(i)] for i, _ in pairs}) == len({up[i] for i, _ in pairs})


def test_a_repeated_line_does_not_make_texts_alike(spark):
    r = random.Random(9)
    docs = [(i, " ".join(words(r, 120)) + "\nIs onhe." * 300) for i in range(12)]
    assert len({x.class_id for x in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}) == 12


def test_similarity_is_of_sums_of_minima():
    r = random.Random(11)
    for _ in range(40):
        pool = [np.uint64(r.getrandbits(63)) for _ in range(12)]
        make = lambda: {h: r.choice([1, 1, 2, 3, 9]) for h in r.sample(pool, 11)}  # noqa: B023, E731
        a, b = make(), make()
        weights = np.ones(1 << near_dedup.SKETCH_BITS, np.float32)
        f = lambda n: 1 + np.log(n) if n else 0.0
        want = sum(min(f(a.get(h, 0)), f(b.get(h, 0))) for h in pool) / sum(max(f(a.get(h, 0)), f(b.get(h, 0))) for h in pool)
        if abs(want - 0.8) < 0.001:
            continue
        block = shingles.Block([0, 1], np.repeat([0, 1], 11), np.array(sorted(a) + sorted(b), np.uint64), np.array([a[h] for h in sorted(a)] + [b[h] for h in sorted(b)]))
        near_dedup_blocks = near_dedup.blocks
        near_dedup.blocks = lambda texts, block=block: [block]
        try:
            members = near_dedup._members(["", ""], weights)
        finally:
            near_dedup.blocks = near_dedup_blocks
        assert bool(near_dedup.similar(members, 0)) == (want >= 0.8)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.classes(docs).collect() == []
    docs = spark.createDataFrame([(None, "q w e r t y u"), (3, "q w e r t y u"), (None, "other")], "doc_id long, text string")
    assert Counter(x.class_id for x in near_dedup.classes(docs).collect()) == Counter({3: 2, None: 1})


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_samples_agree_as_often_as_texts_are_similar(share):
    r = np.random.default_rng(1)
    weights = np.ones(1 << near_dedup.SKETCH_BITS, np.float32)
    agree = total = 0
    for _ in range(60):
        own = r.integers(0, 1 << 63, 400).astype(np.uint64)
        n = int(400 * 2 * share / (1 + share))
        other = np.concatenate([own[:n], r.integers(0, 1 << 63, 400 - n).astype(np.uint64)])
        block = shingles.Block([0, 1], np.repeat([0, 1], 400), np.concatenate([np.sort(own), np.sort(other)]), np.ones(800, np.int64))
        _, keys = near_dedup.signatures(block, weights)
        agree += int((keys[0] == keys[1]).sum())
        total += near_dedup.BANDS
    assert abs(agree / total - share**2) < 0.08  # a band has two samples


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}
