import random
from hashlib import sha256

import pytest

from tallymark.llm import suffix_dedup
from tallymark.llm.runs import common_prefix, decode, encode, merge

LENGTH = suffix_dedup.LENGTH


def brute(docs):
    """docs: (order key, text). Removed places of each."""
    seen, out = set(), []
    for _, text in sorted(docs, key=lambda d: d[0]):
        raw, gone = (text or "").encode(), set()
        for s in range(len(raw) - LENGTH + 1):
            w = raw[s : s + LENGTH]
            if w in seen:
                gone.update(range(s, s + LENGTH))
            seen.add(w)
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(raw), len(gone), spans, kept))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé d\n") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(r.randint(18, 60))) for _ in range(6)]
    out = [None, "", "x", "1" * 3000, "1" * 250, "ab" * 700, "z" * 99, "z" * 100, "z" * 101]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            kind = r.random()
            if kind < 0.4:
                parts.append(p)
            elif kind < 0.6:
                a = r.randint(0, len(p))
                parts.append(p[a : a + r.randint(50, 150)])
            elif kind < 0.8:
                a = r.randint(0, len(p) - 1)
                parts.append(p[:a] + "#" + p[a + 1 :])
            else:
                parts.append("".join(word() for _ in range(30)))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("options", [{}, {"group_limit": 2}, {"most_bits": 15}])
def test_equals_brute_force(spark, options):
    own = texts(3)
    docs = spark.createDataFrame([(i * 7 - 100, t, 1) for i, t in enumerate(own)], "doc_id long, text string, spans int").repartition(5)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(docs, **options).collect()}
    want = brute([(i * 7 - 100, t) for i, t in enumerate(own)])
    for i, w in enumerate(want):
        assert rows[i * 7 - 100] == w, i


def test_repeated_and_null_ids(spark):
    r = random.Random(1)
    p = "".join(r.choice("abcdefgh") for _ in range(300))
    docs = spark.createDataFrame([(5, p), (5, p), (None, p), (9, "q" + p)], "doc_id long, text string")
    rows = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_removed) for r in suffix_dedup.without_repeats(docs).collect())
    assert rows == [(-1, 0), (5, 300), (5, 300), (9, 300)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.without_repeats(docs).collect() == []


def test_loser_tree_merges_with_prefixes():
    r = random.Random(2)
    for n in (1, 2, 3, 5, 8):
        runs = [sorted((bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))), 1, r.randint(0, 9), 0, j) for j in range(r.randint(0, 30))) for _ in range(n)]
        out = list(merge([decode(encode(x)) for x in runs]))
        assert [e[0] for _, e in out] == sorted(e[0] for x in runs for e in x)
        assert sorted(e for _, e in out) == sorted(e for x in runs for e in x)
        for (_, a), (h, b) in zip(out, out[1:]):
            assert h == common_prefix(a[0], b[0])


def test_digest_is_of_the_remaining_bytes(spark):
    docs = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    row = suffix_dedup.without_repeats(docs).first()
    assert sha256(row.kept).hexdigest() == sha256(b"short").hexdigest()


def test_spans_join_where_they_touch():
    import numpy as np

    rows = [(2, 0, 5, 9), (1, 0, 0, 4), (1, 0, 4, 6), (1, 0, 9, 30), (1, 0, 10, 12), (1, 0, 31, 40), (1, 1, 0, 2), (2, 0, 1, 3)]
    assert suffix_dedup.joined(np.array(rows)).tolist() == [[1, 0, 0, 6], [1, 0, 9, 30], [1, 0, 31, 40], [1, 1, 0, 2], [2, 0, 1, 3], [2, 0, 5, 9]]
