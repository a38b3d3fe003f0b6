import random
import re
from hashlib import sha256

from tallymark.llm import pii
from tallymark.llm.boosting import Boosted, calibrate, threshold_for

# The base rules as the contract words them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def brute(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def noisy(seed, n):
    r = random.Random(seed)
    parts = [*"0123456789", *"0123456789", "a", "é", "𝒳", "b@c.d", "@", ".", ".", "-", " ", " ", "+", "+1 (555) 123-4567", "(", ")", "4111111111111111", "10.0.0.256", "1.2.3.4", "\n", "_", pii.MARK, "x.y@z.w_q@r.s"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_base_spans_equal_the_plain_rules(spark):
    texts = [None, "", "a@b.c", "1" * 5000, "9 " * 3000, "x" * 20000 + "@y.z", "@" * 999, *noisy(1, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_spans(docs).select("doc_id", "base", "spans").collect()
    assert len(rows) == len(texts)
    for doc_id, base, spans in rows:
        assert [tuple(s) for s in base] == brute(texts[doc_id]), texts[doc_id]
        assert {tuple(s) for s in base} <= {tuple(s) for s in spans}
        assert [tuple(s) for s in spans] == sorted(tuple(s) for s in spans)


def test_many_matches_in_one_text(spark):
    text = "".join(f"u{i}@ex.org tel {i % 1000:03d}-555-{i % 10000:04d}, " for i in range(25_000))
    row = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in row.base] == brute(text) and len(row.base) == 25_000
    places = [m.span() for m in re.finditer(r"[0-9]{3}-555-[0-9]{4}", text)]
    assert [(s.start, s.end) for s in row.spans if s.kind == "number"] == places


def test_overlaps_are_found_among_many_spans(spark):
    r = random.Random(4)
    spans = sorted((a, a + r.choice([1, 2, 3, 400])) for a in (r.randint(0, 9000) for _ in range(700)))
    candidates = [(a, a + r.randint(1, 4)) for a in (r.randint(0, 9500) for _ in range(400))]
    kind = "array<struct<start: int, end: int>>"
    row = spark.createDataFrame([(spans, candidates)], f"spans {kind}, own {kind}").select(pii.overlapping(pii.F.col("spans"))(pii.F.col("own"), lambda c, o: o)).first()[0]
    assert [tuple(x) for x in row] == [c for c in candidates if any(a < c[1] and c[0] < b for a, b in spans)]


def test_trees_add_spans_that_context_supports(spark):
    texts = [
        "please call me at 212-555-0187 today", "see invoice 3.1.22 of the list", "write to maria (at) example (dot) com now", "iban DE89370400440532013000 thanks",
        "her ssn 123-45-6789 was", "serial DE12370400440532013001 is",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [s.kind for s in r.spans] for r in pii.with_spans(docs).collect()}
    assert rows[0] == ["number"] and rows[2] == ["mail"] and rows[3] == ["account"] and rows[4] == ["number"]
    assert rows[1] == [] and rows[5] == []


def test_held_out_accuracy(spark):
    """On texts generated with another seed, what is selected is nearly always personal, and most personal candidates are found."""
    fresh = pii.training_texts(600, seed=77)
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(fresh)], "doc_id long, text string")
    rows = {r.doc_id: {s.kind for s in r.spans} for r in pii.with_spans(docs).collect()}
    hit = [(kind in rows[i], y) for i, (kind, _, y) in enumerate(fresh)]
    true = sum(1 for s, y in hit if s and y)
    assert true / max(1, sum(s for s, _ in hit)) > 0.93 and true / sum(y for _, y in hit) > 0.75


def test_redaction_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 123-4567.", 7), (None, None, 8)], "doc_id long, text string, base int")
    out = pii.with_spans(docs.drop("base")).select("doc_id", pii.redacted(pii.F.col("text"), pii.F.col("spans")).alias("r")).collect()
    assert {r.doc_id: r.r for r in out} == {1: "mail [email] or [phone].", None: None}
    assert pii.with_spans(docs).count() == 2
    assert pii.with_spans(docs.where("false")).count() == 0


def test_digest_of_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.co 1.2.3.4")], "doc_id long, text string")
    got = pii.with_spans(docs).select(pii.F.sha2(pii.span_list(pii.F.col("base")), 256)).first()[0]
    assert got == sha256(b"email:0:6,ip:7:14").hexdigest()


def test_boosting_learns_and_calibrates():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Boosted(x[:600], y[:600])
    margin = model.margin(x[600:])
    assert ((margin > 0) == y[600:]).mean() > 0.9
    a, b = calibrate(margin, y[600:])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    t = threshold_for(p, y[600:], 0.95)
    assert y[600:][p >= t].mean() >= 0.95
