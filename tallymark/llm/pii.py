"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select redactions.

DataFrame operations only: spans come from regexp_replace, which marks matches, and split; the trees become CASE expressions.

Base kinds (email, ip, card, phone) are settled by their formats. The other generators (obfuscated mail, number, account) propose
far too much on purpose, and their candidates may overlap each other and the base spans; a candidate is kept if the calibrated
probability that trees give it from format and context reaches its kind's threshold. The trees are fitted on TRAINING_ROWS
generated, labelled texts (a third held out for calibration and thresholds), so the fit costs the same at any input.

Offsets are code points, ends exclusive. A null text counts as empty; equal rows get equal results; whole texts are searched.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, calibrate, threshold_for

MARK, NOT_MARK = "￿", "￾"
TRAINING_ROWS, PRECISION, CONTEXT = 1800, 0.98, 24

# Each as (kind, what a text must contain, what to mark). Runs are matched possessively and only from their start, which
# gives the same matches as greedy expressions in linear time.
BASE = [
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
]
PROPOSED = [
    ("mail", r"(?i)[ (\[](?:at|dot)[ )\]]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[(\[ ]at[)\] ] ?[a-z0-9-]{1,63}+(?: ?[(\[ ]dot[)\] ] ?[a-z0-9-]{1,63}+|\.[a-z0-9-]{1,63}+){1,5}"),
    ("number", r"[0-9][ ().-]{1,3}[0-9]", r"(?<![0-9+.,-])\(?[0-9]++(?:[ ().-]{1,3}[0-9]++){1,6}"),
    ("account", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])"),
]
KINDS = [kind for kind, _, _ in BASE + PROPOSED]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FOUND = "array<struct<start: int, end: int, value: string, before: string, after: string>>"
STEP, NEAR = 256, 16
"""Numbers summed one by one between running sums that are kept; pieces of text that context is taken from."""
SPANS = "array<struct<start: int, no: int, end: int, kind: string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a lambda computes what it refers to again for each element, unless that is a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """start, and what step makes of it and the first STEP, 2 STEP, ... values."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda i: F.aggregate(F.slice(values, i * STEP + 1, F.lit(STEP)), start, step))
    return F.aggregate(parts, F.array(start), lambda done, own: F.concat(done, F.array(step(F.element_at(done, -1), own))))


def _upto(values: Column, running: Column, n: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What step makes of the first n values."""
    part = F.floor(n / STEP).cast("int")
    return F.aggregate(F.slice(values, part * STEP + 1, n - part * STEP), F.get(running, part), step)


def marked(text: Column, need: str, pattern: str, context: bool = False) -> Column:
    """Matches of the pattern as (start, end, value, before, after), in order; text: without MARK. The last two, up to CONTEXT
    characters before (of the NEAR pieces between marks) and one after, only with context. Time is in proportion to the text's length."""
    plus = lambda a, n: a + n
    none = F.lit(None).cast("string")

    def matches(pieces: Column, lengths: Column, sums: Column) -> Column:
        def match(i: Column) -> Column:
            start = _upto(lengths, sums, i, plus)
            before = F.right(F.array_join(F.slice(pieces, F.greatest(i - (NEAR - 1), F.lit(1)), F.least(i, F.lit(NEAR))), ""), F.lit(CONTEXT)) if context else none
            after = F.left(F.element_at(pieces, i + 2), F.lit(1)) if context else none
            value = F.element_at(pieces, i + 1)
            return let(start, lambda at: F.struct(at.alias("start"), (at + F.element_at(lengths, i + 1)).alias("end"), value.alias("value"), before.alias("before"), after.alias("after")))

        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), match)

    none_found = F.array().cast(FOUND)
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    by_piece = lambda p: let(F.transform(p, F.length), lambda n: let(_running(n, F.lit(0), plus), lambda sums: matches(p, n, sums)))
    return F.when(text.rlike(need), let(pieces, lambda p: F.when(F.size(p) > 1, by_piece(p)).otherwise(none_found))).otherwise(none_found)


def _further(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def overlapping(spans: Column) -> Callable[[Column], Column]:
    """A test of whether a candidate overlaps one of the spans, which are in order: a search among their starts, and the furthest end so far."""

    def test(c: Column, starts: Column, ends: Column, furthest: Column) -> Column:
        n = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(27)))), F.lit(0), lambda at, by: F.when(F.get(starts, at + by - 1) < c["end"], at + by).otherwise(at))
        return let(n, lambda k: (k > 0) & (_upto(ends, furthest, k, _further) > c["start"]))

    def overlaps(candidates: Column, keep: Callable[[Column, Column], Column]) -> Column:
        few = F.filter(candidates, lambda c: keep(c, F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
        starts, ends = F.transform(spans, lambda b: b["start"]), F.transform(spans, lambda b: b["end"])
        many = let(starts, lambda s: let(ends, lambda e: let(_running(e, F.lit(0), _further), lambda f: F.filter(candidates, lambda c: keep(c, test(c, s, e, f))))))
        return F.when(F.size(spans) <= STEP, few).otherwise(many)

    return overlaps


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def add(total: Column, i: Column) -> Column:
        twice = F.substring(F.reverse(number), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """The remainder that is 1 for a valid international account number."""
    own = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(own, F.lit(5)), F.substr(own, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a base kind counts."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        own = digits(value)
        return F.when(F.length(own).between(12, 19), luhn(own)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def features(c: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    value, number = c["value"], digits(c["value"])
    before, after = F.lower(c["before"]), c["after"]
    yes = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    return [
        F.length(number).cast("double"),
        F.length(value).cast("double"),
        F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")).cast("double"),
        yes(value.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        yes(value.rlike(r"^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$")),
        yes(value.contains("(") & value.contains(")")),
        yes(value.rlike(r"(?i)[(\[]at[)\]]|[(\[]dot[)\]]")),
        yes(value.rlike(r"(?i) dot (?:com|org|net|edu|de|fr|es|io)$|\.(?:com|org|net|edu|de|fr|es|io)$")),
        F.when(value.rlike("^[A-Z]{2}[0-9]{2}"), mod_97(value).cast("double")).otherwise(-1.0),
        yes(before.rlike(r"phone|tel|call|mobile|cell|fax|reach|whatsapp")),
        yes(before.rlike(r"ssn|social|security|tax id|born|passport")),
        yes(before.rlike(r"iban|account|bank|konto|cuenta|compte")),
        yes(before.rlike(r"mail|contact|write|kontakt|correo")),
        yes(before.rlike(r"order|invoice|version|isbn|ref|page|model|build|part|serial|ticket|chapter")),
        yes(after.rlike(r"[0-9A-Za-z%]")),
    ]


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with _text and an array of matches for each kind."""
    docs = docs.withColumn("_text", F.translate(F.coalesce(F.col(text), F.lit("")), MARK, NOT_MARK))
    found = {f"_{kind}": marked(F.col("_text"), need, pattern) for kind, need, pattern in BASE}
    return docs.withColumns(found | {f"_{kind}": marked(F.col("_text"), need, pattern, True) for kind, need, pattern in PROPOSED})


def training_texts(rows: int = TRAINING_ROWS, seed: int = 9) -> list[tuple[str, str, int]]:
    """(kind, text with one candidate of the kind, whether it is personal). The labels are by construction."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def account(valid: bool) -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), n(r.choice([14, 16, 18, 20]))
        rest = 98 - int(body + str(ord(country[0]) - 55) + str(ord(country[1]) - 55) + "00") % 97
        check = rest if valid else (rest + r.randint(1, 90)) % 97
        raw = f"{country}{check:02d}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if r.random() < 0.5 else raw

    out = []
    for i in range(rows):
        kind, personal = ("mail", "number", "account")[i % 3], r.random() < 0.5
        if kind == "mail" and personal:
            at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", ".")])
            cue, value = r.choice(["mail", "contact", "write to", ""]), f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        elif kind == "mail":
            cue, value = word(), f"{word()} at {word()}{r.choice([' dot ', '.'])}{word()}"
        elif kind == "number" and personal:
            cue, value = r.choice([("phone", f"({n(3)}) {n(3)}-{n(4)}"), ("call me at", f"{n(3)}-{n(3)}-{n(4)}"), ("tel.", f"{n(3)} {n(3)} {n(4)}"), ("ssn", f"{n(3)}-{n(2)}-{n(4)}"), ("social security", f"{n(3)}-{n(2)}-{n(4)}"), ("mobile", f"{n(4)} {n(6)}")])
        elif kind == "number":
            cue = r.choice(["order", "invoice", "version", "isbn", "page", "ref", word(), word()])
            value = r.choice([f"{n(3)}-{n(3)}-{n(4)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(2)} {n(3)}", f"{n(3)} {n(3)} {n(4)}", f"{n(1)}-{n(4)}-{n(4)}-{n(1)}"])
        else:
            cue, value = r.choice(["iban", "account", "", word()] if personal else ["part", "serial", "model", "account", word()]), account(personal)
        out.append((kind, f"{word()} {word()} {cue} {value}{r.choice([' ', '. ', ', '])}{word()}", int(personal)))
    return out


def fitted(spark: SparkSession) -> dict[str, tuple[Boosted, float]]:
    """kind -> trees, and the margin at which the calibrated probability reaches the kind's threshold."""
    values = ", ".join(f"('{k}', '{t}', {y}, {i})" for i, (k, t, y) in enumerate(training_texts()))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, text, y, i)")
    rows = with_candidates(rows, "text")
    own = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"_{k}")) for k, _, _ in PROPOSED))
    measured = rows.select("kind", "y", "i", F.transform(own, lambda c: F.array(*features(c))).alias("x")).collect()
    out = {}
    for kind, _, _ in PROPOSED:
        mine = sorted((i, y, x[0]) for k, y, i, x in measured if k == kind and len(x) == 1)
        held, y, x = np.array([i // 3 % 3 == 0 for i, _, _ in mine]), np.array([y for _, y, _ in mine], float), np.array([x for _, _, x in mine])
        trees = Boosted(x[~held], y[~held])
        margin = trees.margin(x[held])
        a, b = calibrate(margin, y[held])
        p = threshold_for(1 / (1 + np.exp(-(a * margin + b))), y[held], PRECISION)
        out[kind] = trees, float("inf") if p >= 1 or a <= 0 else float((np.log(p / (1 - p)) - b) / a)
    return out


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` and `spans` (base ones and those that the trees select): start, no (of the kind), end, kind; by start, then kind."""
    models = fitted(docs.sparkSession)
    found = with_candidates(docs, text)

    def spans(kind: str, kept: Column) -> Column:
        no = F.lit(KINDS.index(kind))
        return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), no.alias("no"), c["end"].alias("end"), F.lit(kind).alias("kind")))

    def valid(kind: str) -> Column:
        return F.filter(f"_{kind}", lambda c: holds(kind, c["value"]))

    base = F.array_sort(F.concat(*(spans(k, valid(k)) for k, _, _ in BASE)))
    found = found.withColumn("base", base)
    select = overlapping(F.col("base"))

    def selected(kind: str) -> Column:
        trees, least = models[kind]
        return select(F.col(f"_{kind}"), lambda c, overlaps: F.when(overlaps, F.lit(False)).otherwise(trees.column(features(c)) >= least))

    more = [spans(k, selected(k)) for k, _, _ in PROPOSED if models[k][1] != float("inf")]
    found = found.withColumn("spans", F.array_sort(F.concat("base", *more)))
    return found.drop("_text", *(f"_{k}" for k in KINDS))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(text, done["at"] + 1, s["start"] - done["at"])
        longer = F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        inside = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], longer).otherwise(inside)

    return F.aggregate(spans, start, step, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1)))


def span_list(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
