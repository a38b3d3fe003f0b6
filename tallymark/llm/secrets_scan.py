"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run only at its hits, checksums are validated.

Offsets are code points, ends exclusive. A null text counts as empty; every row gets a result; equal rows get equal results;
whole texts are searched, however long; an empty table gives an empty result. Of the columns of a table only text and id are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "checksum", "private_key")
"""In the order in which spans that start together are listed."""

# Keywords and formats of public token schemes.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
ANCHORED = {"assign": ASSIGN, "access": ACCESS, "checksum": CHECKED, "private_key": PEM}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checksum", CHECKED_PREFIXES), ("private_key", ("-----begin ",))):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def base62(number: int, width: int = 6) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def holds(kind: str, match: re.Match) -> bool:
    """Whether a match of the expression counts."""
    if kind == "assign":
        return len(match[1]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    if kind == "checksum":  # the last six characters are the CRC-32 of those before, in base 62
        return base62(zlib.crc32(match[1].encode())) == match[2]
    return True


def spans(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of KINDS."""
    if not text:
        return []
    lowered = text.encode().lower().decode()  # of bytes, so that only ASCII letters change and offsets stay
    hits: dict[str, list[int]] = {}
    for last, (kind, width) in keywords.iter(lowered):
        hits.setdefault(kind, []).append(last - width + 1)
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start >= free and (m := ANCHORED[kind].match(text, start)):
                free = m.end()  # a failing match uses up its characters too
                if holds(kind, m):
                    found.append((kind, start, free))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scanned(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id and `found`, an array of (kind, start, end), for each row."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keywords = automaton()
        for frame in frames:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x, keywords)] for x in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "found": rows})

    own = docs.select(F.col(id_).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = "id string, found array<struct<kind: string, start: long, end: long>>"
    out = own.mapInPandas(scan, schema)  # ids as text: pandas would make floats of integers and nulls
    return out.select(F.col("id").cast(docs.schema[id_].dataType).alias(id_), *out.columns[1:])


def span_list(found: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def of_kinds(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))
