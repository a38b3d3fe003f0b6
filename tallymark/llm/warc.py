"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates a member bit by bit, takes the payload's length from Content-Length and checks its digest, so it holds one
record and one piece of input at a time. Archives lie in the shared folder, one per writing task; a task writes under a name
of its own attempt, and only archives named by successful attempts are read, so a lost executor leaves at most an unread file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

PIECE, LEVEL, LEAST_REVISIT = 1 << 16, 6, 100
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
"""A fixed date: the same rows give the same archive."""
URI_CHARACTERS = ":/?#[]@!$&'()*+,;=%-._~"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """A record that is cut off, wrongly framed or does not have its digest."""


@contextmanager
def opened(path: str, mode: str) -> Iterator[BinaryIO]:
    """A file of the shared folder, by path or by the address of a file system."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        local = urlparse(path).path
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, mode) as file:
            yield file
    else:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        if mode == "wb":
            store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) if mode == "wb" else store.open_input_stream(place) as file:
            yield file


def record_bytes(row: dict) -> bytes:
    """A gzip member. row: page_id, url, html (bytes), digest, refers_to (None for a response)."""
    revisit = row["refers_to"] is not None
    body = b"" if revisit else row["html"]
    url = row["url"]
    address = None if url is None else quote(url, safe=URI_CHARACTERS)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:tallymark:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": address,
        "X-Original-URI": None if address == url else quote(url, safe=""),  # where the address had to be escaped
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "X-Payload-Length": len(row["html"]),
        "WARC-Refers-To": f"<urn:tallymark:page:{row['refers_to']}>" if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": len(body),
    }
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


class _Members:
    """The inflated bytes of one gzip member after the other."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.rest, self.inflate = file, b"", None

    def more(self) -> bool:
        """Whether another member begins."""
        self.rest = self.rest or self.file.read(PIECE)
        self.inflate = zlib.decompressobj(31) if self.rest else None
        return self.inflate is not None

    def read(self) -> bytes:
        """The next piece of this member, of PIECE bytes at most; b"" at its end."""
        while not self.inflate.eof:
            self.rest = self.rest or self.file.read(PIECE)
            if not self.rest:
                raise WarcError("the archive ends within a member")
            try:
                out = self.inflate.decompress(self.rest, PIECE)
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
        return b""


def read_records(file: BinaryIO, keep: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record in turn; keep=False checks payloads without keeping them.

    Raises WarcError if a member is cut off or damaged, a record's framing or length is wrong, or a response's digest is.
    """
    members = _Members(file)
    while members.more():
        held = b""
        while b"\r\n\r\n" not in held:
            if not (piece := members.read()):
                raise WarcError("a member without a header")
            held += piece
        head, _, held = held.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if first != VERSION:
            raise WarcError(f"not a WARC record: {first[:20]!r}")
        fields = dict(line.decode().split(": ", 1) for line in lines)
        left, digest, parts = int(fields["Content-Length"]), sha256(), []
        while True:
            body, held = held[:left], held[left:]
            left -= len(body)
            digest.update(body)
            if keep:
                parts.append(body)
            if left == 0:
                break
            if not (held := members.read()):
                raise WarcError("a payload that is shorter than its Content-Length")
        while piece := members.read():
            held += piece
            if len(held) > 4:
                break
        if held != b"\r\n\r\n":
            raise WarcError("a record that does not end after its Content-Length")
        if fields["WARC-Type"] != "revisit" and fields["WARC-Payload-Digest"] != f"sha256:{digest.hexdigest()}":
            raise WarcError(f"wrong digest in {fields['WARC-Record-ID']}")
        yield fields, b"".join(parts)


def page_number(address: str | None) -> int | None:
    number = (address or "").rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def _write(folder: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        frames = (f for f in frames if len(f))
        if (first := next(frames, None)) is None:
            return
        with opened(path, "wb") as file:
            while first is not None:
                for row in first.astype(object).where(first.notna(), None).to_dict("records"):
                    file.write(record_bytes(row))
                    n += 1
                first = next(frames, None)
        yield pd.DataFrame({"path": [path], "records": [n]})

    return write


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (bytes), digest, refers_to. Null html is empty.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, all but that with the smallest page_id refer to it; a page
    that repeats that page_id as well stays a response, and so does a page without an id, which nothing can refer to.
    Only digests of more than one page are joined back; Spark splits a digest that most pages share.
    """
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    first = own.where(F.length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = own.join(first.where("n > 1").drop("n"), "digest", "left")
    refers_to = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html). Returns path and records of each archive, already computed."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    rows = with_revisits(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # pandas would make floats of integers and nulls
    return rows.mapInPandas(_write(folder), "path string, records long").checkpoint()


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record, in whole archives."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, records in zip(frame["path"], frame["records"], strict=True):
                rows = []
                with opened(path, "rb") as file:
                    for fields, _ in read_records(file, keep=False):
                        url = unquote(fields["X-Original-URI"]) if "X-Original-URI" in fields else fields.get("WARC-Target-URI")
                        rows.append((
                            page_number(fields["WARC-Record-ID"]), url, int(fields["X-Payload-Length"]),
                            fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], page_number(fields.get("WARC-Refers-To")),
                        ))
                if len(rows) != records:
                    raise WarcError(f"{len(rows)} records in {path}, {records} written")
                names = [x.split()[0] for x in RECORD.split(", ")]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return archives.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(read, RECORD)
