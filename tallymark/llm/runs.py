"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Entry = tuple[bytes, int, int, int, int]
"""(string, split, doc, row, place): what is sorted, and where it comes from."""


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes agree."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def encode(entries: list[Entry]) -> bytes:
    """Entries sorted by string, each as the length of the prefix that it shares with the one before and the rest."""
    shared, rests, before = [], [], b""
    for string, *_ in entries:
        h = common_prefix(before, string)
        shared.append(h)
        rests.append(string[h:])
        before = string
    numbers = np.array([e[1:] for e in entries], np.int64).reshape(len(entries), 4)
    parts = [
        np.array([len(entries)], np.int64), np.array(shared, np.uint16), np.array([len(x) for x in rests], np.uint16),
        numbers[:, 0].astype(np.uint16), numbers[:, 1], numbers[:, 2], numbers[:, 3],
    ]
    return b"".join([*(p.tobytes() for p in parts), *rests])


def decode(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """The entries, each with the length of the prefix that it shares with the one before."""
    n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
    columns = []
    for kind, width in ((np.uint16, 2), (np.uint16, 2), (np.uint16, 2), (np.int64, 8), (np.int64, 8), (np.int64, 8)):
        columns.append(np.frombuffer(blob, kind, n, at).tolist())
        at += n * width
    string = b""
    for h, size, split, doc, row, place in zip(*columns, strict=True):
        string = string[:h] + blob[at : at + size]
        at += size
        yield h, (string, split, doc, row, place)


def merge(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """Entries of all runs in order, each with the length of the prefix that it shares with the entry before.

    A loser at a node knows the prefix h that it shares with the winner that passed there last. A challenger whose own
    prefix with that winner is longer is smaller, if shorter it is larger; only at equal h are bytes compared, from h on. An ended run
    has the prefix -1 and loses to all.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[int, Entry | None]] = [next(r, (-1, None)) for r in runs] + [(-1, None)] * (k - len(runs))
    strings: list = [e[0] if e else None for _, e in heads]
    entries: list = [e for _, e in heads]
    node_run, node_h = [0] * k, [-1] * k

    def duel(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """winner, its prefix, loser, its prefix with the winner"""
        if ha > hb:
            return a, ha, b, hb
        if ha < hb:
            return b, hb, a, ha
        if ha < 0:
            return a, ha, b, hb
        x, y = strings[a], strings[b]
        h = ha + common_prefix(x[ha:], y[hb:])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            return a, ha, b, h
        return b, hb, a, h

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            run = node - k
            return run, -1 if entries[run] is None else 0
        winner, h, node_run[node], node_h[node] = duel(*build(2 * node), *build(2 * node + 1))
        return winner, h

    winner, h = build(1) if k > 1 else (0, -1 if entries[0] is None else 0)
    first = True
    while h >= 0:
        yield (0 if first else h), entries[winner]
        first = False
        h, entry = next(runs[winner], (-1, None))
        entries[winner] = entry
        strings[winner] = entry[0] if entry else None
        node = (winner + k) // 2
        while node:
            other, ho = node_run[node], node_h[node]
            if h < ho:
                node_run[node], node_h[node], winner, h = winner, h, other, ho
            elif h == ho:
                winner, h, node_run[node], node_h[node] = duel(winner, h, other, ho)
            node //= 2
