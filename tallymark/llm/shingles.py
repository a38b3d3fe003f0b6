"""Hashes of words and of word shingles, computed for blocks of texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SHINGLE = 5
BLOCK_BYTES = 1 << 20
"""Arrays of a block take about 60 times its bytes."""
U64 = np.uint64
_FACTOR, _SPREAD = U64(0x9E3779B97F4A7C15), [U64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = 0
"""Each byte as it counts in words: ASCII letters in lower case, other ASCII but digits as separators (0)."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U64(30))) * _SPREAD[0]
    x = (x ^ (x >> U64(27))) * _SPREAD[1]
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_FACTOR), -1, 1 << 64)
    up, down = np.full(n, _FACTOR), np.full(n, U64(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


@dataclass
class Block:
    """Distinct shingles of some texts. text: index of each shingle's text, in order; count: how often it occurs there."""

    texts: list[int]
    text: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def _shingled(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle, in order of the texts. A text of fewer words, but not none, is one shingle."""
    data = _BYTES[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    size = 1 << max(16, len(data).bit_length())
    up, down = _powers(size)
    inside = data != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(data * up[: len(data)], dtype=U64)])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    of = np.searchsorted(np.cumsum(sizes), start, side="right")
    n = len(word) - SHINGLE + 1
    full = np.flatnonzero(of[: max(n, 0)] == of[SHINGLE - 1 :]) if n > 0 else np.zeros(0, np.int64)
    hashes = sum((word[full + k] * _PLACE[k] for k in range(SHINGLE)), np.zeros(len(full), U64))
    first, counts = np.unique(of, return_index=True)[1], np.bincount(of, minlength=len(raw))
    short = [(of[i], word[i : i + counts[of[i]]]) for i in first if counts[of[i]] < SHINGLE]
    extra = np.array([int((w * _PLACE[: len(w)]).sum() + U64(len(w))) for _, w in short], U64)
    texts = np.concatenate([of[full], np.array([t for t, _ in short], np.int64)])
    return texts, mix(np.concatenate([hashes, extra]))


def blocks(texts: list[str]) -> Iterator[Block]:
    """Shingles of all texts, a block of about BLOCK_BYTES at a time; a longer text is a block of its own."""
    group, raw, held = [], [], 0
    for i in range(len(texts) + 1):
        own = texts[i].encode() if i < len(texts) else b""
        if group and (i == len(texts) or held + len(own) > BLOCK_BYTES):
            of, hashes = _shingled(raw)
            order = np.lexsort((hashes, of))
            of, hashes = of[order], hashes[order]
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])])) if len(of) else np.zeros(0, np.int64)
            yield Block(group, of[new], hashes[new], np.diff(np.append(new, len(of))))
            group, raw, held = [], [], 0
        if i < len(texts):
            group.append(i)
            raw.append(own)
            held += len(own)
