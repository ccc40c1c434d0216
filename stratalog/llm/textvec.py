"""Words of many texts at once, as numpy arrays over one byte buffer.

A batch of texts is laid end to end, lower-cased (A-Z) and split by a byte table, so the work
per word is a few vector operations instead of a Python loop.  Every word gets a 64-bit hash:
a polynomial of its bytes modulo 2^64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: bytes that are not words: ASCII but for digits and letters
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: bytes that are not words: ASCII white space
SPACES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))

U64 = np.uint64
RADIX = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(RADIX, -1, 1 << 64)
C1, C2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the output."""
    x = x ^ (x >> U64(33))
    x = x * C1
    x ^= x >> U64(33)
    x *= C2
    x ^= x >> U64(33)
    return x


@cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about limit bytes, with the index of the first."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


class Words:
    """Words of texts: start and end in buffer, doc (index of the text), hash; first[d] to first[d + 1] are those of text d."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.buffer = (b" ".join(texts) + b" ").translate(table)
        raw = np.frombuffer(self.buffer, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = raw != 32
        steps = np.diff(inside)
        self.start = np.flatnonzero(steps == 1)
        self.end = np.flatnonzero(steps == -1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(raw))
        self.first = np.searchsorted(self.start, self.offset)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        room = 1 << max(20, int(len(raw)).bit_length())
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(raw * powers(RADIX, room)[: len(raw)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(INVERSE, room)[self.start] + (self.end - self.start).astype(U64))

    def word(self, k: int) -> bytes:
        return self.buffer[self.start[k] : self.end[k]]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the width words from each word on, and whether they all stand in one text."""
        n = len(self.hash)
        out = np.zeros(n, U64)
        for k in range(min(width, n)):  # with fewer words no shingle is whole
            out[: n - k] += mix(self.hash[k:] + U64(k * 0x51ED27 + width))
        last = np.arange(n) + width <= self.first[1:][self.doc] if n else np.zeros(0, bool)
        return mix(out), last


def window_hashes(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words from each of some words on: that of Words.shingles."""
    out = np.zeros(len(at), U64)
    for k in range(width):
        out += mix(words.hash[at + k] + U64(k * 0x51ED27 + width))
    return mix(out)


def fingerprint(texts: list[bytes], table: bytes, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; one of all words if there are fewer than width."""
    out = []
    for _, run in chunks(texts):
        w = Words(run, table)
        sh, ok = w.shingles(width)
        for d in range(len(run)):
            a, b = w.first[d], w.first[d + 1]
            if b - a >= width:
                out.append(np.unique(sh[a : b - width + 1]))
            elif b > a:
                out.append(whole(w, a, b))
            else:
                out.append(np.empty(0, U64))
    return out


def whole(w: Words, a: int, b: int) -> np.ndarray:
    """The one shingle of a text of fewer words than the width."""
    return mix((w.hash[a:b] * powers(INVERSE, 1 << 20)[1 : b - a + 1]).sum(keepdims=True) + U64(b - a))
