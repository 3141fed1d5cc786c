"""Words of whole text batches with numpy: positions, 64-bit hashes, windows of words.

The hash of a byte range starts from its length and takes in 8 bytes at a time: h = mix(h xor bytes), where mix is
a bijection. Ranges of 8 bytes at most have different hashes if they differ and have the same length; others are
compared where a collision would matter (`same_bytes`). Ranges of more than LONG bytes are hashed by XXH3.
"""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = 0x9E3779B97F4A7C15 | 1
#: Bytes from which a range is hashed and compared on its own.
LONG = 512
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks that leave the first k of 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Lower-cases A-Z; words are ASCII letters, digits and all bytes from 0x80.
ALNUM_MAP = np.arange(256, dtype=np.uint8)
ALNUM_MAP[0x41:0x5B] += 32
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words are what lies between white space (space, tab to carriage return).
SPACED = np.ones(256, bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def chunks(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of buf (zeros follow it), as numbers; a view without copies of its own."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of buf."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_ODD) + _SEED)
    eight = chunks(buf)
    live = None  # all at first
    at, left, h = starts, size, out
    if len(size) and size.max() > LONG:
        view = memoryview(np.ascontiguousarray(buf))
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(view[starts[k] : ends[k]])
        live = np.flatnonzero(size <= LONG)
        at, left, h = starts[live], size[live], out[live]
    while len(at):
        h = mix(h ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        if live is None:
            out = h
        else:
            out[live] = h
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left, h = at[more] + 8, left[more] - 8, h[more]
    return out


def window_hash(buf: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes (8 at least) from each place of buf, put together from hashes of half the bytes."""
    if len(buf) < size:
        return np.zeros(0, np.uint64)
    out, span = mix(chunks(buf)[: len(buf) - 7]), 8
    while span < size:
        step = min(span, size - span)
        ahead = out[step:]
        out = out[: len(ahead)] * np.uint64(_ODD)
        out += ahead
        out, span = mix(out), span + step
    return out


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the `size` bytes of a from `at` those of b from `other`, for each of the ranges?"""
    out = np.ones(len(at), bool)
    live = np.flatnonzero(size > 0)
    if len(live) and size.max() > LONG:
        va, vb = memoryview(np.ascontiguousarray(a)), memoryview(np.ascontiguousarray(b))
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = va[at[k] : at[k] + size[k]] == vb[other[k] : other[k] + size[k]]
        live = np.flatnonzero((size > 0) & (size <= LONG))
    ea = chunks(a)
    eb = ea if a is b else chunks(b)
    x, y, left = at[live], other[live], size[live]
    while len(live):
        good = (ea[x] ^ eb[y]) & _FIRST[np.minimum(left, 8)] == 0
        out[live[~good]] = False
        more = np.flatnonzero(good & (left > 8))
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    return out


def text_hash(word: bytes) -> int:
    buf = np.frombuffer(word, np.uint8)
    return int(range_hash(buf, np.array([0]), np.array([len(buf)]))[0])


class Words:
    """Words of a batch: byte ranges `starts`, `ends`, `hash`, and `doc`, the offsets of each row's words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, kind: np.ndarray, mapped: np.ndarray | None = None, hashed: bool = True):
        inside = kind[buf]
        first = inside.copy()
        last = inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            inner = offs[1:-1]
            inner = inner[(inner > 0) & (inner < len(buf))]
            first[inner] |= inside[inner]
            last[inner - 1] |= inside[inner - 1]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.starts, offs)
        if hashed:
            self.hash = range_hash(buf if mapped is None else mapped[buf], self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), self.counts)


class Lexicon:
    """Numbers of a fixed list of different words, found by hash and held against their bytes."""

    def __init__(self, words: list[bytes]):
        self.raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        hashes = range_hash(self.raw, self.starts, self.ends)
        self.word = np.argsort(hashes)
        self.hashes = hashes[self.word]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: Words, low: np.ndarray) -> np.ndarray:
        """The number of each word of a batch, whose bytes `low` holds as they were hashed; -1 for other words."""
        out = np.full(len(words.starts), -1)
        if not len(self.hashes):
            return out
        maybe = np.flatnonzero(self.filter[(words.hash >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words.hash[maybe]), len(self.hashes) - 1)
        w = self.word[at]
        size = words.ends[maybe] - words.starts[maybe]
        live = np.flatnonzero((self.hashes[at] == words.hash[maybe]) & (size == self.ends[w] - self.starts[w]))
        maybe, w = maybe[live], w[live]
        right = same_bytes(low, words.starts[maybe], self.raw, self.starts[w], size[live])
        out[maybe[right]] = w[right]
        return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive words, by its first word; the last size - 1 are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(_ODD)
        out += hashes[j : j + n]
    return mix(out)


def window_valid(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """Which of the windows lie within one row."""
    ok = np.ones(max(0, total - size + 1), bool)
    ends = np.cumsum(counts)
    for e in (ends[:-1] if len(ends) else ends)[None, :]:
        cut = e[:, None] - np.arange(1, size)[None, :]
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return ok


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flags over the ranges that the offsets bound."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
