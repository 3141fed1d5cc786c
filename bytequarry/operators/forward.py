"""Two formats whose matches look ahead, so that a blob is decoded from its end: byte-aligned, and bucketed codes.

The byte-aligned format's parse minimises, from the end backwards, the sum of bytes per covered byte; the bucketed
one defers a match if a later one within reach is longer by more than the distance. Streams hold tokens from the
last to the first, in framing of their own."""

from __future__ import annotations

import numpy as np

from ..functions.bits import BUCKET_LENGTHS, BUCKET_OFFSETS
from .parse import SEARCHED, PairIndex

#: Window and longest match of both formats, limits of the aligned format's tokens.
ALIGNED_WINDOW, ALIGNED_LONGEST, SHORT_LENGTH, SHORT_OFFSET, MIDDLE_LENGTH, LONGEST_RUN = 2048, 272, 3, 32, 17, 63
BUCKET_WINDOW, BUCKET_LONGEST = 18720, 171


def longest_ahead(data: bytes, window: int, longest: int) -> list[tuple[int, int]]:
    """(length, offset) of the longest later occurrence of each place, the nearest of equal ones; (0, 0) if none."""
    index, out = PairIndex(data), []
    for first in range(0, len(data), SEARCHED):
        place = np.arange(first, min(first + SEARCHED, len(data)))
        best, offset = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        live, k = np.arange(len(place)), 0
        while len(live):
            k += 1
            there, at = index.neighbour(place[live], k)
            near = there & (at - place[live] <= window)
            live, at = live[near], at[near]
            # only one that agrees at the place beyond the best length so far can be longer
            most = np.minimum(longest, len(data) - at)
            may = np.flatnonzero(most > best[live])
            may = may[index.raw[at[may] + best[live[may]]] == index.raw[place[live[may]] + best[live[may]]]]
            length = index.common(place[live[may]], at[may], most[may])
            better = length > np.maximum(1, best[live[may]])
            chosen = live[may[better]]
            best[chosen], offset[chosen] = length[better], at[may[better]] - place[chosen]
            live = live[best[live] < longest]
        out += zip(best.tolist(), offset.tolist())
    return out


def aligned_size(length: int, offset: int) -> int:
    if length <= SHORT_LENGTH and offset <= SHORT_OFFSET:
        return 1
    return 2 if length <= MIDDLE_LENGTH else 3


def _least_cost(data: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(length, offset) of the tokens in order; a literal is (1, 0)."""
    rest = [0.0] * (len(data) + 1)
    chosen = [1] * len(data)
    for n in range(len(data) - 1, -1, -1):
        length, offset = found[n]
        best, pick = 1.0 + rest[n + 1], 1
        for i in range(2, length + 1):
            value = aligned_size(i, offset) / i + rest[n + i]
            if value <= best:  # the longest of equal ones
                best, pick = value, i
        rest[n], chosen[n] = best, pick
    tokens, n = [], 0
    while n < len(data):
        k = chosen[n]
        tokens.append((k, found[n][1] if k > 1 else 0))
        n += k
    return tokens


#: How the aligned format's tokens are chosen.
MODES = ("least", "deferred", "greedy")


def aligned_tokens(data: bytes, mode: str = "least") -> list[tuple[int, int]]:
    """(length, offset) of the tokens by least cost, by the longest match at each place (greedy), or by the longest one
    that no later match beats by more than its distance and one (deferred)."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    found = longest_ahead(data, ALIGNED_WINDOW, ALIGNED_LONGEST)
    return _least_cost(data, found) if mode == "least" else _walk(found, 1 if mode == "greedy" else len(data), 1)


def _walk(found: list[tuple[int, int]], reach: int, over: int, fits=lambda length, offset: True) -> list[tuple[int, int]]:
    """Tokens from the first place on: a match gives way if one of the next places, nearer than `reach`, has one that is
    longer by more than the distance and `over`; it is then cut to that distance, or becomes a literal."""
    tokens, n = [], 0
    while n < len(found):
        length, offset = found[n]
        give = 0
        for j in range(1, min(length, reach, len(found) - n)):
            if found[n + j][0] > found[n + give][0] + j + over:
                give = j
        take = give or length
        tokens.append((take, offset) if take > 1 and fits(take, offset) else (1, 0))
        n += tokens[-1][0]
    return tokens


def aligned_encode(data: bytes, mode: str = "least") -> bytes:
    """Tokens from the last to the first: runs of literals, short, middle and long matches; then a zero."""
    out, at, run = bytearray(), len(data), bytearray()

    def flush():
        if run:
            out.append(len(run))
            out.extend(run)
            run.clear()

    for length, offset in reversed(aligned_tokens(data, mode)):
        at -= length
        if length == 1:
            run.append(data[at])
            if len(run) == LONGEST_RUN:
                flush()
            continue
        flush()
        if aligned_size(length, offset) == 1:
            out.append(64 | (length - 2) << 5 | offset - 1)
        else:
            base = min(length, MIDDLE_LENGTH)
            out.append(128 | (base - 2) << 3 | offset - 1 >> 8)
            if base == MIDDLE_LENGTH:
                out.append(length - MIDDLE_LENGTH)
            out.append(offset - 1 & 255)
    flush()
    return bytes(out) + b"\0"


def aligned_decode(stream: bytes) -> bytes:
    out, at = bytearray(), 0  # the blob backwards
    while tag := stream[at]:
        at += 1
        if tag < 64:
            out += stream[at : at + tag]
            at += tag
            continue
        if tag < 128:
            length, offset = 2 + (tag >> 5 & 1), (tag & 31) + 1
        else:
            length = (tag >> 3 & 15) + 2
            if length == MIDDLE_LENGTH:
                length += stream[at]
                at += 1
            offset = ((tag & 7) << 8 | stream[at]) + 1
            at += 1
        for _ in range(length):
            out.append(out[-offset])
    return bytes(reversed(out))


#: Places ahead that a match may give way to (fixed value).
REACH = 32


def deferred_parse(data: bytes, reach: int = REACH) -> list[tuple[int, int]]:
    """(length, offset) of the tokens: a match gives way if one of the next places has a longer one, by more than the
    distance. A reach of 1 takes the longest match at each place, and of 2 looks one place ahead."""
    fits = lambda length, offset: length > 2 or offset < BUCKET_OFFSETS[3][0]
    found = longest_ahead(data, BUCKET_WINDOW, BUCKET_LONGEST)
    return _walk([f if fits(*f) else (0, 0) for f in found], reach, 0, fits)


def _bucket(v: int, classes) -> int:
    return sum(v >= first for first, _ in classes) - 1


def canonical(lengths: list[int]) -> list[str]:
    """The canonical prefix code of these lengths: codes rise with the length, and with the index among equal ones."""
    out, code, size = [""] * len(lengths), -1, 0
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        code = (code + 1) << lengths[i] - size
        size = lengths[i]
        out[i] = format(code, f"0{size}b")
    return out


def bucket_prefixes(counts: list[int]) -> list[str]:
    """Prefix codes of the 16 buckets: by falling count pairs get 3 to 8 bits, the last four 9; the code of one bit is
    a literal's."""
    lengths = [0] * 16
    for rank, i in enumerate(sorted(range(16), key=lambda i: (-counts[i], i))):
        lengths[i] = min(3 + rank // 2, 9)
    return canonical([1, *lengths])[1:]


def low_first(pattern: str) -> bytes:
    """Bits from the lowest of each byte on; a 1 ends them, and zeros fill the last byte."""
    return int("1" + pattern[::-1], 2).to_bytes(len(pattern) // 8 + 1, "little")


def pattern_of(data: bytes) -> str:
    return format(int.from_bytes(data, "little"), "b")[:0:-1]


def with_length(stream: bytes, size: int) -> bytes:
    """The stream and a trailer: the blob's size in 16 bits, the low byte first."""
    if size >= 1 << 16:
        raise ValueError("the size does not fit 16 bits")
    return stream + size.to_bytes(2, "little")


def bucket_encode(data: bytes, reach: int = REACH) -> bytes:
    """Size, the 16 buckets in the order of their codes, the number of bytes of bits, the bits, and the literals. Bits of
    the tokens: 0 for a literal, or a bucket's code, offset and length."""
    tokens = deferred_parse(data, reach)
    buckets = [_bucket(k, BUCKET_LENGTHS) * 4 + _bucket(o, BUCKET_OFFSETS) if k > 1 else -1 for k, o in tokens]
    codes = bucket_prefixes([buckets.count(i) for i in range(16)])
    order = sorted(range(16), key=lambda i: (len(codes[i]), codes[i]))
    pattern, literals, at = [], bytearray(), len(data)
    for (k, o), b in zip(reversed(tokens), reversed(buckets)):
        at -= k
        if k == 1:
            pattern.append("0")
            literals.append(data[at])
            continue
        pattern.append(codes[b])
        for v, classes, c in ((o, BUCKET_OFFSETS, b % 4), (k, BUCKET_LENGTHS, b // 4)):
            first, n = classes[c]
            pattern.append(format(v - first, f"0{n}b"))
    table, coded = bytes(order[k] << 4 | order[k + 1] for k in range(0, 16, 2)), low_first("".join(pattern))
    return len(data).to_bytes(3, "big") + table + len(coded).to_bytes(3, "big") + coded + bytes(literals)


def bucket_decode(stream: bytes) -> bytes:
    size, order = int.from_bytes(stream[:3], "big"), [x for b in stream[3:11] for x in (b >> 4, b & 15)]
    shapes = sorted(bucket_prefixes([0] * 16), key=lambda c: (len(c), c))
    owner = dict(zip(shapes, order))
    end = 14 + int.from_bytes(stream[11:14], "big")
    bits = pattern_of(stream[14:end])
    literals, out, at = iter(stream[end:]), bytearray(), 0
    while len(out) < size:
        if bits[at] == "0":
            out.append(next(literals))
            at += 1
            continue
        n = 3
        while bits[at : at + n] not in owner:
            n += 1
        b, at = owner[bits[at : at + n]], at + n
        values = []
        for first, n in (BUCKET_OFFSETS[b % 4], BUCKET_LENGTHS[b // 4]):
            values.append(first + int(bits[at : at + n] or "0", 2))
            at += n
        for _ in range(values[1]):
            out.append(out[-values[0]])
    return bytes(reversed(out))
