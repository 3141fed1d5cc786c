"""Binary containers: tape images and segmented executables.

Executables are sequences of big-endian words: a header with segment sizes and memory flags, then for each segment
its content (code, data, or a size of zeros), relocations, and an end mark."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Fixed values of the executable format.
NAME, CODE, DATA, ZEROS, RELOC32, SYMBOL, DEBUG, END, HEADER, OVERLAY, RELOC_SHORT = 0x3E8, 0x3E9, 0x3EA, 0x3EB, 0x3EC, 0x3F0, 0x3F1, 0x3F2, 0x3F3, 0x3F5, 0x3FC
KIND_MASK, SIZE_MASK = 0x3FFFFFFF, 0x3FFFFFFF


def checksum(block: bytes) -> int:
    x = 0
    for b in block:
        x ^= b
    return x


def tape_block(flag: int, data: bytes) -> bytes:
    """Length (little-endian, of what follows), flag, data, and a checksum that makes the exclusive or zero."""
    body = bytes([flag]) + data
    return struct.pack("<H", len(body) + 1) + body + bytes([checksum(body)])


def tape(data: bytes, name: str, start: int = 32768, kind: int = 3) -> bytes:
    """A header block (kind, ten-character name, length, two parameters) and a data block."""
    if len(data) > 65533:
        raise ValueError("a tape block holds at most 65533 bytes")
    head = bytes([kind]) + name[:10].ljust(10).encode("ascii", "replace") + struct.pack("<HHH", len(data), start, 32768)
    return tape_block(0, head) + tape_block(255, data)


def tape_blocks(image: bytes) -> list[tuple[int, bytes, bool]]:
    """(flag, data, is the checksum right) of each block."""
    out, at = [], 0
    while at + 2 <= len(image):
        (n,) = struct.unpack_from("<H", image, at)
        body = image[at + 2 : at + 2 + n]
        out.append((body[0], body[1:-1], checksum(body) == 0 and len(body) == n))
        at += 2 + n
    return out


@dataclass
class Segment:
    kind: int
    memory: int
    data: bytes
    size: int  # in memory; beyond the data are zeros
    relocs: dict[int, set[int]] = field(default_factory=dict)  # target segment -> places in this one

    @property
    def merge_key(self) -> int:
        return self.kind | self.memory << 30


def _words(values: Iterable[int]) -> bytes:
    return b"".join(struct.pack(">I", v & 0xFFFFFFFF) for v in values)


def build(segments: list[Segment]) -> bytes:
    out = [_words([HEADER, 0, len(segments), 0, len(segments) - 1, *((s.size + 3) // 4 | s.memory << 30 for s in segments)])]
    for s in segments:
        if s.kind == ZEROS:
            out.append(_words([ZEROS, (s.size + 3) // 4]))
        else:
            data = s.data + bytes(-len(s.data) % 4)
            out += [_words([s.kind, len(data) // 4]), data]
        some = {t: sorted(p) for t, p in sorted(s.relocs.items()) if p}
        if some:
            out.append(_words([RELOC32, *(x for t, p in some.items() for x in (len(p), t, *p)), 0]))
        out.append(_words([END]))
    return b"".join(out)


def parse(image: bytes) -> list[Segment]:
    """Segments of an executable; symbols, names and debug parts are passed over, overlays are refused."""
    at = 0

    def word() -> int:
        nonlocal at
        if at + 4 > len(image):
            raise ValueError("the executable ends early")
        at += 4
        return struct.unpack_from(">I", image, at - 4)[0]

    if word() != HEADER:
        raise ValueError("no executable header")
    while n := word():
        at += 4 * n
    word()
    first, last = word(), word()
    sizes = []
    for _ in range(last - first + 1):
        w = word()
        if w >> 30 == 3:
            word()
        sizes.append((w >> 30, (w & SIZE_MASK) * 4))
    segments: list[Segment] = []
    while len(segments) < len(sizes) or at < len(image):
        kind = word() & KIND_MASK
        if kind in (CODE, DATA, ZEROS):
            memory, size = sizes[len(segments)]
            n = (word() & SIZE_MASK) * 4
            segments.append(Segment(kind, memory, b"" if kind == ZEROS else image[at : at + n], max(size, n)))
            at += 0 if kind == ZEROS else n
        elif kind == RELOC32:
            while n := word():
                segments[-1].relocs.setdefault(word(), set()).update(word() for _ in range(n))
        elif kind == RELOC_SHORT:
            begin = at
            half = lambda: struct.unpack_from(">H", image, at)[0]
            while n := half():
                target = struct.unpack_from(">H", image, at + 2)[0]
                segments[-1].relocs.setdefault(target, set()).update(struct.unpack_from(f">{n}H", image, at + 4))
                at += 4 + 2 * n
            at += 2
            at += (at - begin) % 4
        elif kind == SYMBOL:
            while n := word():
                at += 4 * n + 4
        elif kind in (NAME, DEBUG):
            at += 4 * word()
        elif kind == OVERLAY:
            raise ValueError("overlays are not supported")
        elif kind != END:
            raise ValueError(f"unknown part {kind:#x}")
    return segments


def merge(segments: list[Segment]) -> list[Segment]:
    """One segment for each kind and memory type, in the order first seen; places and stored addresses are rebased."""
    into: dict[int, int] = {}
    place: list[tuple[int, int]] = []
    merged: list[Segment] = []
    for s in segments:
        k = into.setdefault(s.merge_key, len(into))
        if k == len(merged):
            merged.append(Segment(s.kind, s.memory, b"", 0))
        place.append((k, merged[k].size))
        if s.kind != ZEROS:
            merged[k].data += bytes(merged[k].size - len(merged[k].data)) + s.data
        merged[k].size += s.size + -s.size % 4
    for s, (k, base) in zip(segments, place):
        data = bytearray(merged[k].data)
        for target, offs in s.relocs.items():
            to, added = place[target]
            for o in offs:
                (v,) = struct.unpack_from(">I", data, base + o)
                struct.pack_into(">I", data, base + o, (v + added) & 0xFFFFFFFF)
                merged[k].relocs.setdefault(to, set()).add(base + o)
        merged[k].data = bytes(data)
    return merged


def load(segments: list[Segment], at: list[int]) -> list[bytes]:
    """Memory of each segment after relocation to the given addresses."""
    out = []
    for s in segments:
        data = bytearray(s.data + bytes(s.size - len(s.data)))
        for target, offs in s.relocs.items():
            for o in offs:
                struct.pack_into(">I", data, o, (struct.unpack_from(">I", data, o)[0] + at[target]) & 0xFFFFFFFF)
        out.append(bytes(data))
    return out


def varint(delta: int) -> bytes:
    """A halved delta in 7-bit groups, the top one first; all but the last have the high bit."""
    v = delta >> 1
    groups = [v & 127]
    while v := v >> 7:
        groups.append(v & 127 | 128)
    return bytes(reversed(groups))


def packed_relocs(segments: list[Segment]) -> bytes:
    """For each pair of segments: both numbers from 1, deltas of the sorted places, a zero, even length."""
    out = bytearray()
    for s, segment in enumerate(segments):
        for t, offs in sorted(segment.relocs.items()):
            out += struct.pack(">HH", t + 1, s + 1)
            before = 0
            for o in sorted(offs):
                out += varint(o - before)
                before = o
            out += bytes(1 + (len(out) + 1) % 2)
    return bytes(out)


def stripped(segments: list[Segment]) -> bytes:
    """A compact image that keeps the segments: their number; for each its memory and size, kind and data, without
    symbols and names; all relocations, grouped by segment and target; a zero."""
    out = bytearray(struct.pack(">H", len(segments)))
    for s in segments:
        data = b"" if s.kind == ZEROS else s.data + bytes(-len(s.data) % 4)
        out += _words([(s.size + 3) // 4 | s.memory << 30, len(data) // 4 | (CODE, DATA, ZEROS).index(s.kind) << 30]) + data
    return bytes(out) + packed_relocs(segments) + bytes(2)


def restored(image: bytes) -> list[Segment]:
    """The segments of a compact image."""
    (n,), at, segments = struct.unpack_from(">H", image), 2, []
    for _ in range(n):
        size, held = struct.unpack_from(">II", image, at)
        at += 8 + 4 * (held & SIZE_MASK)
        segments.append(Segment((CODE, DATA, ZEROS)[held >> 30], size >> 30, image[at - 4 * (held & SIZE_MASK) : at], 4 * (size & SIZE_MASK)))
    begin = at
    while struct.unpack_from(">H", image, at)[0]:
        target, source = struct.unpack_from(">HH", image, at)
        at, place, offs = at + 4, 0, set()
        while image[at] or not offs:  # the first place may be 0
            v = 0
            while image[at] & 128:
                v, at = v << 7 | image[at] & 127, at + 1
            place += (v << 7 | image[at]) << 1
            offs.add(place)
            at += 1
        at += 1
        at += (at - begin) % 2  # of even length
        segments[source - 1].relocs[target - 1] = offs
    return segments


#: What is done to an executable before it is compressed.
PREPARATIONS = {"merge": lambda image: build(merge(parse(image))), "strip": lambda image: stripped(parse(image)), "none": lambda image: image}


def prepared(image: bytes, how: str) -> bytes:
    if how not in PREPARATIONS:
        raise ValueError(f"no such preparation: {how}")
    return PREPARATIONS[how](image)


# --- images that start themselves --------------------------------------------------------------------------------
#: A call of an absolute address, and the instruction after it.
CALL, AFTER = 0x4EB9, 0x4E70


@dataclass(frozen=True)
class Loader:
    """Machine code that decodes the stream behind it, which the caller has, and the places in it of the words that
    each image sets: the stream's length, and the addresses to load to and to start at."""

    code: bytes
    length_at: int
    load_at: int | None = None
    jump_at: int | None = None

    def before(self, stream: bytes, load: int = 0, jump: int = 0) -> Segment:
        """The segment of the code, with its words set, and the stream."""
        content = bytearray(self.code)
        for place, value in ((self.length_at, len(stream)), (self.load_at, load), (self.jump_at, jump)):
            if place is not None:
                struct.pack_into(">I", content, place, value)
        content += stream + bytes(-(len(content) + len(stream)) % 4)
        return Segment(CODE, 0, bytes(content), len(content))

    def stream(self, image: bytes) -> bytes:
        """The stream that an image carries."""
        last = parse(image)[-1].data
        (n,) = struct.unpack_from(">I", last, self.length_at)
        return last[len(self.code) : len(self.code) + n]


def at_address(loader: Loader, stream: bytes, load: int, jump: int) -> bytes:
    """An image of one segment, whose content goes to a fixed address."""
    if loader.load_at is None or loader.jump_at is None:
        raise ValueError("the loader takes no addresses")
    return build([loader.before(stream, load, jump)])


def self_starting(loader: Loader, stream: bytes, segments: list[Segment]) -> bytes:
    """An image with the memory of `segments`: the first calls the loader, by a relocated address, the others are empty
    but of full size, and the loader comes last, with the stream."""
    if not segments or segments[0].kind != CODE:
        raise ValueError("an executable begins with code")
    first = Segment(CODE, segments[0].memory, struct.pack(">HIH", CALL, 0, AFTER), max(8, segments[0].size), {len(segments): {2}})
    return build([first, *(Segment(s.kind, s.memory, b"", s.size) for s in segments[1:]), loader.before(stream)])
