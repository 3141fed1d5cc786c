"""Token ids of whole texts, by the tokenizers library, with a cache of the pieces between safe cuts.

The ids are those of `Tokenizer.encode(text, add_special_tokens=False)`: the string of a special token in a text is
that token. A safe cut is a place where the tokenizer always begins a new token, whatever stands on either side, so
that pieces may be encoded alone. For byte-level BPE with its usual pattern: before a single space between other
characters, and around a single line end between other characters. For a tokenizer that drops white space: at all
ASCII white space. For both: between a Latin letter and ASCII punctuation. Texts with white space outside ASCII are
encoded whole by the former, and texts with a special token's string by both.

Pieces recur often, so most come from the cache, an open hash table that a worker process keeps for all its tasks.
What comes from it is held against the piece's bytes; a text with a piece whose key belongs to other bytes is encoded
whole. Pieces that are not there are encoded many at a time, with a special token between them.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from .words import ALNUM_MAP, SPACED, range_hash, same_bytes

END_ID = 1
#: Entries of the cache (some 75 MB, table and all); when it is full it starts anew.
CACHE = 700_000
#: Slots of the table, as a power of two.
SLOTS = 21


def wide_space(buf: np.ndarray) -> np.ndarray:
    """Places where a white space character outside ASCII starts."""
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    lead = lead[lead + 1 < len(buf)]
    a, b = buf[lead], buf[lead + 1]
    c = buf[np.minimum(lead + 2, len(buf) - 1)]
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    found |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[found]


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
#: Divides pieces that are encoded together; any special token would do.
SEPARATOR = "<|endoftext|>"


def letter_ends(buf: np.ndarray) -> np.ndarray:
    """Flags of the bytes that follow a Latin letter and are ASCII punctuation."""
    out = np.zeros(len(buf), bool)
    letter = _LETTER[buf]
    wide = np.zeros(len(buf), bool)
    wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    out[1:] = (letter | wide)[:-1] & _PUNCT[buf[1:]]
    return out


def located(path: str) -> str:
    """A bare file name is one of the public tokenizers' files, wherever this machine keeps them."""
    if os.path.basename(path) != path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@cache
def encoder(path: str, drops_space: bool, lowers: bool) -> Encoder:
    """The worker process's encoder of these parameters, with what its cache holds from earlier tasks."""
    return Encoder(path, drops_space, lowers)


class Encoder:
    def __init__(self, path: str, drops_space: bool, lowers: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(located(path))
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.special = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.drops_space, self.mapped = drops_space, ALNUM_MAP if lowers else None
        self._clear()

    def _clear(self, expected: int = 0) -> None:
        self.bits = max(SLOTS, (2 * expected).bit_length())  # one part may need more
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.place = np.zeros(1 << self.bits, np.int32)  # a piece's place in the tables below
        self.many = 0
        self.size, self.begin = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64)  # its ids, in `flat`
        self.length, self.at = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64)  # its bytes, in `raw`
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.held = np.zeros(1 << 16, np.uint8), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces' places; -1 where the table has none."""
        out = np.full(len(keys), -1)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        live = None
        while len(slot):
            there = self.keys[slot]
            same = there == (keys if live is None else keys[live])
            if live is None:
                out[same] = self.place[slot[same]]
            else:
                out[live[same]] = self.place[slot[same]]
            on = np.flatnonzero(~same & (there != 0))
            live = on if live is None else live[on]
            slot = (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Enter different keys that the table has not."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]  # of several for one slot the last gets it
            self.place[slot[free]] = places[free]
            left = np.flatnonzero(self.keys[slot] != keys)
            keys, places, slot = keys[left], places[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, and the offsets of each row's pieces."""
        space = ~SPACED[buf]
        n = len(buf)
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        if self.drops_space:
            first, last = ~space, ~space
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            first[inner] |= ~space[inner]
            last[inner - 1] |= ~space[inner - 1]
            cut = letter_ends(buf)
            cut[offs[:-1][offs[:-1] < n]] = False
            first |= cut
            last[:-1] |= cut[1:]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            alone = space.copy()  # white space between other characters of one row
            alone[1:] &= ~space[:-1]
            alone[:-1] &= ~space[1:]
            edges = np.concatenate([offs[:-1], offs[1:] - 1])
            alone[edges[(edges >= 0) & (edges < n)]] = False
            cut = alone & (buf == 32)
            line = np.flatnonzero(alone & (buf == 10))
            cut[line] = cut[line + 1] = True
            cut |= letter_ends(buf)
            begins = offs[:-1][np.diff(offs) > 0]
            cut[begins] = True
            if len(wide := wide_space(buf)):
                rows = np.unique(np.searchsorted(offs, wide, "right") - 1)
                for r in rows.tolist():
                    cut[offs[r] + 1 : offs[r + 1]] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n) if len(starts) else starts
        return starts, ends, np.searchsorted(starts, offs)

    def _whole(self, buf: np.ndarray, offs: np.ndarray) -> set[int]:
        """Rows with a special token's string, in any case of letters."""
        low, out = ALNUM_MAP[buf].tobytes(), set()
        for token in self.special:
            at = low.find(token)
            while at >= 0:
                out.add(int(np.searchsorted(offs, at, "right")) - 1)
                at = low.find(token, at + 1)
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's followed by the end id, and the offsets of the rows."""
        n = len(offs) - 1
        if not len(buf):
            return np.full(n, END_ID, np.uint32), np.arange(n + 1)
        starts, ends, doc = self._pieces(buf, offs)
        mapped = buf if self.mapped is None else self.mapped[buf]
        keys = range_hash(mapped, starts, ends)
        zero = np.flatnonzero(keys == 0)  # means a free slot
        keys[zero] = 1
        piece = self._find(keys)
        missing = np.flatnonzero(piece < 0)
        if len(missing):
            fresh, where = np.unique(keys[missing], return_index=True)
            if self.many + len(fresh) > min(CACHE, len(self.keys) // 2):
                fresh, where = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
                self._clear(len(fresh))
            self._add(fresh, mapped, buf, starts[missing[where]], ends[missing[where]])
            piece[missing] = self._find(keys[missing])
        right = self.length[piece] == ends - starts
        right[zero] = False
        # equal keys of one length are equal bytes up to 8 of them
        long = np.flatnonzero(right & (ends - starts > 8))
        right[long] = same_bytes(mapped, starts[long], self.raw, self.at[piece[long]], ends[long] - starts[long])
        row_of_piece = np.repeat(np.arange(n), np.diff(doc))
        sizes = self.size[piece].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out_offs = upto[doc] + np.arange(n + 1)
        ids = np.full(out_offs[-1], END_ID, np.uint32)
        if upto[-1]:
            source = np.repeat(self.begin[piece] - upto[:-1], sizes) + np.arange(upto[-1])
            target = np.repeat(row_of_piece, sizes) + np.arange(upto[-1])
            ids[target] = self.flat[source]
        alone = self._whole(buf, offs) | set(row_of_piece[~right].tolist())
        if alone:
            split = np.split(ids, out_offs[1:-1])
            for r in alone:
                text = buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace")
                split[r] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
            ids, out_offs = np.concatenate(split), np.concatenate([[0], np.cumsum([len(x) for x in split])])
        return ids, out_offs

    def _add(self, keys: np.ndarray, mapped: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = buf.tobytes()
        flat, sizes = self._encode_pieces([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())])
        length = ends - starts
        places = np.arange(self.many, self.many + len(keys))
        while len(self.size) < self.many + len(keys):
            for name in ("size", "begin", "length", "at"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.raw) < self.held + length.sum():
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        upto = np.cumsum(length) - length
        self.raw[self.held : self.held + int(length.sum())] = mapped[np.repeat(starts - upto, length) + np.arange(length.sum())]
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[places], self.begin[places] = sizes, self.used + np.cumsum(sizes) - sizes
        self.length[places], self.at[places] = length, self.held + upto
        self._put(keys, places)
        self.many, self.used, self.held = self.many + len(keys), self.used + len(flat), self.held + int(length.sum())

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        odd = [k for k, t in enumerate(texts) if "<|" in t or not t]
        if odd:  # what might form a special token with the next one is encoded alone
            alone = {k: self.tokenizer.encode(texts[k], add_special_tokens=False).ids for k in odd}
            texts = ["" if k in alone else t for k, t in enumerate(texts)]
        groups = [SEPARATOR.join([*texts[k : k + 512], ""]) for k in range(0, len(texts), 512)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        stops = np.flatnonzero(flat == self.separator)
        sizes = np.diff(stops, prepend=-1) - 1
        flat = np.delete(flat, stops)
        if odd:
            split = np.split(flat, np.cumsum(sizes)[:-1])
            for k, ids in alone.items():
                split[k] = np.array(ids, np.uint32)
                sizes[k] = len(ids)
            flat = np.concatenate(split).astype(np.uint32)
        return flat, sizes
