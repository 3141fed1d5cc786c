"""Parses with literal runs, and streams whose lengths, runs and offsets are coded by tables.

A token is a run of literals (length, no offset), a match (length and offset), or a repeat of the last offset. After a
run comes no other run, so there a tag of one bit tells repeat (0) from match (1), and elsewhere run (0) from match (1);
a repeat that follows a match is written as a match. Where runs are single literals, the tags are 0 for a literal, 10
for a repeat and 11 for a match. Streams have framing of their own, checked by round trips.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BY_NAME, Algorithm
from ..functions.bits import NARROW_OFFSET_CLASSES, OFFSET_CLASSES
from ..kernels import SYMBOLS, numbers, per_blob
from .entropy import added_bits, table_decode, table_encode
from .parse import BitReader, BitWriter, _length_bits, _length_code, _offset_bits, _read_length, common, matches

#: Table size, and the parameter of the code of the frequencies (fixed values).
TABLE, RICE = 32, 2
STREAMS = ("run", "length", "offset")
#: Bits that a symbol of each stream is taken to cost before the tables are known (fixed values).
PREDICTED = {"run": 1, "length": 0, "offset": 0}


@dataclass(frozen=True)
class Step:
    kind: str  # run, match or repeat
    pos: int
    length: int
    offset: int


class TooLongRun(ValueError):
    """No tokens cover the blob: more literals in a row than a run may hold."""


def _top(algo: Algorithm) -> int:
    return algo.max_match.bit_length() - 1


def parse_runs(data: bytes, algo: Algorithm, initial_offset: int = 4) -> list[Step]:
    """The cheapest tokens found. Two states at every position, after a run and after another token, each with the
    last offset of its cheapest way; a run grows by a byte at a time."""
    size, never, top = len(data), 1 << 60, _top(algo)
    classes = NARROW_OFFSET_CLASSES if algo.window <= 32768 else OFFSET_CLASSES
    runs, others = 0, 1
    cost = [[never] * (size + 1), [0] + [never] * size]
    last = [[initial_offset] * (size + 1) for _ in cost]
    came: list[list] = [[None] * (size + 1) for _ in cost]  # the token, and the state before it

    def settle(state, to, total, again, token, before):
        if total < cost[state][to]:
            cost[state][to], last[state][to], came[state][to] = total, again, (token, before)

    for pos, found in enumerate(matches(data, algo)):
        if cost[others][pos] < never:
            settle(runs, pos + 1, cost[others][pos] + 9 + _length_bits(1, top), last[others][pos], Step("run", pos, 1, 0), others)
        if cost[runs][pos] < never:
            token, before = came[runs][pos]
            n = token.length
            if n < algo.max_literal_run:
                more = 8 + _length_bits(n + 1, top) - _length_bits(n, top)
                settle(runs, pos + 1, cost[runs][pos] + more, last[runs][pos], Step("run", token.pos, n + 1, 0), before)
            again = last[runs][pos]
            if pos >= again and (n := common(data, pos - again, pos, min(algo.max_match, size - pos))):
                settle(others, pos + n, cost[runs][pos] + 1 + _length_bits(n, top), again, Step("repeat", pos, n, again), runs)
        for state in (runs, others):
            if cost[state][pos] < never:
                for o, n in found:
                    total = cost[state][pos] + 1 + _offset_bits(o, classes) + _length_bits(n - 1, top)
                    settle(others, pos + n, total, o, Step("match", pos, n, o), state)
    state = min((runs, others), key=lambda s: cost[s][size])
    if cost[state][size] >= never:
        raise TooLongRun(f"more than {algo.max_literal_run} literals in a row")
    out, at = [], size
    while at:
        token, state = came[state][at]
        out.append(token)
        at = token.pos
    return out[::-1]


def encode_runs(data: bytes, algo: Algorithm, initial_offset: int = 4, ascii_mode: bool = False, steps: Sequence[Step] | None = None) -> bytes:
    """A byte with the mode and the initial offset, the size in 24 bits, the tokens. In ASCII mode the last byte of a run
    holds the next token's tag in its lowest bit."""
    steps, w, top = parse_runs(data, algo, initial_offset) if steps is None else steps, BitWriter(), _top(algo)
    classes = NARROW_OFFSET_CLASSES if algo.window <= 32768 else OFFSET_CLASSES
    for k, t in enumerate(steps):
        after = k > 0 and steps[k - 1].kind == "run"
        if not (ascii_mode and after):
            w.bits("1" if t.kind == "match" else "0")
        if t.kind == "run":
            w.bits(_length_code(t.length, top))
            literals = data[t.pos : t.pos + t.length]
            for c in literals[:-1]:
                w.byte(c)
            following = k + 1 < len(steps) and steps[k + 1].kind == "match"
            w.byte(literals[-1] << 1 | following if ascii_mode else literals[-1])
        elif t.kind == "repeat":
            w.bits(_length_code(t.length, top))
        else:
            _, pattern, low = next(x for x in classes if t.offset < x[0])
            w.byte(t.offset >> low)
            if pattern != "0":
                w.bits(pattern[1:] + (format(t.offset & (1 << low) - 1, f"0{low}b") if low else ""))
            w.bits(_length_code(t.length - 1, top))
    return bytes([ascii_mode << 7 | initial_offset]) + len(data).to_bytes(3, "big") + bytes(w.out)


def decode_runs(stream: bytes, algo: Algorithm) -> bytes:
    ascii_mode, again, top = stream[0] >> 7, stream[0] & 63, _top(algo)
    size, r, out = int.from_bytes(stream[1:4], "big"), BitReader(stream, 4), bytearray()
    classes = NARROW_OFFSET_CLASSES if algo.window <= 32768 else OFFSET_CLASSES
    by_pattern = {pattern[1:]: low for _, pattern, low in classes[1:]}
    after, told = False, None
    while len(out) < size:
        tag, told = (r.bit() if told is None else told), None
        if not tag and not after:
            for _ in range(_read_length(r, top)):
                out.append(r.byte())
            if ascii_mode:
                told, out[-1] = out[-1] & 1, out[-1] >> 1
            after = True
            continue
        if tag:
            again = r.byte()
            if again > 127:
                pattern = ""
                while pattern not in by_pattern:
                    pattern += str(r.bit())
                again = again << by_pattern[pattern] | r.number(by_pattern[pattern])
        n = _read_length(r, top) + tag
        for _ in range(n):
            out.append(out[-again])
        after = False
    return bytes(out)


# --- table-coded streams -----------------------------------------------------------------------------------------
def _class(n: int) -> int:
    return n.bit_length() - 1


def steps_of(data: bytes, algo: Algorithm, initial_offset: int = 4) -> list[Step]:
    """Tokens for a table-coded stream; with runs of one literal every token but a literal may follow any."""
    if algo.max_literal_run > 1:
        return parse_runs(data, algo, initial_offset)
    from .parse import parse

    out, again = [], initial_offset
    for t in parse(data, algo, initial_offset):
        kind = {"literal": "run", "match": "match"}.get(t.kind, "repeat")
        again = t.offset if kind == "match" else again
        out.append(Step(kind, t.pos, t.length, 0 if kind == "run" else again))
    return out


def symbols(steps: Sequence[Step], algo: Algorithm) -> dict[str, list[int]]:
    """What each table codes, in the order of the tokens: the classes of runs, of lengths and of offsets. Offsets below
    the algorithm's least class are one symbol."""
    least = _class(algo.min_offset)
    return {
        "run": [_class(t.length) for t in steps if t.kind == "run"] if algo.max_literal_run > 1 else [],
        "length": [_class(t.length) for t in steps if t.kind != "run"],
        "offset": [max(0, _class(t.offset) - least + 1) for t in steps if t.kind == "match"],
    }


def scaled(counts: Sequence[int], m: int = TABLE) -> list[int]:
    """Frequencies that sum to m, none of a used symbol below 1: floors of cumulative shares, ones for what got none,
    and what these take too much from the largest."""
    total, upto, out = sum(counts), 0, []
    for c in counts:
        out.append(max((upto + c) * m // total - upto * m // total, int(c > 0)))
        upto += c
    for _ in range(sum(out) - m):
        out[max(range(len(out)), key=out.__getitem__)] -= 1
    return out


def _rice(n: int) -> str:
    return "1" * (n >> RICE) + "0" + format(n & (1 << RICE) - 1, f"0{RICE}b")


def encode_tabled(data: bytes, algo: Algorithm, initial_offset: int = 4, steps: Sequence[Step] | None = None) -> bytes:
    """Header as of the other streams; for each table its frequencies, state, and bits; then tags, low bits and
    literals of the tokens."""
    steps = steps_of(data, algo, initial_offset) if steps is None else steps
    least, single = _class(algo.min_offset), algo.max_literal_run == 1
    w = BitWriter()
    for stream, found in symbols(steps, algo).items():
        w.bits("1" if found else "0")
        if found:
            counts = [found.count(s) for s in range(max(found) + 1)]
            freqs = scaled(counts)
            state, bits = table_encode(found, freqs)
            w.bits(format(len(freqs), "05b") + "".join(map(_rice, freqs)) + format(state, "05b") + format(len(bits), "024b") + bits)
    low = lambda v, n: w.bits(format(v & (1 << n) - 1, f"0{n}b") if n else "")
    for k, t in enumerate(steps):
        after = not single and k > 0 and steps[k - 1].kind == "run"
        w.bits({"run": "0", "repeat": "10", "match": "11"}[t.kind] if single else "1" if t.kind == "match" else "0")
        if t.kind == "run":
            if not single:
                low(t.length, _class(t.length))
            for c in data[t.pos : t.pos + t.length]:
                w.byte(c)
            continue
        assert single or t.kind == "match" or after
        if t.kind == "match":
            low(t.offset, max(least, _class(t.offset)))
        low(t.length, _class(t.length))
    return bytes([initial_offset]) + len(data).to_bytes(3, "big") + bytes(w.out)


def decode_tabled(stream: bytes, algo: Algorithm) -> bytes:
    again, size, r, out = stream[0] & 63, int.from_bytes(stream[1:4], "big"), BitReader(stream, 4), bytearray()
    least, single = _class(algo.min_offset), algo.max_literal_run == 1
    coded: dict[str, list[int]] = {}
    for name in STREAMS:
        coded[name] = []
        if r.bit():
            freqs = []
            for _ in range(r.number(5)):
                high = 0
                while r.bit():
                    high += 1
                freqs.append(high << RICE | r.number(RICE))
            state, n_bits = r.number(5), r.number(24)
            coded[name] = _symbols_in(state, "".join(str(r.bit()) for _ in range(n_bits)), freqs)
    nexts = {name: iter(found) for name, found in coded.items()}
    sized = lambda name: 1 << (c := next(nexts[name])) | r.number(c)
    after = False
    while len(out) < size:
        tag = r.bit()
        if not tag and not after:
            for _ in range(1 if single else sized("run")):
                out.append(r.byte())
            after = not single
            continue
        if (r.bit() if single else tag):
            c = next(nexts["offset"])
            again = r.number(least) if c == 0 else 1 << c + least - 1 | r.number(c + least - 1)
        for _ in range(sized("length")):
            out.append(out[-again])
        after = False
    return bytes(out)


def _symbols_in(state: int, bits: str, freqs: Sequence[int]) -> list[int]:
    """All symbols of a table-coded stream: every symbol takes at least one bit, and the last leaves none."""
    from .entropy import table_states

    m, left, n = sum(freqs), len(bits), 0
    _, back = table_states(freqs)
    at = state
    while left > 0:
        s, y = back[at]
        k = added_bits(y, m)
        at = (y << k | int(bits[left - k : left], 2)) % m
        left, n = left - k, n + 1
    return table_decode(state, bits, freqs, n)


CODECS = {"wide_runs": (encode_runs, decode_runs), "tabled_runs": (encode_tabled, decode_tabled), "tabled": (encode_tabled, decode_tabled)}


def summaries(df: DataFrame, key: str, text: str, algorithm: str) -> DataFrame:
    """blob_id, n_bytes, numbers of tokens, encoded_bytes, status (ok, expanded, or too long a run of literals) and
    whether decoding gives the blob back. Null counts as empty. Parse and codec run as a kernel in the JVM."""
    names = ["n_bytes", "n_runs", "n_matches", "n_repeats", "run_bytes", "encoded_bytes"]
    found = per_blob(df, key, text, "runs", ", ".join(f"{n} bigint" for n in names) + ", how int, trip boolean", BY_NAME[algorithm])
    status = F.when(F.col("how") == 2, "run too long").when(F.col("how") == 1, "expanded").otherwise("ok")
    return found.select("blob_id", *names, status.alias("status"), F.when(F.col("how") != 2, F.col("trip")).alias("round_trip"))


def _numbered(df: DataFrame, key: str, text: str, algorithm: str) -> DataFrame:
    """blob_id, at, n: the kernel's numbers that are not 0, and their places."""
    return numbers(df, key, text, "symbols", BY_NAME[algorithm]).select("blob_id", F.posexplode("r").alias("at", "n")).filter("n > 0")


def _named(df: DataFrame, *others: str) -> DataFrame:
    """Stream and symbol in place of `at`."""
    stream = F.element_at(F.array(*map(F.lit, STREAMS)), (F.floor(F.col("at") / SYMBOLS) + 1).cast("int"))
    return df.select(stream.alias("stream"), (F.col("at") % SYMBOLS).alias("symbol"), *others)


def symbol_rows(df: DataFrame, key: str, text: str, algorithm: str) -> DataFrame:
    """blob_id, stream, symbol, n: how often each table's symbols occur in a blob's chosen tokens."""
    return _named(_numbered(df, key, text, algorithm), "blob_id", "n").select("blob_id", "stream", "symbol", "n")


def symbol_totals(df: DataFrame, key: str, text: str, algorithm: str) -> DataFrame:
    """stream, symbol, n, n_blobs: how often they occur in all blobs, and in how many. Rows meet by numbers alone; the few
    totals get the streams' names."""
    totals = _numbered(df, key, text, algorithm).groupBy("at").agg(F.sum("n").alias("n"), F.countDistinct("blob_id").alias("n_blobs"))
    return _named(totals, "n", "n_blobs")
