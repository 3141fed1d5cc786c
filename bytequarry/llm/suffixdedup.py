"""Removal of long repeated byte strings by distributed difference-cover suffix sorting.

Every byte that a LENGTH-byte string covers which also starts elsewhere (in any document, the same included) goes.

1. Anchors. Of each window of LENGTH bytes the smallest hash of its K-byte strings is the anchor; equal windows have
   equal anchors at equal places. An anchor that occurs once owns only unique windows, and is dropped.
2. Contexts. The bytes of the windows that a repeated anchor owns are its context. All windows of a context that
   occurs twice (known by its hash) are repeated; one of each of an anchor's different contexts goes on.
3. Sorting. Each task sorts the suffixes of its distinct contexts by the difference cover modulo 3: triples at the
   sampled places are sorted and named, the names are sorted in the same way until a name stands for LENGTH bytes or
   is unique, and the remaining suffixes are merged in. Adjacent owned suffixes whose first LENGTH bytes are equal
   are repeated windows.
4. Removal. The covered ranges go back to their documents.

An anchor with more than DEALT different contexts is too much for a task. Its windows are divided by their place
against the anchor, in halves: windows of one half share bytes of the context beyond the anchor, whose hash is part of
the new key, so equal windows stay together. What is still too much is halved again; at the latest a half is one
window, and all of its contexts are equal. Steps 2 to 4 go on as before.

Defined results: null and empty text have no bytes; equal rows remove each other's strings; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import join_heavy, map_text, materialize, record, released, text_buffer, tune, with_row_id
from .words import range_hash, window_hash

LENGTH, K = 200, 48
#: Different contexts of one anchor that a task sorts.
DEALT = 2000
#: Bytes of distinct contexts that a task sorts at once, beyond one anchor's.
CHUNK = 1 << 18


# --- anchors -----------------------------------------------------------------------------------------------------
def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: row, hash, first and last window that each owns, its place (from the row's start)."""
    none = (np.zeros(0, np.int64),) * 5
    if len(buf) < LENGTH:
        return none
    hashes = window_hash(buf, K)
    at = np.arange(len(hashes))
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    keyed = (hashes >> bits << bits) | at.astype(np.uint64)
    place = (sliding_min(keyed, LENGTH - K + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ok = np.zeros(len(place), bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    window = np.flatnonzero(ok)
    if not len(window):
        return none
    owner = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    row = np.searchsorted(offs, window[first], "right") - 1
    return row, hashes[owner[first]], window[first] - offs[row], window[last] - offs[row], owner[first] - offs[row]


# --- suffix sorting ----------------------------------------------------------------------------------------------
def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names from 1 in the order of the keys, and how many there are."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) if len(keys) else 0


def _triples(s: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Names of the triples at the places `at` of s, whose symbols are at most `top`; s is padded with zeros."""
    a, b, c = s[at], s[at + 1], s[at + 2]
    if top < 1 << 8:  # few possible triples: counted, not compared
        keys = (a * (top + 1) + b) * (top + 1) + c
        used = np.zeros((top + 1) ** 3, bool)
        used[keys] = True
        names = np.cumsum(used)
        return names[keys], int(names[-1])
    if top < 1 << 21:
        return _names((a << 42) | (b << 21) | c)
    pairs, _ = _names((a << 32) | b)
    return _names((pairs << 32) | c)


def suffix_ranks(s: np.ndarray, covered: int, needed: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Ranks of all suffixes of s, or of the wanted ones, by their first `needed` bytes at least; a symbol of s
    stands for `covered` bytes. Suffixes whose first `needed` bytes are equal have equal or neighbouring ranks, and
    no other rank lies between theirs: what tells two suffixes apart within that length is seen by every comparison
    below. Symbols are above 0, which follows s."""
    n = len(s)
    if n < 4:
        ranks = np.zeros(n, np.int64)
        for r, i in enumerate(sorted(range(n), key=lambda i: s[i:].tolist())):
            ranks[i] = r
        return ranks
    padded = np.concatenate([s, np.zeros(3, np.int64)])
    # where n is 1 modulo 3, a triple of padding ends the first half
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sampled, top = np.concatenate([one, two]), int(s.max())
    names, many = _triples(padded, sampled, top)
    rank = np.zeros(n + 3, np.int64)
    if many == len(names) or 3 * covered >= needed:
        rank[sampled] = names
    else:
        rank[sampled] = suffix_ranks(names, 3 * covered, needed) + 1
    rank[n:] = 0
    one = one[one < n]
    if wanted is not None:
        zero, one, two = zero[wanted[zero]], one[wanted[one]], two[wanted[two]]
    high = int(rank.max()) + 1
    # two ways to compare: a symbol and the rank after it, or two symbols and the rank after them
    pair = lambda at: padded[at] * high + rank[at + 1]
    if (top + 1) ** 2 * high < 1 << 62:
        wide = lambda at: (padded[at] * (top + 1) + padded[at + 1]) * high + rank[at + 2]
        wide0, wide2 = wide(zero), wide(two)
    else:
        both, _ = _names(np.concatenate([(padded[x] << 31) | padded[x + 1] for x in (zero, two)]))
        wide0, wide2 = both[: len(zero)] * high + rank[zero + 2], both[len(zero) :] * high + rank[two + 2]
    key0 = pair(zero)
    order = np.argsort(key0)
    zero, key0, wide0 = zero[order], key0[order], wide0[order]
    # the sampled ones in the order of their ranks
    mixed = np.concatenate([one, two])
    order = np.argsort(rank[mixed], kind="stable")
    mixed = mixed[order]
    is_one = order < len(one)
    first, second = np.flatnonzero(is_one), np.flatnonzero(~is_one)
    one, wide2 = mixed[first], wide2[order[second] - len(one)]
    two, key1 = mixed[second], pair(one)
    out = np.zeros(n, np.int64)
    out[zero] = np.arange(len(zero)) + np.searchsorted(key1, key0, "left") + np.searchsorted(wide2, wide0, "left")
    out[one] = first + np.searchsorted(key0, key1, "right")
    out[two] = second + np.searchsorted(wide0, wide2, "right")
    return out


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each of the distinct contexts (windows of LENGTH bytes at every place), flags of the windows that
    also stand in another context or twice in this one."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    # the last LENGTH - 1 bytes of a context begin no window of it
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, np.maximum(starts[1:] - LENGTH + 1, starts[:-1]), 1)
    np.add.at(edge, starts[1:], -1)
    owned = np.cumsum(edge)[:-1] == 0
    used = np.bincount(buf, minlength=256) > 0
    ranks = suffix_ranks(np.cumsum(used)[buf], 1, LENGTH, owned)
    place = np.flatnonzero(owned)
    place = place[np.argsort(ranks[place])]
    full = window_hash(buf, LENGTH)[place] if len(place) else np.zeros(0, np.uint64)
    same = np.zeros(len(place) + 1, bool)
    same[1:-1] = full[1:] == full[:-1]
    flags = np.zeros(len(buf), bool)
    flags[place] = same[1:] | same[:-1]
    return [flags[a : max(a, b - LENGTH + 1)] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that the flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(at, cut)]


# --- plan --------------------------------------------------------------------------------------------------------
def _anchor_rows(rows: DataFrame) -> DataFrame:
    """rid, anchor h, hash c of its context, first and last window, the anchor's place after the first."""

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offs = text_buffer(part.column("__text"))
            row, h, lo, hi, at = anchors(buf, offs)
            c = range_hash(buf, offs[row] + lo, offs[row] + hi + LENGTH) if len(row) else np.zeros(0, np.uint64)
            return record(rid=(part.column("__rid").take(pa.array(row)), None), h=(h.astype(np.uint64).view(np.int64), pa.int64()), c=(c.view(np.int64), pa.int64()), lo=(lo, pa.int32()), hi=(hi, pa.int32()), at=(at - lo, pa.int32()))

        return work

    return map_text(rows.select("__rid", "__text"), "__text", kernel, "rid bigint, h bigint, c bigint, lo int, hi int, at int")


def _contexts(met: DataFrame) -> DataFrame:
    """Of documents with their anchors (`owned`): the contexts that must be sorted."""

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offs = text_buffer(part.column("__text"))
            owned = part.column("owned")
            flat = owned.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(owned.offsets.to_numpy()))
            use = flat.field("sort").to_numpy(zero_copy_only=False)
            row, flat = row[use], flat.filter(pa.array(use))
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            raw = buf.tobytes()
            contexts = pa.array([raw[x:y] for x, y in zip((offs[row] + lo).tolist(), (offs[row] + hi + LENGTH).tolist())], pa.binary())
            return record(rid=(part.column("__rid").take(pa.array(row)), None), lo=(lo, pa.int32()), **{c: (flat.field(c), None) for c in ("h", "at", "whole", "kinds")}, context=(contexts, None))

        return work

    return map_text(met, "__text", kernel, "rid bigint, lo int, h bigint, at int, whole boolean, kinds bigint, context binary")


def _halves(batches):
    """Each context's windows in the two halves of the places `first` to `last` against the anchor."""
    for batch in batches:
        out = {c: [] for c in ("rid", "lo", "h", "c", "at", "whole", "first", "last", "context")}
        for rid, lo, h, at, whole, first, last, context in zip(*(batch.column(x).to_pylist() for x in ("rid", "lo", "h", "at", "whole", "first", "last", "context"))):
            middle = (first + last) // 2
            for a, b in ((first, middle), (middle + 1, last)):
                x, y = max(0, at + a), min(len(context) - LENGTH, at + b)  # of the context's own windows
                if a > b or x > y:
                    continue
                shared = context[at + b : at + a + LENGTH]  # what each window from a to b holds
                digest = hashlib.blake2b(shared, digest_size=8, key=f"{h}:{a}".encode()).digest()
                own = context[x : y + LENGTH]
                values = (rid, lo + x, int.from_bytes(digest, "little", signed=True), int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True), at - x, whole, a, b, own)
                for c, v in zip(out, values):
                    out[c].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        yield record(**{c: (v, k) for (c, v), k in zip(out.items(), kinds)})


def _compared(found: DataFrame) -> DataFrame:
    """Of (h, c, rid, lo, ...): whole, where several have this context, kinds, the number of the anchor's different
    contexts, and sort, at one row of each. Only what is one of these is left. `found` comes from a table."""
    kinds = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "lo")).alias("head"))
    kinds = materialize(kinds, "kinds")
    many = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("kinds"))
    kinds = join_heavy(kinds, many, ["h"], "size", kinds.count()).filter("copies > 1 or kinds > 1").withColumn("size", F.col("copies"))
    out = join_heavy(found, materialize(kinds, "kinds"), ["h", "c"], "size", found.count())
    out = out.withColumn("copied", F.col("copies") > 1).withColumn("sort", (F.col("kinds") > 1) & (F.struct("rid", "lo") == F.col("head")))
    return out.filter("copied or sort").drop("copies", "head")


def _dealt(contexts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of anchors that a task can sort, and the ranges (rid, first, end) that were found on the way."""
    heavy = contexts.filter(F.col("kinds") > DEALT)
    if heavy.isEmpty():
        return contexts, None
    ready, found = [contexts.filter(F.col("kinds") <= DEALT)], []
    heavy = heavy.withColumn("first", F.lit(K - LENGTH)).withColumn("last", F.lit(0))
    columns = ["rid", "lo", "h", "at", "whole", "first", "last", "context"]
    while not heavy.isEmpty():
        halves = heavy.select(*columns).mapInArrow(released(_halves), "rid bigint, lo int, h bigint, c bigint, at int, whole boolean, first int, last int, context binary")
        known = materialize(_compared(materialize(halves, "halves")), "compared")
        found.append(known.filter("copied and not whole").select("rid", F.col("lo").alias("first"), (F.col("lo") + F.length("context")).alias("end")))
        known = known.filter("sort").withColumn("whole", F.col("whole") | F.col("copied"))
        ready.append(known.filter(F.col("kinds") <= DEALT).select(*contexts.columns))
        heavy = known.filter(F.col("kinds") > DEALT)
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return union(ready), union(found)


def _sorted(batches):
    """Ranges of repeated windows in contexts that occur once; rows come by anchor."""
    contexts, users, size, last = [], [], 0, None

    def out():
        rid, first, end = [], [], []
        for (r, lo, whole), flags in zip(users, repeated_windows(contexts)):
            for a, b in [] if whole else ranges(flags):
                rid.append(r)
                first.append(lo + a)
                end.append(lo + b)
        return record(rid=(rid, pa.int64()), first=(first, pa.int32()), end=(end, pa.int32()))

    for batch in batches:
        for r, h, lo, whole, c in zip(*(batch.column(x).to_pylist() for x in ("rid", "h", "lo", "whole", "context"))):
            if h != last and size >= CHUNK:
                yield out()
                contexts, users, size = [], [], 0
            last = h
            contexts.append(c)
            users.append((r, lo, whole))
            size += len(c)
    if users:
        yield out()


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """The rows (__rid, __id, __text) with __gone: the byte ranges (first, end) of repeated strings, or null."""
    tune(rows.sparkSession)
    found = materialize(_anchor_rows(rows), "anchors")
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialize(join_heavy(found, shared, ["h"], "size", found.count()), "shared-anchors")
    met = _compared(met).select("rid", F.struct(F.when(F.col("sort"), F.col("h")).alias("h"), "lo", "hi", "at", F.col("copied").alias("whole"), "sort", "kinds").alias("o"))
    joined = rows.join(met.groupBy("rid").agg(F.collect_list("o").alias("owned")), F.col("__rid") == F.col("rid"), "left").drop("rid")
    # the same columns as in the result, so that the texts are shuffled once
    some = joined.filter("owned is not null").select("__rid", "__id", "__text", "owned")
    contexts, halved = _dealt(materialize(_contexts(some), "contexts"))
    partial = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(released(_sorted), "rid bigint, first int, end int")
    if halved is not None:
        partial = partial.union(halved)
    partial = partial.groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("parts"))
    whole = F.transform(F.filter("owned", lambda o: o["whole"]), lambda o: F.struct(o["lo"].alias("first"), (o["hi"] + LENGTH).alias("end")))
    none = F.array().cast("array<struct<first:int,end:int>>")
    return joined.join(partial, F.col("__rid") == F.col("rid"), "left").select("__rid", "__id", "__text", F.concat(F.coalesce(whole, none), F.coalesce("parts", none)).alias("__gone"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cleaned: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with `cleaned`, the remaining text
    (characters that a border cuts are left out)."""
    rows = with_row_id(docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")))
    joined = repeated_ranges(rows).select("__id", "__text", "__gone")

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offs = text_buffer(part.column("__text"))
            raw = buf.tobytes()
            out = {k: [] for k in ("removed", "spans", "sha", "text")}
            for r, gone in enumerate(part.column("__gone").to_pylist()):
                a, b = int(offs[r]), int(offs[r + 1])
                kept, done, spans, removed = [], 0, 0, 0
                for first, end in sorted((g["first"], g["end"]) for g in gone or ()):
                    if first > done or not spans:
                        kept.append(raw[a + done : a + first])
                        spans += 1
                        removed += end - first
                        done = end
                    elif end > done:
                        removed += end - done
                        done = end
                kept = b"".join([*kept, raw[a + done : b]])
                out["removed"].append(removed)
                out["spans"].append(spans)
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                if cleaned:
                    out["text"].append(kept.decode("utf-8", "ignore"))
            named = {"doc_id": (part.column("__id"), None), "n_bytes": (np.diff(offs), pa.int64()), "n_removed": (out["removed"], pa.int64()), "n_spans": (out["spans"], pa.int64()), "kept_sha256": (out["sha"], pa.string())}
            if cleaned:
                named["cleaned"] = (out["text"], pa.string())
            return record(**named)

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_text(joined, "__text", kernel, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", cleaned string" * cleaned)
