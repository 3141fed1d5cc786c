"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each task tokenizes the documents of its partition. From every document whole windows are cut first; the rest, in
pieces of at most PIECE ids, is gathered into groups of about GROUP windows, the last piece cut so that a group
fills its windows but for a small margin. Within a group, partial partitions are merged largest difference first,
the heavy side of one on the light side of the other; if a window then exceeds its capacity, the group gets one
window more and is divided anew. No data moves between tasks, and a group bounds what a task holds.

Defined results: null or empty text is the end id alone; equal rows are packed each on its own; an empty table
gives an empty result. Every id lies in exactly one piece. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import parts, record, released, text_buffer, tune
from .tokens import encoder

WINDOW, GROUP, PIECE, MARGIN = 2048, 64, 512, 0.002


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of `sizes` in k sets of nearly equal sums."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, (i,))] + [(0, ())] * (k - 1)))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: -t[0])
        least = merged[-1][0]
        heapq.heappush(heap, (least - merged[0][0], n, [(s - least, tree) for s, tree in merged]))
        n += 1
    return [_leaves(tree) for _, tree in heap[0][2]] if heap else [[] for _ in range(k)]


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        for x in stack.pop():
            (out.append if isinstance(x, int) else stack.append)(x)
    return sorted(out)


def divide(sizes: list[int], window: int) -> list[list[int]]:
    """The fewest windows from the sum's bound upwards for which differencing exceeds no capacity."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        found = [s for s in differencing(sizes, k) if s]
        if all(sum(sizes[i] for i in s) <= window for s in found):
            return found
        k += 1


def pack(docs: DataFrame, tokenizer: str, drops_space: bool = False, lowers: bool = False, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A sequence's number holds the number of its partition and its own number there."""
    tune(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        coder, sequence = encoder(tokenizer, drops_space, lowers), TaskContext.get().partitionId() << 40
        room = GROUP * window - int(GROUP * window * MARGIN)
        rows: list[tuple] = []  # finished pieces
        owners: list[pa.Array] = []
        group: list[tuple] = []
        held = 0

        def put(piece, at, offset):
            doc, start, length, tokens, ids = piece
            rows.append((doc, start, length, zlib.crc32(ids.tobytes()), tokens, at, offset, ids))

        def close():
            nonlocal sequence, group, held
            for members in divide([p[2] for p in group], window):
                offset = 0
                for i in members:
                    put(group[i], sequence, offset)
                    offset += group[i][2]
                sequence += 1
            group, held = [], 0

        def out():
            doc, start, length, crc, tokens, at, offset, ids = zip(*rows)
            named = {"doc_id": (pa.concat_arrays(doc), None)}
            named |= {n: (v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", tokens), ("sequence_id", at), ("offset", offset))}
            if with_ids:
                named["ids"] = (list(ids), pa.list_(pa.int32()))
            rows.clear()
            return record(**named)

        for batch in batches:
            for part in parts(batch, "__text"):
                ids, offs = coder.encode(*text_buffer(part.column("__text")))
                owner = part.column("__id")
                for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    doc, n, start = owner.slice(r, 1), b - a, 0
                    while n - start >= window:
                        put((doc, start, window, n, ids[a + start : a + start + window]), sequence, 0)
                        sequence += 1
                        start += window
                    while start < n:
                        length = min(PIECE, n - start, room - held)
                        group.append((doc, start, length, n, ids[a + start : a + start + length].copy()))
                        held += length
                        start += length
                        if held == room:
                            close()
                if len(rows) >= 2000:
                    yield out()
        if group:
            close()
        if rows:
            yield out()

    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    return chosen.mapInArrow(released(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
