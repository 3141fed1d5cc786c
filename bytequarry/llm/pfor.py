"""Patched frame-of-reference blocks for token ids, and a corpus of them in document order.

An image holds a header, the block table (minimum, width, number of exceptions, start of each block) and the blocks.
A block keeps 128 ids: each less the block's minimum, in as many bits as the value at a percentile needs; larger
ones are zero there and stand in the block's exception list (position, value). Any block can be read alone.

A written corpus is a Parquet folder of segments in ascending order of the id (nulls first, ties by text), so that
Spark's committer takes care of lost executors and any store will do; a row holds one image, the documents in it,
and how many ids of its partition come before. Defined results: null or empty text is the end id alone; equal rows
are kept; an empty table gives an empty corpus. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import parts, record, released, scratch, text_buffer, tune
from .tokens import encoder

BLOCK, PERCENTILE = 128, 90
#: Ids after which a segment ends, at the end of a document.
SEGMENT_IDS = 1 << 19
_HEAD = struct.Struct("<4sHHQI")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values in `width` bits each, least significant bit first."""
    if width == 16:
        return values.astype("<u2").view(np.uint8).reshape(len(values), -1)
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    if width == 16:
        return np.ascontiguousarray(packed).view("<u2").astype(np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def encode(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    nb = -(-n // BLOCK)
    head = _HEAD.pack(b"BQPF", 1, BLOCK, n, nb)
    if not n:
        return head
    full = np.concatenate([ids, np.full(nb * BLOCK - n, ids[-1], np.uint32)]).astype(np.uint32).reshape(nb, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    chosen = np.partition(rest, at, axis=1)[:, at]
    width = np.zeros(nb, np.uint8)
    for w in range(32):
        width[chosen >> np.uint32(w) > 0] = w + 1
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    n_over = over.sum(axis=1)
    sizes = BLOCK // 8 * width.astype(np.int64) + 5 * n_over
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.zeros(int(sizes.sum()), np.uint8)
    slots = np.where(over, 0, rest).astype(np.uint32)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            data[starts[rows][:, None] + np.arange(BLOCK // 8 * w)] = _pack(slots[rows], w)
    block, place = np.nonzero(over)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.concatenate([[0], np.cumsum(n_over)[:-1]]), n_over)
        begin = starts[block] + BLOCK // 8 * width[block].astype(np.int64)
        data[begin + rank] = place
        data[(begin + n_over[block] + 4 * rank)[:, None] + np.arange(4)] = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join([head, low.astype("<u4").tobytes(), width.tobytes(), n_over.astype("<u2").tobytes(), starts.astype("<u8").tobytes(), data.tobytes()])


class Image:
    """An encoded image; block(k) reads one block, ids() all of them."""

    def __init__(self, raw: bytes):
        magic, version, block, self.n, nb = _HEAD.unpack_from(raw)
        if magic != b"BQPF" or version != 1 or block != BLOCK:
            raise ValueError("not an image of this format")
        at = _HEAD.size
        take = lambda kind, at: np.frombuffer(raw, kind, nb, at)
        self.low, self.width = take("<u4", at), take(np.uint8, at + 4 * nb)
        self.n_over, self.starts = take("<u2", at + 5 * nb).astype(np.int64), take("<u8", at + 7 * nb).astype(np.int64)
        self.data = np.frombuffer(raw, np.uint8, offset=at + 15 * nb)

    def _blocks(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BLOCK), np.uint32)
        for w in np.unique(self.width[which]).tolist():
            if w:
                rows = np.flatnonzero(self.width[which] == w)
                out[rows] = _unpack(self.data[self.starts[which[rows]][:, None] + np.arange(BLOCK // 8 * w)], w)
        n_over = self.n_over[which]
        if n_over.any():
            row = np.repeat(np.arange(len(which)), n_over)
            rank = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n_over)[:-1]]), n_over)
            begin = (self.starts + BLOCK // 8 * self.width.astype(np.int64))[which[row]]
            place = self.data[begin + rank]
            values = np.ascontiguousarray(self.data[(begin + n_over[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
            out[row, place] = values
        return out + self.low[which][:, None]

    def block(self, k: int) -> np.ndarray:
        return self._blocks(np.array([k]))[0][: self.n - k * BLOCK]

    def ids(self) -> np.ndarray:
        return self._blocks(np.arange(len(self.low))).ravel()[: self.n]


def write(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, lowers: bool = False, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all documents into the folder `path`."""
    tune(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        coder, part = encoder(tokenizer, drops_space, lowers), TaskContext.get().partitionId()
        seq = before = 0
        held, owners, sizes = [], [], []

        def flush():
            nonlocal seq, before
            ids = np.concatenate(held)
            out = record(part=([part], pa.int32()), seq=([seq], pa.int32()), before=([before], pa.int64()), n_ids=([len(ids)], pa.int64()), doc_ids=(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(owners)), None), sizes=([sizes[:]], pa.list_(pa.int64())), image=([encode(ids)], pa.binary()))
            seq, before = seq + 1, before + len(ids)
            for x in (held, owners, sizes):
                x.clear()
            return out

        for batch in batches:
            for piece in parts(batch, "__text"):
                ids, offs = coder.encode(*text_buffer(piece.column("__text")))
                held.append(ids)
                owners.append(piece.column("__id"))
                sizes.extend(np.diff(offs).tolist())
                if sum(map(len, held)) >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).repartitionByRange(F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first(), F.col("__text").asc_nulls_first())
    ordered.mapInArrow(released(run), f"part int, seq int, before bigint, n_ids bigint, doc_ids array<{kind}>, sizes array<bigint>, image binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    tune(spark)
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for s in range(batch.num_rows):
                one = batch.slice(s, 1)
                ids = Image(one.column("image")[0].as_py()).ids()
                offs = np.concatenate([[0], np.cumsum(one.column("sizes").flatten().to_numpy())])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield record(part=(np.full(len(crc), one.column("part")[0].as_py()), pa.int32()), doc_id=(one.column("doc_ids").flatten(), None), local=(offs[:-1] + one.column("before")[0].as_py(), pa.int64()), n_tokens=(np.diff(offs), pa.int64()), ids_crc32=(crc, pa.int64()))

    docs = segments.mapInArrow(released(run), f"part int, doc_id {kind}, local bigint, n_tokens bigint, ids_crc32 bigint")
    # a row for each partition of the writer, not for each document
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    totals = totals.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return docs.join(totals, F.col("part") == F.col("__part")).select("doc_id", (F.col("local") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, drops_space: bool, lowers: bool = False, **names) -> DataFrame:
    """Write docs into the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch(spark, "ids")
    write(docs, path, tokenizer, drops_space, lowers, **names)
    return read(spark, path)
