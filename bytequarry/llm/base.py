"""What the operators share: reading tables, tables in the shared folder, Arrow text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch, ship, table  # noqa: F401

#: Rows and bytes that Spark hands to a Python worker at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that a kernel works on at once; a longer text is one such part.
PART_BYTES = 2 << 20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory does not depend on the length of the texts; the package
    goes to the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it back: this cuts the lineage, survives lost
    executors, and fixes the order-dependent parts of what was computed. It goes when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is heavy if it has this share of all rows or more; so there are at most HEAVY such keys.
HEAVY = 1000


def join_heavy(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of `many` with `one`, which has a row for each key and, as `size`, at least the number of rows of
    `many` with it; these sizes add up to `total` at most. Rows of heavy keys stay where they are, and what `one`
    has for them (HEAVY rows at most) comes to them; so no task gathers the rows of a heavy key. `many` is read
    three times, so let it come from a table."""
    limit = F.lit(max(1.0, total / HEAVY))
    heavy = F.broadcast(one.filter(F.col(size) >= limit).drop(size))
    rest = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return many.join(heavy, keys).unionByName(rest.join(one.filter(F.col(size) < limit).drop(size), keys))


#: What leaves the rows of a file scan in their order, as Spark's plans name it.
_STEADY = {"LogicalRelation", "LocalRelation", "Project", "Filter", "SubqueryAlias", "DataSourceV2ScanRelation"}


def _steady(plan) -> bool:
    """Does a plan only read files, or rows that the driver gave, and take them as they come?"""
    children = plan.children()
    return plan.getClass().getSimpleName() in _STEADY and all(_steady(children.apply(k)) for k in range(children.size()))


def with_row_id(df: DataFrame, name: str = "__rid") -> DataFrame:
    """Number the rows of a file scan (equal in every evaluation of the plan, as the files are split alike);
    what comes from anything else, where the order of rows may change, is written and read back first."""
    if not _steady(df._jdf.queryExecution().optimizedPlan()):
        df = materialize(df, "rows")
    return df.withColumn(name, F.monotonically_increasing_id())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if column.null_count:  # a null may own bytes in a sliced buffer
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        if lengths.sum() != offs[-1]:
            return text_buffer(column.fill_null(""))
    return buf, offs


def parts(batch: pa.RecordBatch, text: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of text, or one row."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only


def released(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system when a task ends. Worker processes live on,
    and what the tasks of one stage needed would else stay with them while others run."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return whole


def map_text(df: DataFrame, text: str, kernel: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, limit: int = PART_BYTES) -> DataFrame:
    """mapInArrow over parts of bounded size. `kernel` makes the function once a task."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for part in parts(batch, text, limit):
                yield work(part)

    return df.mapInArrow(released(run), schema)


def record(**columns: tuple[object, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], list(columns))
