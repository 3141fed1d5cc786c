"""Plain files: text lines, CSV tables with inferred headers, and a raw file for each blob."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


#: Lines of a text file at most, so that a file read whole as a byte array stays small, whatever the table's size.
LINES_A_FILE = 1 << 19


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """Text files of LINES_A_FILE lines at most in the folder `path`; a task with more lines writes several."""
    lines.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", LINES_A_FILE).text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file that was written to the folder: path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", "content")


def line_ends(content: Column) -> Column:
    """How many bytes are line feeds; each byte is read as one character."""
    text = F.decode(content, "ISO-8859-1")
    return F.octet_length(content) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line, as `line`."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose column names stand in the first line; types are inferred by a scan of all rows."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """Each row's `data` as the raw file <blob_id>.bin in the folder `path`, which all executors share. A task that
    runs again writes the same bytes to the same name. Returns blob_id and the size; the files are written when the
    result is read."""
    ship(blobs.sparkSession)

    def run(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            ids, sizes = batch.column("blob_id").to_pylist(), []
            for blob, data in zip(ids, batch.column("data").to_pylist()):
                with system.open_output_stream(f"{folder}/{blob}.bin") as out:
                    out.write(data or b"")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["blob_id", "size"])

    return blobs.select(F.col("blob_id").cast("bigint"), F.col("data").cast("binary")).mapInArrow(run, "blob_id bigint, size bigint")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """blob_id, size and data of the raw files in a folder; Spark passes over files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(F.regexp_extract("path", r"([0-9-]+)\.bin$", 1).cast("bigint").alias("blob_id"), F.col("length").alias("size"), F.col("content").alias("data"))
