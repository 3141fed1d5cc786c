"""The byte statistics over streams of texts: the same expressions, kept up to date as files come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blobs


def incoming(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, at most so many in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def byte_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """b, n over all texts so far; the state has 256 rows at most. Write it in complete or update mode."""
    return blobs.bytes_of(texts, key, text).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def digram_counts(texts: DataFrame, key: str, text: str, time: str, late: str, span: str) -> DataFrame:
    """window, g, n for spans of event time; what comes later than the watermark is left out, and closed windows go."""
    timed = texts.withWatermark(time, late).withColumn("__key", F.struct(F.col(key).alias("key"), F.col(time).alias("time")))
    rows = blobs.digrams(timed, "__key", text)
    return rows.groupBy(F.window("blob_id.time", span).alias("window"), "g").agg(F.count(F.lit(1)).alias("n"))
