"""The package on the executors, and paths of tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context, as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_bytequarry", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="bytequarry-")) / "bytequarry.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, os.path.join("bytequarry", p.relative_to(here)))
    sc.addPyFile(str(target))
    sc._bytequarry = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a folder of our own in local mode only:
    the executors of a cluster would each write to a disk of theirs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/bytequarry-{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Rows for work that is heavy on each: a table of fewer partitions than the cluster has cores is dealt anew; a
    larger one stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores)
