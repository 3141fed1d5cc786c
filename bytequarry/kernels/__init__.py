"""Sequential kernels as functions of a column, run in the JVM beside the scan: no row goes through a Python worker.

Kernel.java is compiled once a session's context by the compiler that Spark itself has, and goes to the executors as a
jar, as --jars would send it. The Python functions in operators/ say what each kernel does; tests hold both together."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import _to_java_column, _to_seq

from ..config import Algorithm
from ..session import spread

NAME = "bytequarry.Kernel"
#: Numbers of each stream in the kernel of symbols.
SYMBOLS = 32


def _compiled(spark: SparkSession):
    """The kernels' class in the driver; its jar is on the way to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_bytequarry_kernel", None) is None:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(Path(__file__).with_name("Kernel.java").read_text())
        target = Path(tempfile.mkdtemp(prefix="bytequarry-")) / "bytequarry-kernels.jar"
        with zipfile.ZipFile(target, "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(str(target))
        sc._bytequarry_kernel = compiler.getClassLoader().loadClass(NAME)
    return sc._bytequarry_kernel


def kernel(spark: SparkSession, what: str, algo: Algorithm | None = None, initial_offset: int = 4) -> Callable[[Column], Column]:
    """A function from a column of bytes to an array of numbers: `what` of Kernel.java, with an algorithm's values."""
    values = () if algo is None else (algo.window, algo.min_offset, algo.min_match, algo.max_match, algo.good_match, algo.max_literal_run, algo.max_chain, initial_offset)
    f = _compiled(spark).newInstance().of(what, ",".join(map(str, values))).function()
    return lambda data: Column(f.apply(_to_seq(spark.sparkContext, [data], _to_java_column)))


def numbers(df: DataFrame, key: str, text: str, what: str, algo: Algorithm | None = None) -> DataFrame:
    """blob_id and `r`, the kernel's numbers of the UTF-8 bytes of each row's text; null counts as empty."""
    run = kernel(df.sparkSession, what, algo)
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return spread(df.select(key, text)).select(F.col(key).cast("bigint").alias("blob_id"), run(data).alias("r"))


def per_blob(df: DataFrame, key: str, text: str, what: str, schema: str, algo: Algorithm | None = None) -> DataFrame:
    """blob_id and the kernel's numbers by name; the schema names them and their types, in their order."""
    named = [part.split() for part in schema.split(", ")]
    found = numbers(df, key, text, what, algo)
    return found.select("blob_id", *(F.col("r")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(named)))
