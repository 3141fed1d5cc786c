"""Texts as bytes: one row a byte, digrams, and bounded history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def hex_pairs(text: Column) -> Column:
    return F.regexp_extract_all(F.hex(utf8(text)), F.lit(".."), F.lit(0))


def strings_of(df: DataFrame, key: str, text: str, size: int, name: str) -> DataFrame:
    """(blob_id, pos, name): the `size` bytes from each place as a number. They are cut from the binary, which costs
    the same at any place, so no row needs its neighbours."""
    blobs = df.select(F.col(key).alias("blob_id"), utf8(F.col(text)).alias("data")).filter(F.octet_length("data") >= size)
    rows = blobs.select("blob_id", "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - size)).alias("pos"))
    return rows.select("blob_id", "pos", F.conv(F.hex(F.expr(f"substring(data, pos + 1, {size})")), 16, 10).cast("int").alias(name))


def bytes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(blob_id, pos, b): a row for each byte."""
    return strings_of(df, key, text, 1, "b")


def digrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(blob_id, pos, g): a row for each two neighbouring bytes, as a number."""
    return strings_of(df, key, text, 2, "g")


def chain(digram_rows: DataFrame, max_chain: int, window: int) -> DataFrame:
    """Earlier places with the same digram, most recent first: at most max_chain, at most window - 1 back. A frame of
    the max_chain preceding rows of the same digram is the hash chain; no join is needed."""
    w = Window.partitionBy("blob_id", "g").orderBy("pos").rowsBetween(-max_chain, -1)
    earlier = F.reverse(F.collect_list("pos").over(w))
    offsets = F.filter(F.transform(earlier, lambda p: F.col("pos") - p), lambda o: o <= window - 1)
    return digram_rows.select("blob_id", "pos", "g", offsets.alias("offsets"))


def equal_runs(byte_rows: DataFrame, distance: int) -> DataFrame:
    """(blob_id, start, length) of maximal runs in which each byte equals the one `distance` before (gaps and islands)."""
    w = Window.partitionBy("blob_id").orderBy("pos")
    same = byte_rows.withColumn("e", F.col("b") == F.lag("b", distance).over(w)).filter("e")
    island = same.withColumn("island", F.col("pos") - F.row_number().over(w))
    return island.groupBy("blob_id", "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).drop("island")


#: Fixed values of the control sequences: colour letters (codes from 2), and the letters of codes from 14.
COLOURS, MODES = "KRGYBMCW", "HNZ"


def translate_controls(text: Column) -> Column:
    """Control-A sequences of terminal art: returns go; a byte from 0x80 becomes that many spaces less 127; colour
    letters and modes become codes; background digits go, with their mark."""
    out = F.regexp_replace(text, "\r", "")
    out = F.regexp_replace(out, "\x01[0-7]", "")
    for k, c in enumerate(COLOURS):
        out = F.replace(out, F.lit("\x01" + c), F.lit(chr(2 + k)))
    for k, c in enumerate(MODES):
        out = F.replace(out, F.lit("\x01" + c), F.lit(chr(14 + k)))
    for k in range(1, 41):
        out = F.replace(out, F.lit("\x01" + chr(127 + k)), F.lit(" " * k))
    return out


def stream_header(n: Column, ascii_mode: bool, reverse: bool, initial_offset: int) -> Column:
    """Hex of the header: a byte with two flags and the initial offset, and the size in 24 bits."""
    flags = ascii_mode << 7 | reverse << 6 | initial_offset
    return F.concat(F.lit(f"{flags:02X}"), F.lpad(F.hex(n), 6, "0"))


def hex_array(text: Column) -> Column:
    """The bytes as 0x.. items, eight a line."""
    items = F.regexp_replace(F.lower(F.hex(utf8(text))), "(..)", "0x$1,")
    lines = F.regexp_replace(items, "((?:0x..,){8})", "$1\n")
    return F.regexp_replace(lines, ",\n?$", "")
