"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run of consecutive lines that holds MIN_CHARS characters or more (each line counts one for its end) and whose
content stands at an earlier place (by document id, nulls first, then row, then line) is deleted there.

Every such run is made of minimal windows: the fewest lines from some line onwards, or backwards, that reach
MIN_CHARS. From each window the smallest line hash is its fingerprint, so equal windows have equal fingerprints at
equal places. Fingerprints that only one place in the corpus has are dropped; what joins is extended both ways to
the borders of its windows, compared by a 128-bit hash of the content, and all but the first of equal windows go.
Copies of one window meet only in partial aggregates and in joins with one row per fingerprint or content.

Defined results: null text stays null and has no lines; empty text has one empty line; a text whose lines all go
becomes empty; of equal rows the first (in scan order) keeps its lines; an empty table gives an empty result. Extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import column, join_heavy, materialize, with_row_id

MIN_CHARS = 60


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(rows: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """The minimal windows of all documents: __rid, id, first and last line, fingerprint and its line, content."""
    lines = rows.select("__rid", F.col(doc_id).alias("__id"), F.posexplode(_lines(F.col(text).cast("string"))).alias("ln", "line"))
    lines = lines.select("__rid", "__id", "ln", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), (F.length("line") + 1).cast("bigint").alias("w"))
    each = Window.partitionBy("__rid")
    lines = lines.withColumn("end", F.sum("w").over(each.orderBy("ln"))).withColumn("start", F.col("end") - F.col("w"))
    ahead = each.orderBy("start").rangeBetween(0, min_chars - 1)
    behind = each.orderBy("end").rangeBetween(1 - min_chars, 0)

    def window(frame) -> Column:
        return F.struct(
            F.min("ln").over(frame).alias("first"),
            F.max("ln").over(frame).alias("last"),
            (F.max("end").over(frame) - F.min("start").over(frame)).alias("chars"),
            F.min(F.struct("h", "ln")).over(frame).alias("fp"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("c1"),
            F.xxhash64(F.collect_list("g").over(frame)).alias("c2"),
        )

    found = lines.withColumn("a", window(ahead)).withColumn("b", window(behind)).select("__rid", "__id", F.explode(F.array("a", "b")).alias("x"))
    return found.filter(F.col("x.chars") >= min_chars).select("__rid", "__id", "x.first", "x.last", F.col("x.fp.h").alias("fp"), F.col("x.fp.ln").alias("fp_line"), "x.c1", "x.c2")


def deleted_lines(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """__rid2 and the numbers of the lines that go, of documents that lose some. `rows` have __rid."""
    found = materialize(line_windows(rows, doc_id, text, min_chars), "line-windows")
    place = F.struct("__rid", "fp_line")
    size = F.count(F.lit(1)).alias("size")
    shared = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), size).filter(F.col("a") < F.col("b")).select("fp", "size")
    met = materialize(join_heavy(found, shared, ["fp"], "size", found.count()).drop("fp", "fp_line"), "shared-windows")
    place = F.struct("__id", "__rid", "first")
    firsts = met.groupBy("c1", "c2").agg(F.min(place).alias("kept"), F.max(place).alias("other"), size).filter(F.col("kept") < F.col("other")).drop("other")
    later = join_heavy(met, firsts, ["c1", "c2"], "size", met.count()).filter(place > F.col("kept"))
    gone = later.select("__rid", F.explode(F.sequence("first", "last")).alias("ln"))
    return gone.groupBy(F.col("__rid").alias("__rid2")).agg(F.collect_set("ln").alias("__gone"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", min_chars: int = MIN_CHARS, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines gone and `n_chars` counted again; with `counts` also __n_lines and __n_removed; with
    `drop_emptied` without the documents that have lost lines and have no text left."""
    rows = with_row_id(docs.select(column(doc_id).alias("__id"), column(text).cast("string").alias("__text"), F.struct(*map(column, docs.columns)).alias("__row")))
    joined = rows.join(deleted_lines(rows, "__id", "__text", min_chars), F.col("__rid") == F.col("__rid2"), "left")
    joined = joined.withColumn("__lines", _lines(F.col("__text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    joined = joined.withColumn("__n_lines", F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("bigint"))
    joined = joined.withColumn("__n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint"))
    # __lines also serves __n_lines, so the optimizer does not move the split into the function below
    cut = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    joined = joined.withColumn("__text", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(cut))
    if drop_emptied:
        joined = joined.filter((F.col("__n_removed") == 0) | (F.col("__text") != ""))
    columns = {c: F.col("__row")[c] for c in docs.columns}
    columns[text] = F.col("__text")
    if n_chars in columns:
        columns[n_chars] = F.when(F.col("__gone").isNull(), columns[n_chars]).otherwise(F.length("__text").cast(dict(docs.dtypes)[n_chars]))
    return joined.select(*(v.alias(c) for c, v in columns.items()), *(["__n_lines", "__n_removed"] if counts else []))


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and kept_sha256 (of the remaining text; null text counts as empty)."""
    out = dedup(docs.select("doc_id", "text"), n_chars=None, min_chars=min_chars, counts=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
  FROM documents),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) AS e FROM lines),
spans AS (SELECT *, e - length(line) - 1 AS s FROM placed),
windows AS (
  SELECT doc_id, ln AS f, max(ln) OVER a AS l, max(e) OVER a - s AS chars, list(line) OVER a AS content FROM spans
  WINDOW a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(ln) OVER b, ln, e - min(s) OVER b, list(line) OVER b FROM spans
  WINDOW b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, f) AS r FROM windows WHERE chars >= {MIN_CHARS}),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS ln FROM ranked WHERE r > 1),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(g.ln) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY lines.ln) FILTER (WHERE g.ln IS NULL), '') AS kept
  FROM lines LEFT JOIN gone g USING (doc_id, ln) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  length(coalesce(kept, '')) AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""
