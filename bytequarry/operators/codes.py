"""Frequency tables, scaled frequencies, and the tables of table-driven entropy codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import least_shift


def cumulative(counts: DataFrame, keys: list[str], symbol: str, count: str) -> DataFrame:
    """Adds lo and hi, the half-open range of each symbol in its table."""
    w = Window.partitionBy(*keys).orderBy(symbol)
    upto = F.sum(count).over(w)
    return counts.withColumns({"lo": upto - F.col(count), "hi": upto})


#: Buckets whose sums are carried together.
CARRIED = 1 << 10


def before(sums: DataFrame, keys: list[str], bucket: str, n: str) -> DataFrame:
    """(keys, bucket, before): for each bucket the sum of n over the lower buckets of its key. In two levels, so that
    no task has a key's buckets all together: within groups of CARRIED buckets, and over the groups' sums."""
    grouped = sums.withColumn("__group", F.floor(F.col(bucket) / CARRIED))
    inner = F.sum(n).over(Window.partitionBy(*keys, "__group").orderBy(bucket)) - F.col(n)
    over = Window.partitionBy(*keys).orderBy("__group")
    carried = grouped.groupBy(*keys, "__group").agg(F.sum(n).alias("__n"))
    carried = carried.withColumn("__before", F.sum("__n").over(over) - F.col("__n")).drop("__n")
    return grouped.withColumn("__inner", inner).join(carried, [*keys, "__group"]).select(*keys, bucket, (F.col("__inner") + F.col("__before")).alias("before"))


def scaled(counts: DataFrame, keys: list[str], symbol: str, count: str, m: int) -> DataFrame:
    """Adds `scaled`: frequencies that sum to m, none of a used symbol below 1.

    The carried remainder of a sequential scaling is a difference of floors of cumulative sums. Symbols that would get
    0 get 1; what this adds is taken from the largest symbols (the later at ties), level by level: x units are taken
    by capping all frequencies at the height where the sum fits."""
    c = cumulative(counts.filter(F.col(count) > 0), keys, symbol, count)
    total = F.sum(count).over(Window.partitionBy(*keys))
    c = c.withColumn("__raw", F.floor(m * F.col("hi") / total) - F.floor(m * F.col("lo") / total))
    c = c.withColumn("__one", F.greatest(F.col("__raw"), F.lit(1)))
    # the cap: the largest height at which the capped sum is at most m
    heights = F.sequence(F.lit(1), F.lit(m))
    per = c.groupBy(*keys).agg(F.collect_list("__one").alias("__all"))
    over = F.filter(heights, lambda h: F.aggregate("__all", F.lit(0).cast("bigint"), lambda a, x: a + F.least(x, h.cast("bigint"))) <= m)
    per = per.select(*(F.col(k).alias(f"__{k}") for k in keys), F.array_max(over).alias("__cap"))
    on = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = e if on is None else on & e
    c = c.join(per, on).withColumn("__low", F.least("__one", "__cap"))
    # units left go back to the cut symbols, the earliest first
    w = Window.partitionBy(*keys)
    c = c.withColumn("__left", F.lit(m) - F.sum("__low").over(w)).withColumn("__cut", (F.col("__one") > F.col("__cap")).cast("int"))
    c = c.withColumn("__nth", F.sum("__cut").over(w.orderBy(symbol)))
    c = c.withColumn("scaled", (F.col("__low") + F.when((F.col("__cut") == 1) & (F.col("__nth") <= F.col("__left")), 1).otherwise(0)).cast("int"))
    return c.select(*counts.columns, "scaled")


def spread(m: int):
    """Slot of the j-th state: start 3, step 5, modulo m (fixed values)."""
    return lambda j: (3 + 5 * j) % m


def encoding_table(freqs: DataFrame, keys: list[str], symbol: str, m: int) -> DataFrame:
    """(keys, symbol, state, next, k): for each symbol and state, the bits to shift out and the state to go to."""
    w = Window.partitionBy(*keys).orderBy(symbol)
    f = freqs.filter("scaled > 0").withColumn("__first", F.sum("scaled").over(w) - F.col("scaled"))
    p = f.select(*keys, symbol, "__first", "scaled", F.explode(F.sequence(F.col("scaled"), 2 * F.col("scaled") - 1)).alias("__p"))
    k = least_shift(F.col("__p"), m)
    p = p.withColumn("k", k).withColumn("next", spread(m)(F.col("__first") + F.col("__p") - F.col("scaled")).cast("int"))
    step = F.expr("sequence(shiftleft(__p, k), shiftleft(__p, k) + shiftleft(1, k) - 1)")
    return p.select(*keys, symbol, F.explode(step).alias("__y"), "next", "k").select(*keys, symbol, (F.col("__y") % m).cast("int").alias("state"), "next", "k")


def decoding_table(freqs: DataFrame, keys: list[str], symbol: str, m: int) -> DataFrame:
    """(keys, state, symbol, y): the symbol of each state and the number that it decodes to."""
    w = Window.partitionBy(*keys).orderBy(symbol)
    f = freqs.filter("scaled > 0").withColumn("__first", F.sum("scaled").over(w) - F.col("scaled"))
    p = f.select(*keys, symbol, "__first", "scaled", F.explode(F.sequence(F.col("scaled"), 2 * F.col("scaled") - 1)).alias("y"))
    return p.select(*keys, spread(m)(F.col("__first") + F.col("y") - F.col("scaled")).cast("int").alias("state"), symbol, F.col("y").cast("int").alias("y"))


def bucket_codes(counts: DataFrame, keys: list[str], idx: str, count: str) -> DataFrame:
    """Prefix-code lengths of 16 buckets: by falling count (ties by index) pairs get 3 to 8 bits, the last four 9; and
    the place of each code, which inside a pair follows the index."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(count).desc(), F.col(idx))) - 1
    sized = counts.withColumn("rank", rank.cast("int")).withColumn("bits", F.when(F.col("rank") < 12, 3 + F.floor(F.col("rank") / 2)).otherwise(9).cast("int"))
    return sized.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy("bits", idx)) - 1).cast("int"))
