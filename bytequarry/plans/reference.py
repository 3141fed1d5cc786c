"""Queries for the operator inventory, over whole tables, with the SQL that checks each.

Keys name the inventory's entries. What the inventory states on single blobs runs on every text of `documents`: byte
rows where it is relational, kernels, blobs in parallel, where it is sequential (parses, coders, list transforms). Integer
sequences come from the star-schema tables. The relational move to front and hex arrays run on `benchmark`, where SQL
can follow them; the same transforms run on `documents` as kernels."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import kernels
from ..config import ALGORITHMS, TARGETS, options
from ..functions import bits, blobs
from ..operators import codes, entropy, forward, parse, runs
from ..session import scratch, table
from ..sources import containers, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

HEXES = "regexp_extract_all(hex(encode(text)), '..')"
BYTES = f"""bytes AS (SELECT doc_id AS blob_id, unnest({HEXES}) AS h, generate_subscripts({HEXES}, 1) - 1 AS pos FROM documents),
b AS (SELECT blob_id, pos, ('0x' || h)::INT AS b FROM bytes)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.bytes_of(docs(spark, sf_dir), "doc_id", "text")


def case_sql(column: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} < {k} THEN {v}" for k, v in pairs) + f" ELSE {default} END"


# --- configuration, sources, predicates --------------------------------------------------------------------------
def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.max_bytes, list(t.algorithms), t.default) for t in TARGETS], "target string, max_bytes bigint, algorithms array<int>, default_id int")


def _algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.id, a.name, a.window, a.min_offset, a.max_match, a.max_literal_run) for a in ALGORITHMS], "id int, name string, win int, min_offset int, max_match int, max_literal_run int")


_TARGET_SQL = "(VALUES " + ", ".join(f"('{t.name}', {t.max_bytes}, {list(t.algorithms)}, {t.default})" for t in TARGETS) + ") t(target, max_bytes, algorithms, default_id)"
_ALGORITHM_SQL = "(VALUES " + ", ".join(f"({a.id}, '{a.name}', {a.window}, {a.max_match})" for a in ALGORITHMS) + ") a(id, name, win, max_match)"


@query(f"SELECT target, name, win, max_match, id = default_id AS is_default FROM {_TARGET_SQL}, {_ALGORITHM_SQL} WHERE list_contains(algorithms, id)")
def q_k15_list_algorithms(spark, sf_dir):
    t, a = _targets(spark), _algorithms(spark)
    joined = t.select("target", "default_id", F.explode("algorithms").alias("id")).join(F.broadcast(a), "id")  # five rows
    return joined.select("target", "name", "win", "max_match", (F.col("id") == F.col("default_id")).alias("is_default"))


@query(f"SELECT id, name FROM {_ALGORITHM_SQL} WHERE id IN (SELECT unnest(algorithms) FROM {_TARGET_SQL} WHERE target = 'ami')")
def q_j10_supported_semijoin(spark, sf_dir):
    supported = _targets(spark).filter("target = 'ami'").select(F.explode("algorithms").alias("id"))
    return _algorithms(spark).join(supported, "id", "left_semi").select("id", "name")


def _chosen(target: str, algorithm: str | None) -> tuple:
    try:
        o = options(target, algorithm, max_chain=20000, good_match=1)
    except ValueError:
        return target, algorithm, None, None, None
    return target, algorithm, o.algorithm.name, o.max_chain, o.good_match


@query(f"""WITH asked AS (SELECT name AS algorithm FROM {_ALGORITHM_SQL} UNION ALL SELECT NULL),
a AS (SELECT id, name FROM {_ALGORITHM_SQL})
SELECT target, algorithm, a.name AS chosen, CASE WHEN a.name IS NOT NULL THEN 9999 END AS max_chain, CASE WHEN a.name IS NOT NULL THEN 2 END AS good_match
FROM {_TARGET_SQL} CROSS JOIN asked LEFT JOIN a ON list_contains(algorithms, a.id) AND CASE WHEN algorithm IS NULL THEN a.id = default_id ELSE a.name = algorithm END""")
def q_s10_k8_k9_options(spark, sf_dir):
    """What each target makes of options that name an algorithm or none, with numbers out of range; null where it
    refuses. No table is read: there are 30 combinations."""
    asked = [_chosen(t.name, a) for t in TARGETS for a in (None, *(a.name for a in ALGORITHMS))]
    return spark.createDataFrame(asked, "target string, algorithm string, chosen string, max_chain int, good_match int")


@query("SELECT * FROM (VALUES ('run', 1), ('length', 0), ('offset', 0)) p(stream, bits)")
def q_t34_predicted_costs(spark, sf_dir):
    """Bits that the symbols of the table-coded streams are taken to cost (fixed values)."""
    return spark.createDataFrame(list(runs.PREDICTED.items()), "stream string, bits int")


@query(f"SELECT target, count(*) AS n_accepted, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents, {_TARGET_SQL} WHERE octet_length(encode(text)) <= max_bytes GROUP BY target")
def q_s1_size_gate(spark, sf_dir):
    sized = docs(spark, sf_dir).select(F.octet_length(blobs.utf8(F.col("text"))).cast("bigint").alias("n")).filter("n is not null")
    each = sized.select("n", F.explode(F.array(*(F.struct(F.lit(t.name).alias("target"), F.lit(t.max_bytes).alias("m")) for t in TARGETS))).alias("t"))
    return each.filter(F.col("n") <= F.col("t.m")).groupBy("t.target").agg(F.count(F.lit(1)).alias("n_accepted"), F.sum("n").alias("n_bytes"))


@query("SELECT page_id, octet_length(encode(html))::BIGINT AS n_bytes, octet_length(encode(html)) <= 65536 AS fits_64k, octet_length(encode(html)) <= 131072 AS fits_128k FROM pages WHERE octet_length(encode(html)) >= 2")
def q_s2_s3_small_blob_gate(spark, sf_dir):
    n = F.octet_length(blobs.utf8(F.col("html"))).cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n_bytes")).filter("n_bytes >= 2").withColumns({"fits_64k": F.col("n_bytes") <= 65536, "fits_128k": F.col("n_bytes") <= 131072})


@query("SELECT doc_id, ('0x' || hex(encode(text))[1:8])::BIGINT AS u32, ('0x' || hex(encode(text))[1:4])::BIGINT AS u16, ('0x' || hex(encode(text))[3:8])::BIGINT AS u24 FROM documents WHERE octet_length(encode(text)) >= 4")
def q_s9_big_endian_reads(spark, sf_dir):
    data = docs(spark, sf_dir).select("doc_id", blobs.utf8(F.col("text")).alias("d")).filter("octet_length(d) >= 4")
    return data.select("doc_id", bits.from_big_endian(F.col("d"), 0, 4).alias("u32"), bits.from_big_endian(F.col("d"), 0, 2).alias("u16"), bits.from_big_endian(F.col("d"), 1, 3).alias("u24"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, lpad(to_hex(l_partkey), 8, '0') AS be32, lpad(to_hex(l_partkey), 6, '0') AS be24, right(lpad(to_hex(l_partkey), 8, '0'), 4) AS be16 FROM lineitem")
def q_k13_big_endian_writes(spark, sf_dir):
    li, v = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *(F.hex(bits.big_endian(v, n)).alias(f"be{8 * n}") for n in (4, 3, 2)))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS is_ascii FROM documents")
def q_p1_ascii_predicate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", (~F.col("text").rlike("[^\\x00-\\x7F]")).alias("is_ascii"))


@query(f"SELECT doc_id, md5(array_to_string(list_reverse({HEXES}), '')) AS reversed_md5 FROM documents")
def q_p2_reverse_bytes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(F.reverse(blobs.hex_pairs(F.col("text"))), "")).alias("reversed_md5"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o = 0 AND n = 1 THEN 'literal' WHEN o = 0 THEN 'repeat_match' WHEN n = 1 THEN 'repeat_literal' ELSE 'match' END AS kind FROM (SELECT l_orderkey, l_linenumber, l_partkey % 7 AS o, l_quantity::INT % 5 + 1 AS n FROM lineitem)")
def q_p9_token_kinds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", bits.token_kind(F.col("l_partkey") % 7, F.col("l_quantity").cast("int") % 5 + 1).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS n FROM lineitem WHERE NOT (l_quantity::INT < 2 OR l_quantity::INT = 2 AND l_partkey >= 2337)")
def q_p7_discard_short_far(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("n"))
    return li.filter(~((F.col("n") < 2) | (F.col("n") == 2) & (F.col("l_partkey") >= 2337)))


# --- history, candidates -----------------------------------------------------------------------------------------
@query(f"WITH {BYTES}, g AS (SELECT blob_id, pos, b * 256 + lead(b) OVER (PARTITION BY blob_id ORDER BY pos) AS g FROM b) SELECT g::INT AS g, count(*) AS n, count(DISTINCT blob_id) AS n_blobs FROM g WHERE g IS NOT NULL GROUP BY g")
def q_f19_digram_counts(spark, sf_dir):
    return blobs.digrams(docs(spark, sf_dir), "doc_id", "text").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("blob_id").alias("n_blobs"))


@query(f"""WITH {BYTES}, g AS (SELECT blob_id, pos, b * 256 + lead(b) OVER (PARTITION BY blob_id ORDER BY pos) AS g FROM b),
c AS (SELECT blob_id, pos, list(pos) OVER (PARTITION BY blob_id, g ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS l FROM g WHERE g IS NOT NULL),
o AS (SELECT blob_id, [pos - p FOR p IN coalesce(l, []) IF pos - p <= 131071] AS o FROM c)
SELECT blob_id, count(*) AS n_pos, sum(len(o))::BIGINT AS n_candidates, sum(coalesce(list_sum(o), 0))::BIGINT AS sum_offsets, min(list_min(o))::INT AS nearest, max(list_max(o))::INT AS farthest FROM o GROUP BY blob_id""")
def q_j1_chain_candidates(spark, sf_dir):
    found = blobs.chain(blobs.digrams(docs(spark, sf_dir), "doc_id", "text"), 16, 131072)
    total = F.aggregate("offsets", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n_pos"), F.sum(F.size("offsets")).cast("bigint").alias("n_candidates"), F.sum(total).alias("sum_offsets"), F.min(F.array_min("offsets")).alias("nearest"), F.max(F.array_max("offsets")).alias("farthest"))


def _forward_sql(window: int) -> str:
    return f"""WITH {BYTES}, g AS (SELECT blob_id, pos, b * 256 + lead(b) OVER (PARTITION BY blob_id ORDER BY pos) AS g FROM b)
SELECT blob_id, sum(n)::BIGINT AS n_candidates, max(n)::BIGINT AS most FROM (SELECT blob_id, count(*) OVER (PARTITION BY blob_id, g ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND {window} FOLLOWING) AS n FROM g WHERE g IS NOT NULL) GROUP BY blob_id"""


def _forward(spark, sf_dir, window: int) -> DataFrame:
    w = Window.partitionBy("blob_id", "g").orderBy("pos").rangeBetween(1, window)
    each = blobs.digrams(docs(spark, sf_dir), "doc_id", "text").select("blob_id", F.count(F.lit(1)).over(w).alias("n"))
    return each.groupBy("blob_id").agg(F.sum("n").alias("n_candidates"), F.max("n").alias("most"))


@query(_forward_sql(2048))
def q_j2_forward_chain(spark, sf_dir):
    return _forward(spark, sf_dir, 2048)


@query(_forward_sql(18720))
def q_j3_forward_chain_far(spark, sf_dir):
    return _forward(spark, sf_dir, 18720)


@query(f"""WITH {BYTES}, e AS (SELECT blob_id, pos, b = lag(b, 4) OVER (PARTITION BY blob_id ORDER BY pos) AS e FROM b),
i AS (SELECT blob_id, pos, pos - row_number() OVER (PARTITION BY blob_id ORDER BY pos) AS i FROM e WHERE e),
r AS (SELECT blob_id, i, min(pos) AS start, count(*) AS length FROM i GROUP BY blob_id, i)
SELECT blob_id, count(*) AS n_runs, max(length) AS longest, sum(length)::BIGINT AS n_equal, arg_min(start, (-length, start))::INT AS longest_at FROM r GROUP BY blob_id""")
def q_j5_a13_repeat_distance_runs(spark, sf_dir):
    runs = blobs.equal_runs(doc_bytes(spark, sf_dir), 4)
    return runs.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max("length").alias("longest"), F.sum("length").alias("n_equal"), F.min_by("start", F.struct(-F.col("length"), "start")).alias("longest_at"))


@query("""SELECT l_orderkey, l_partkey AS o, l_quantity::INT AS n FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, coalesce(sum((l_quantity >= 45)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM lineitem) WHERE (best IS NULL OR l_quantity > best) AND stopped = 0""")
def q_p5_p6_only_better_until_good(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.withColumn("best", F.max("l_quantity").over(w)).withColumn("stopped", F.coalesce(F.sum((F.col("l_quantity") >= 45).cast("int")).over(w), F.lit(0)))
    return li.filter("(best is null or l_quantity > best) and stopped = 0").select("l_orderkey", F.col("l_partkey").alias("o"), F.col("l_quantity").cast("int").alias("n"))


# --- aggregates --------------------------------------------------------------------------------------------------
@query(f"WITH {BYTES} SELECT d.lang, b, count(*) AS n FROM b JOIN documents d ON d.doc_id = blob_id GROUP BY d.lang, b")
def q_a1_byte_histogram(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("key", F.struct("doc_id", "lang"))
    return blobs.bytes_of(df, "key", "text").groupBy(F.col("blob_id.lang").alias("lang"), "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BYTES}, h AS (SELECT d.lang, b, count(*) AS n FROM b JOIN documents d ON d.doc_id = blob_id GROUP BY d.lang, b) SELECT lang, count(*) AS n_distinct, sum(n)::BIGINT AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits_per_byte FROM h GROUP BY lang")
def q_a1_entropy(spark, sf_dir):
    n, log = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    return q_a1_byte_histogram(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n_distinct"), n.alias("total"), F.round(F.log2(n) - log / n, 6).alias("bits_per_byte"))


@query(f"WITH {BYTES} SELECT blob_id, bit_xor(b)::INT AS checksum FROM b GROUP BY blob_id")
def q_a6_xor_checksum(spark, sf_dir):
    return doc_bytes(spark, sf_dir).groupBy("blob_id").agg(F.bit_xor("b").alias("checksum"))


def _buckets(oo: str, mm: str) -> str:
    return f"(CASE WHEN {mm} < 4 THEN 0 WHEN {mm} < 12 THEN 1 WHEN {mm} < 44 THEN 2 ELSE 3 END) * 4 + (CASE WHEN {oo} < 33 THEN 0 WHEN {oo} < 289 THEN 1 WHEN {oo} < 2337 THEN 2 ELSE 3 END)"


def _bucket_counts(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("o"), F.col("l_quantity").cast("int").alias("n"), "l_returnflag").filter("n >= 2")
    idx = bits.bucket_class(F.col("n"), bits.BUCKET_LENGTHS) * 4 + bits.bucket_class(F.col("o"), bits.BUCKET_OFFSETS)
    return li.groupBy("l_returnflag", idx.cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"))


_BUCKETS = f"SELECT l_returnflag, {_buckets('l_partkey', 'l_quantity::INT')} AS idx, count(*) AS n FROM lineitem WHERE l_quantity::INT >= 2 GROUP BY ALL"


@query(_BUCKETS)
def q_a2_code_buckets(spark, sf_dir):
    return _bucket_counts(spark, sf_dir)


@query(f"SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY bits, idx) - 1 AS place FROM (SELECT l_returnflag, idx, n, rank, CASE WHEN rank < 12 THEN 3 + rank // 2 ELSE 9 END AS bits FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, idx) - 1 AS rank FROM ({_BUCKETS})))")
def q_t16_w8_o4_bucket_codes(spark, sf_dir):
    return codes.bucket_codes(_bucket_counts(spark, sf_dir), ["l_returnflag"], "idx", "n")


@query(f"WITH c AS (SELECT l_returnflag, idx, n, CASE WHEN rank < 12 THEN 3 + rank // 2 ELSE 9 END AS bits FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, idx) - 1 AS rank FROM ({_BUCKETS}))) SELECT l.l_returnflag, sum(bits + CASE WHEN l_quantity::INT < 4 THEN 1 WHEN l_quantity::INT < 12 THEN 3 WHEN l_quantity::INT < 44 THEN 5 ELSE 7 END + CASE WHEN l_partkey < 33 THEN 5 WHEN l_partkey < 289 THEN 8 WHEN l_partkey < 2337 THEN 11 ELSE 14 END)::BIGINT AS total_bits FROM lineitem l JOIN c ON c.l_returnflag = l.l_returnflag AND c.idx = {_buckets('l_partkey', 'l_quantity::INT')} WHERE l_quantity::INT >= 2 GROUP BY l.l_returnflag")
def q_j11_bucket_code_lookup(spark, sf_dir):
    table_ = codes.bucket_codes(_bucket_counts(spark, sf_dir), ["l_returnflag"], "idx", "n").select(F.col("l_returnflag").alias("f"), F.col("idx").alias("i"), "bits")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("o"), F.col("l_quantity").cast("int").alias("n"), "l_returnflag").filter("n >= 2")
    m, o = bits.bucket_class(F.col("n"), bits.BUCKET_LENGTHS), bits.bucket_class(F.col("o"), bits.BUCKET_OFFSETS)
    size = F.length(bits.bucket_code(F.col("n"), bits.BUCKET_LENGTHS)) + F.length(bits.bucket_code(F.col("o"), bits.BUCKET_OFFSETS))
    joined = li.withColumn("idx", (m * 4 + o).cast("int")).join(F.broadcast(table_), (F.col("l_returnflag") == F.col("f")) & (F.col("idx") == F.col("i")))  # at most 16 rows a flag
    return joined.groupBy("l_returnflag").agg(F.sum(F.col("bits") + size).alias("total_bits"))


@query("SELECT (l_orderkey >> 8) & 255 AS bucket, count(*) AS n, sum(count(*)) OVER (ORDER BY (l_orderkey >> 8) & 255)::BIGINT AS upto FROM lineitem GROUP BY 1")
def q_a8_w1_radix_buckets(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.shiftright("l_orderkey", 8).bitwiseAND(255).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))  # 256 rows


@query("SELECT bit, count_if((l_partkey >> bit) & 1 = 1)::BIGINT AS ones, count_if((l_partkey >> bit) & 1 = 0)::BIGINT AS zeros FROM lineitem, range(20) r(bit) GROUP BY bit")
def q_a9_bit_counts(spark, sf_dir):
    one = [F.sum(F.shiftright("l_partkey", k).bitwiseAND(1)).alias(f"b{k}") for k in range(20)]
    sums = table(spark, sf_dir, "lineitem").agg(F.count("l_partkey").alias("n"), *one)
    each = sums.select("n", F.posexplode(F.array(*(f"b{k}" for k in range(20)))).alias("bit", "ones"))
    return each.select(F.col("bit").cast("bigint").alias("bit"), "ones", (F.col("n") - F.col("ones")).alias("zeros"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def q_o1_o3_stable_radix_order(spark, sf_dir):
    """Places of a stable sort by counting: the rank within a bucket of the high bits plus the counts of lower buckets,
    so that no task sorts the whole."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("bucket", F.shiftright("o_custkey", 6))
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("o_custkey", "o_orderkey")) - 1
    before = codes.before(o.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), [], "bucket", "n")
    return o.withColumn("inner", inner).join(before, "bucket").select("o_orderkey", "o_custkey", (F.col("before") + F.col("inner")).alias("place"))


@query("SELECT l_partkey AS key, count(*) AS n, (sum(count(*)) OVER (ORDER BY l_partkey) - count(*))::BIGINT AS place FROM lineitem GROUP BY l_partkey")
def q_o2_unstable_order(spark, sf_dir):
    """The places of a sort by the bits from the highest on, which leaves equal keys in any order: each key's first
    place and its number of rows."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(codes.before(n, [], "key", "n"), "key").select("key", "n", F.col("before").alias("place"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def q_o6_top_matches(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("l_orderkey", "l_partkey", "l_quantity")


# --- scalar functions --------------------------------------------------------------------------------------------
def _numbers(spark, n: int) -> DataFrame:
    return spark.range(1, n).select(F.col("id").alias("v"))


@query(f"SELECT v, {case_sql('v', zip((128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536), (8, 10, 11, 13, 14, 16, 17, 19, 20, 21)), '22')} AS wide_bits, {case_sql('v', zip((128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768), (8, 10, 11, 13, 14, 16, 17, 18, 19)), 'NULL')} AS narrow_bits FROM range(1, 131072) r(v)")
def q_f1_f2_offset_bits(spark, sf_dir):
    v = F.col("v")
    return _numbers(spark, 131072).select("v", bits.offset_bits(v).alias("wide_bits"), bits.offset_bits(v, bits.NARROW_OFFSET_CLASSES).alias("narrow_bits"))


_TAGS = [(128, "''", 0), (256, "'00'", 0), (512, "'01'", 1), (1024, "'100'", 2), (2048, "'101'", 3), (4096, "'1100'", 4), (8192, "'1101'", 5), (16384, "'11100'", 6), (32768, "'11101'", 7), (65536, "'11110'", 8), (131072, "'11111'", 9)]


_NARROW_TAGS = [*_TAGS[:7], (16384, "'1110'", 6), (32768, "'1111'", 7)]
_tags = lambda tags: case_sql("v", [(k, f"{p} || right(repeat('0', 20) || bin(v), {n})" if n else p) for k, p, n in tags], "NULL")
_asides = lambda tags: "(" + case_sql("v", [(k, f"(v >> {n}) & 255") for k, _, n in tags], "NULL") + ")::INT"


@query(f"SELECT v, {_tags(_TAGS)} AS tag, {_asides(_TAGS)} AS aside, {_tags(_NARROW_TAGS)} AS narrow_tag, {_asides(_NARROW_TAGS)} AS narrow_aside FROM range(1, 131072) r(v)")
def q_f3_offset_codes(spark, sf_dir):
    """Both variants; the format with literal runs takes the wide one."""
    wide, narrow = bits.offset_code(F.col("v")), bits.offset_code(F.col("v"), bits.NARROW_OFFSET_CLASSES)
    return _numbers(spark, 131072).select("v", wide["bits"].alias("tag"), wide["byte"].alias("aside"), narrow["bits"].alias("narrow_tag"), narrow["byte"].alias("narrow_aside"))


@query("SELECT v, 2 * floor(log2(v))::INT + 1 - (v >= 32768)::INT AS wide_bits, CASE WHEN v < 256 THEN 2 * floor(log2(v))::INT + 1 - (v >= 128)::INT END AS narrow_bits, length(bin(v)) - 1 AS class FROM range(1, 65536) r(v)")
def q_f4_f7_length_bits(spark, sf_dir):
    v = F.col("v")
    return _numbers(spark, 65536).select("v", bits.length_bits(v, 65535).alias("wide_bits"), F.when(v < 256, bits.length_bits(v, 255)).alias("narrow_bits"), bits.floor_log2(v).cast("bigint").alias("class"))


@query("SELECT v, array_to_string([ '1' || c FOR c IN string_split(substr(bin(v), 2), '') ], '') || CASE WHEN v >= 32768 THEN '' ELSE '0' END AS code FROM range(2, 65536) r(v) UNION ALL SELECT 1, '0'")
def q_f5_length_codes(spark, sf_dir):
    return _numbers(spark, 65536).select("v", bits.length_code(F.col("v"), 65535).alias("code"))


@query("SELECT v, CASE WHEN v < 128 THEN 0 ELSE floor(log2(v))::INT - 6 END AS symbol FROM range(1, 131072) r(v)")
def q_f8_table_offset_symbols(spark, sf_dir):
    return _numbers(spark, 131072).select("v", bits.table_offset_symbol(F.col("v"), 128).alias("symbol"))


@query("SELECT l_orderkey, l_linenumber, repeat('1', (l_quantity::INT // 4)) || '0' || right('00' || bin(l_quantity::INT), 2) AS rice2, repeat('1', (l_quantity::INT // 10)) || '0' || CASE WHEN l_quantity::INT % 10 < 6 THEN right('000' || bin(l_quantity::INT % 10), 3) ELSE right('0000' || bin(l_quantity::INT % 10 + 6), 4) END AS golomb10 FROM lineitem")
def q_f10_f11_rice_golomb(spark, sf_dir):
    v = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.rice_code(v, 2).alias("rice2"), bits.golomb_code(v, 10).alias("golomb10"))


@query("SELECT v, greatest(1, (SELECT min(k) FROM range(0, 9) r(k) WHERE v << k >= 256))::INT AS k, ((3 + 5 * v) % 32)::INT AS slot FROM range(1, 256) r(v)")
def q_f12_f13_shift_and_spread(spark, sf_dir):
    v = F.col("v")
    return _numbers(spark, 256).select("v", bits.least_shift(v, 256).alias("k"), codes.spread(32)(v).cast("int").alias("slot"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o < 33 THEN right(repeat('0', 5) || bin(o - 1), 5) WHEN o < 289 THEN right(repeat('0', 8) || bin(o - 33), 8) WHEN o < 2337 THEN right(repeat('0', 11) || bin(o - 289), 11) ELSE right(repeat('0', 14) || bin(o - 2337), 14) END AS offset_code, CASE WHEN n < 4 THEN right('0' || bin(n - 2), 1) WHEN n < 12 THEN right('000' || bin(n - 4), 3) WHEN n < 44 THEN right('00000' || bin(n - 12), 5) ELSE right('0000000' || bin(n - 44), 7) END AS length_code FROM (SELECT l_orderkey, l_linenumber, l_partkey AS o, l_quantity::INT AS n FROM lineitem) WHERE n >= 2")
def q_f14_f15_bucket_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("o"), F.col("l_quantity").cast("int").alias("n")).filter("n >= 2")
    return li.select("l_orderkey", "l_linenumber", bits.bucket_code(F.col("o"), bits.BUCKET_OFFSETS).alias("offset_code"), bits.bucket_code(F.col("n"), bits.BUCKET_LENGTHS).alias("length_code"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey <= 32 AND l_quantity <= 3 THEN 1 WHEN l_quantity <= 17 THEN 2 ELSE 3 END AS n_bytes FROM lineitem")
def q_f16_simple_token_bytes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.simple_token_bytes(F.col("l_partkey"), F.col("l_quantity")).alias("n_bytes"))


@query("SELECT o_orderkey, rpad(o_orderpriority[1:10], 10, ' ') AS name10 FROM orders")
def q_f22_fixed_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rpad(F.substring("o_orderpriority", 1, 10), 10, " ").alias("name10"))


@query("SELECT l_orderkey, l_linenumber, ((l_suppkey % 3 + 1001) | ((l_partkey % 3) << 30))::BIGINT AS combined, ((l_partkey % 3) << 30) >> 30 AS memory FROM lineitem")
def q_f18_f23_merge_keys(spark, sf_dir):
    kind, memory = F.col("l_suppkey") % 3 + 1001, F.col("l_partkey") % 3
    key = kind.bitwiseOR(F.shiftleft(memory, 30))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("combined"), F.shiftright(F.shiftleft(memory, 30), 30).alias("memory"))


# --- logs and text -----------------------------------------------------------------------------------------------
def _log(spark, sf_dir) -> DataFrame:
    """Log lines of a parse, made from lineitem: literals and matches. The form of a line is a fixed value."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int")
    line = F.when(n % 3 == 0, F.format_string("%04d (%5d) RAW %d  ('x')", F.col("l_linenumber"), F.col("l_orderkey"), n)).otherwise(F.format_string("%04d (%5d) MTC %d,%d OM 00 -> 0004 (3)", F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey"), n))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))


def _scanned_log(spark, sf_dir) -> DataFrame:
    """The log as a text file, read line by line."""
    path = scratch(spark, "log")
    files.write_lines(_log(spark, sf_dir), "line", path)
    return files.read_lines(spark, path)


_LOG = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity::INT % 3 = 0 THEN printf('%04d (%5d) RAW %d  (''x'')', l_linenumber, l_orderkey, l_quantity::INT) ELSE printf('%04d (%5d) MTC %d,%d OM 00 -> 0004 (3)', l_linenumber, l_orderkey, l_partkey, l_quantity::INT) END AS line FROM lineitem"


@query(f"SELECT regexp_extract(line, 'MTC (\\d+),(\\d+)', 1)::INT AS o, count(*) AS n FROM ({_LOG}) WHERE line LIKE '%MTC%' GROUP BY 1")
def q_f21_a10_log_offset_histogram(spark, sf_dir):
    o = F.regexp_extract("line", r"MTC (\d+),(\d+)", 1).cast("int")
    return _scanned_log(spark, sf_dir).filter(F.col("line").contains("MTC")).groupBy(o.alias("o")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT ((regexp_extract(line, 'MTC (\\d+),(\\d+)', 2)::INT - 2) // 8)::BIGINT AS bin, count(*) AS n FROM ({_LOG}) WHERE line LIKE '%MTC%' AND regexp_extract(line, 'MTC (\\d+),(\\d+)', 2)::INT >= 2 GROUP BY 1")
def q_a11_log_length_histogram(spark, sf_dir):
    n = F.regexp_extract("line", r"MTC (\d+),(\d+)", 2).cast("int")
    return _scanned_log(spark, sf_dir).filter(F.col("line").contains("MTC") & (n >= 2)).groupBy(F.floor((n - 2) / 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS (SELECT l_orderkey, line LIKE '%RAW%' AS raw, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM ({_LOG})),
m AS (SELECT l_orderkey, i, i - 1 - coalesce(lag(i) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS run FROM l WHERE NOT raw) SELECT l_orderkey, i::INT AS line_no, run::INT AS run FROM m""")
def q_w5_literal_runs_of_log(spark, sf_dir):
    """Literals before each match line (0 where it follows another); a run at the end is not told."""
    w = Window.partitionBy("l_orderkey")
    lines = _log(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey"))).filter(~F.col("line").contains("RAW"))
    return lines.select("l_orderkey", F.col("i").alias("line_no"), (F.col("i") - 1 - F.coalesce(F.lag("i").over(w.orderBy("i")), F.lit(0))).alias("run"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS lit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM e WHERE lit)
SELECT event_id, count(*) OVER (PARTITION BY user_id, island) - row_number() OVER (PARTITION BY user_id, island ORDER BY i) + 1 AS run_left FROM g""")
def q_w4_literal_run_numbers(spark, sf_dir):
    """The first literal of a run has its length, the last has 1."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("i", F.row_number().over(w.orderBy("event_id"))).filter("event_type = 'click'")
    e = e.withColumn("island", F.col("i") - F.row_number().over(w.orderBy("i")))
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id", "island").orderBy(F.desc("i"))).cast("bigint").alias("run_left"))


@query("SELECT conv_id, turn, upper(text) = text AS shouted, regexp_replace(replace(text, chr(13), ''), '[0-7]', '', 'g') AS dropped FROM conversations")
def q_f20_text_translate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.upper("text") == F.col("text")).alias("shouted"), F.translate("text", "\r01234567", "").alias("dropped"))


# --- entropy-code tables -----------------------------------------------------------------------------------------
def _class_counts(spark, sf_dir) -> DataFrame:
    b = F.col("b")
    return q_a1_byte_histogram(spark, sf_dir).groupBy("lang", F.when(b == 0, 0).otherwise(bits.floor_log2(b) + 1).cast("int").alias("sym")).agg(F.sum("n").alias("cnt"))


_CLASSES = f"WITH {BYTES}, c AS (SELECT d.lang, CASE WHEN b = 0 THEN 0 ELSE floor(log2(b))::INT + 1 END AS sym, count(*)::BIGINT AS cnt FROM b JOIN documents d ON d.doc_id = blob_id GROUP BY 1, 2)"
_SCALED = _CLASSES + """, u AS (SELECT *, sum(cnt) OVER (PARTITION BY lang ORDER BY sym) AS hi, sum(cnt) OVER (PARTITION BY lang) AS total FROM c),
r AS (SELECT *, greatest(1, (32 * hi) // total - (32 * (hi - cnt)) // total)::INT AS one FROM u),
h AS (SELECT lang, max(cap) AS cap FROM (SELECT lang, cap FROM r, range(1, 33) x(cap) GROUP BY lang, cap HAVING sum(least(one, cap)) <= 32) GROUP BY lang),
s AS (SELECT r.*, cap, 32 - sum(least(one, cap)) OVER (PARTITION BY r.lang) AS spare, sum((one > cap)::INT) OVER (PARTITION BY r.lang ORDER BY sym) AS nth FROM r JOIN h USING (lang)),
f AS (SELECT lang, sym, cnt, (least(one, cap) + (one > cap AND nth <= spare)::INT)::INT AS scaled FROM s)"""


@query(_SCALED + " SELECT lang, sym, cnt, scaled FROM f")
def q_t17_scaled_frequencies(spark, sf_dir):
    return codes.scaled(_class_counts(spark, sf_dir), ["lang"], "sym", "cnt", 32)


_STATES = _SCALED + """, p AS (SELECT lang, sym, scaled, unnest(range(scaled, 2 * scaled)) AS p, sum(scaled) OVER (PARTITION BY lang ORDER BY sym) - scaled AS first FROM f),
q AS (SELECT *, ((3 + 5 * (first + p - scaled)) % 32)::INT AS slot, greatest(1, (SELECT min(k) FROM range(0, 6) r(k) WHERE p.p << k >= 32))::INT AS k FROM p)"""


@query(_STATES + " SELECT lang, sym, ((y) % 32)::INT AS state, slot AS next, k FROM (SELECT *, unnest(range(p << k, (p << k) + (1 << k))) AS y FROM q)")
def q_t18_encoding_table(spark, sf_dir):
    return codes.encoding_table(q_t17_scaled_frequencies(spark, sf_dir), ["lang"], "sym", 32)


@query(_STATES + " SELECT lang, slot AS state, sym, p::INT AS y FROM q")
def q_t19_decoding_table(spark, sf_dir):
    return codes.decoding_table(q_t17_scaled_frequencies(spark, sf_dir), ["lang"], "sym", 32)


@query(_CLASSES + ", u AS (SELECT *, sum(cnt) OVER (PARTITION BY lang ORDER BY sym)::BIGINT AS hi FROM c) SELECT o_orderkey, lang, sym FROM orders JOIN u ON o_orderkey % 100000 >= hi - cnt AND o_orderkey % 100000 < hi")
def q_j9_cumulative_lookup(spark, sf_dir):
    """The symbol whose half-open range holds a number; the ranges (a few symbols a language) are the small side."""
    ranges = codes.cumulative(_class_counts(spark, sf_dir), ["lang"], "sym", "cnt")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100000).alias("r"))
    return o.join(F.broadcast(ranges), (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("o_orderkey", "lang", "sym")


@query(_SCALED + " SELECT lang, sum(cnt)::BIGINT AS total, round(sum(cnt * (5 - log2(scaled))), 3) AS table_bits, round(1 - sum(cnt * (5 - log2(scaled))) / (8 * sum(cnt)), 6) AS gain FROM f GROUP BY lang")
def q_a7_a14_table_bits_and_gain(spark, sf_dir):
    f = q_t17_scaled_frequencies(spark, sf_dir)
    size = F.sum(F.col("cnt") * (5 - F.log2("scaled")))
    return f.groupBy("lang").agg(F.sum("cnt").alias("total"), F.round(size, 3).alias("table_bits"), F.round(1 - size / (8 * F.sum("cnt")), 6).alias("gain"))


@query(f"SELECT o, n, row_number() OVER (ORDER BY o) AS place FROM (SELECT regexp_extract(line, 'MTC (\\d+),(\\d+)', 2)::INT AS o, count(*) AS n FROM ({_LOG}) WHERE line LIKE '%MTC%' GROUP BY 1)")
def q_s6_o7_sorted_log_items(spark, sf_dir):
    """Lengths of the log's matches in their order, with their numbers; lengths are few, whatever the log's size."""
    o = F.regexp_extract("line", r"MTC (\d+),(\d+)", 2).cast("int")
    items = _scanned_log(spark, sf_dir).filter(F.col("line").contains("MTC")).groupBy(o.alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return items.withColumn("place", F.row_number().over(Window.orderBy("o")).cast("bigint"))


@query(f"SELECT count(*) AS n_lines, sum(octet_length(encode(line)) + 1)::BIGINT AS n_bytes FROM ({_LOG})")
def q_s11_binary_files(spark, sf_dir):
    """The log's files as byte arrays: their sizes and line ends."""
    path = scratch(spark, "log")
    files.write_lines(_log(spark, sf_dir), "line", path)
    read = files.read_bytes(spark, path)
    return read.agg(F.sum(files.line_ends(F.col("content"))).cast("bigint").alias("n_lines"), F.sum("length").alias("n_bytes"))


@query("SELECT n_name, r_name, count(*) AS n, round(sum(s_acctbal), 2)::DOUBLE AS balance FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def q_s7_csv_scan(spark, sf_dir):
    """Three tables from CSV files with a header, types inferred."""
    read = {}
    for name, columns in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]), ("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])):
        path = scratch(spark, name)
        table(spark, sf_dir, name).select(*columns).write.csv(path, header=True)
        read[name] = files.read_csv(spark, path)
    joined = read["supplier"].join(read["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(read["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).cast("double").alias("balance"))


# --- relocations -------------------------------------------------------------------------------------------------
_RELOCS = "SELECT DISTINCT (l_suppkey % 8)::INT AS src, (l_linenumber % 4)::INT AS dst, l_orderkey * 2 AS off FROM lineitem"


def _relocs(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 8).cast("int").alias("src"), (F.col("l_linenumber") % 4).cast("int").alias("dst"), (F.col("l_orderkey") * 2).alias("off"))


@query(f"SELECT src, dst, count(*) AS n, min(off) AS first, max(off) AS last FROM ({_RELOCS} UNION SELECT 1, 1, o_orderkey * 2 FROM orders) GROUP BY src, dst")
def q_u1_o5_union_distinct_relocs(spark, sf_dir):
    more = table(spark, sf_dir, "orders").select(F.lit(1).alias("src"), F.lit(1).alias("dst"), (F.col("o_orderkey") * 2).alias("off"))
    return _relocs(spark, sf_dir).unionByName(more).distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("first"), F.max("off").alias("last"))


def _deltas(spark, sf_dir) -> DataFrame:
    """Distance to the offset before. A table's offsets lie in few groups, so they are cut into ranges; the first of a
    range looks at the largest of the range before."""
    rows = _relocs(spark, sf_dir).distinct().withColumn("part", F.shiftright("off", 14))
    keys = ["src", "dst", "part"]
    w = Window.partitionBy("src", "dst").orderBy("part")
    last = rows.groupBy(*keys).agg(F.max("off").alias("last")).withColumn("carried", F.coalesce(F.lag("last").over(w), F.lit(0))).drop("last")
    inner = F.lag("off").over(Window.partitionBy(*keys).orderBy("off"))
    return rows.withColumn("inner", inner).join(last, keys).select("src", "dst", "off", (F.col("off") - F.coalesce("inner", "carried")).alias("delta"))


_DELTAS = f"SELECT *, off - lag(off, 1, 0) OVER (PARTITION BY src, dst ORDER BY off) AS delta FROM ({_RELOCS})"


@query(f"SELECT src, dst, off, delta FROM ({_DELTAS})")
def q_w3_reloc_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query(f"SELECT src, dst, off, CASE WHEN v < 128 THEN lpad(to_hex(v), 2, '0') WHEN v < 16384 THEN lpad(to_hex((v >> 7) + 128), 2, '0') || lpad(to_hex(v & 127), 2, '0') ELSE lpad(to_hex((v >> 14) + 128), 2, '0') || lpad(to_hex((v >> 7) & 127 | 128), 2, '0') || lpad(to_hex(v & 127), 2, '0') END AS code FROM (SELECT *, delta >> 1 AS v FROM ({_DELTAS}))")
def q_f17_delta_varint(spark, sf_dir):
    return _deltas(spark, sf_dir).select("src", "dst", "off", bits.delta_varint(F.col("delta")).alias("code"))


_SEGMENTS = "SELECT s_suppkey AS seg, (s_nationkey % 3)::INT AS kind, (s_nationkey % 2)::INT AS memory, floor(abs(s_acctbal))::BIGINT AS size FROM supplier"
_PLACED = f"SELECT *, kind * 2 + memory AS combined, min(seg) OVER (PARTITION BY kind, memory) AS seen, coalesce(sum(size) OVER (PARTITION BY kind, memory ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM ({_SEGMENTS})"


def _segments(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("seg"), (F.col("s_nationkey") % 3).cast("int").alias("kind"), (F.col("s_nationkey") % 2).cast("int").alias("memory"), F.floor(F.abs("s_acctbal")).alias("size"))


def _placed(spark, sf_dir) -> DataFrame:
    """Segments with the number of their merged one and their place there: the sum of sizes before, by ranges."""
    s = _segments(spark, sf_dir).withColumn("part", F.shiftright("seg", 12))
    keys = ["kind", "memory", "part"]
    inner = F.sum("size").over(Window.partitionBy(*keys).orderBy("seg")) - F.col("size")
    carried = codes.before(s.groupBy(*keys).agg(F.sum("size").alias("n")), ["kind", "memory"], "part", "n")
    s = s.withColumn("inner", inner).join(carried, keys).withColumn("base", F.col("inner") + F.col("before"))
    groups = _segments(spark, sf_dir).groupBy("kind", "memory").agg(F.min("seg").alias("seen"))  # a row for each kind
    groups = groups.withColumn("merged", F.row_number().over(Window.orderBy("seen")) - 1)
    return s.join(F.broadcast(groups.drop("seen")), ["kind", "memory"]).select("seg", "kind", "memory", "size", "base", "merged")


@query(f"SELECT seg, (dense_rank() OVER (ORDER BY seen) - 1)::INT AS merged, base FROM ({_PLACED})")
def q_j7_w2_merged_segments(spark, sf_dir):
    return _placed(spark, sf_dir).select("seg", "merged", "base")


@query(f"SELECT (dense_rank() OVER (ORDER BY min(seg)) - 1)::INT AS merged, count(*) AS n, sum(size)::BIGINT AS total, max(size) AS largest FROM ({_SEGMENTS}) GROUP BY kind, memory")
def q_a12_segment_totals(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("merged").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("largest"))


@query(f"WITH p AS (SELECT seg, (dense_rank() OVER (ORDER BY seen) - 1)::INT AS merged, base FROM ({_PLACED})) SELECT l_orderkey, l_linenumber, a.merged AS src, b.merged AS dst, a.base + l_orderkey * 2 AS place, b.base AS added FROM lineitem JOIN p a ON a.seg = l_suppkey JOIN p b ON b.seg = (l_suppkey + 3) % 7")
def q_j6_t26_rebased_relocs(spark, sf_dir):
    p = _placed(spark, sf_dir).select("seg", "merged", "base")
    src = p.select(F.col("seg").alias("s"), F.col("merged").alias("src"), F.col("base").alias("src_base"))
    dst = p.select(F.col("seg").alias("d"), F.col("merged").alias("dst"), F.col("base").alias("added"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    joined = li.join(src, F.col("l_suppkey") == F.col("s")).join(dst, (F.col("l_suppkey") + 3) % 7 == F.col("d"))
    return joined.select("l_orderkey", "l_linenumber", "src", "dst", (F.col("src_base") + F.col("l_orderkey") * 2).alias("place"), "added")


# --- sequential kernels, one blob at a time ----------------------------------------------------------------------
@query()
def q_t1_t7_t29_parse_wide(spark, sf_dir):
    return parse.summaries(docs(spark, sf_dir), "doc_id", "text", "wide")


@query()
def q_t1_t7_t29_parse_narrow(spark, sf_dir):
    return parse.summaries(docs(spark, sf_dir), "doc_id", "text", "narrow")


@query()
def q_t8_t30_parse_wide_runs(spark, sf_dir):
    """Literal runs; a text that no tokens cover (too long a run, P12) has its status."""
    return runs.summaries(docs(spark, sf_dir), "doc_id", "text", "wide_runs")


@query()
def q_t9_f9_parse_tabled_runs(spark, sf_dir):
    return runs.summaries(docs(spark, sf_dir), "doc_id", "text", "tabled_runs")


@query()
def q_t10_f9_parse_tabled(spark, sf_dir):
    return runs.summaries(docs(spark, sf_dir), "doc_id", "text", "tabled")


@query()
def q_a3_t36_symbol_frequencies(spark, sf_dir):
    """How often each table's symbols occur over the chosen tokens of all texts, by stream."""
    return runs.symbol_totals(docs(spark, sf_dir), "doc_id", "text", "tabled_runs")


def _longest(data: bytes) -> tuple:
    best = (0, 0, -1)  # the first seen of equal ones
    for pos, found in enumerate(parse.matches(data, parse.BY_NAME["wide"])):
        for o, n in found:
            if n > best[0]:
                best = (n, o, pos)
    return len(data), *best


@query()
def q_a13_longest_match(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _longest, "n_bytes bigint, length bigint, offset bigint, pos bigint")


def _coded(data: bytes) -> tuple:
    counts = [data.count(b) for b in range(256)]
    freqs = [c * (1 << 16) // max(1, len(data)) or (c > 0) for c in counts]
    if data:
        freqs[max(range(256), key=freqs.__getitem__)] += (1 << 16) - sum(freqs)
    state, stream = entropy.rans_encode(data, freqs) if data else (entropy.RANS_LOW, b"")
    bits = [b >> k & 1 for b in data for k in range(8)]
    last, out = entropy.binary_encode(bits)
    return len(data), len(stream), len(out), bytes(entropy.rans_decode(state, stream, freqs, len(data))) == data, entropy.binary_decode(last, out, len(bits)) == bits


@query()
def q_t21_t22_range_coders(spark, sf_dir):
    return kernels.per_blob(docs(spark, sf_dir), "doc_id", "text", "range coders", "n_bytes bigint, range_bytes bigint, binary_bits bigint, range_trip boolean, binary_trip boolean")


def _tabled(data: bytes) -> tuple:
    symbols = [b.bit_length() for b in data]
    freqs = [1, 1, 1, 1, 1, 1, 5, 19, 2] if data else [32]
    state, out = entropy.table_encode(symbols, freqs)
    return len(data), len(out), entropy.table_decode(state, out, freqs, len(symbols)) == symbols


@query()
def q_t20_table_coder(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _tabled, "n_bytes bigint, n_bits bigint, trip boolean")


def _fronted(data: bytes) -> tuple:
    moved = entropy.move_to_front(data)
    slots = entropy.recent_offsets(list(data))
    return len(data), sum(moved), bytes(entropy.move_back(moved)) == data, sum(s >= 0 for s in slots), sum(s == 0 for s in slots)


@query()
def q_t23_t25_lists(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _fronted, "n_bytes bigint, sum_index bigint, trip boolean, hits bigint, front_hits bigint")


def _escaped(data: bytes) -> tuple:
    front = entropy.Front()
    stream, escaped = front.encode(data)
    return len(data), escaped, len(stream), front.decode(stream) == data


@query()
def q_t23_t24_a15_escaped_lists(spark, sf_dir):
    """Move to front with escapes in batches: all bytes, escaped ones, and numbers written."""
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _escaped, "n_bytes bigint, n_escaped bigint, n_written bigint, trip boolean")


_MTF = """WITH bytes AS (SELECT item_id AS blob_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS pos FROM benchmark),
b AS (SELECT blob_id, pos, ('0x' || h)::INT AS b FROM bytes)"""


@query(_MTF + """, l AS (SELECT *, lag(pos) OVER (PARTITION BY blob_id, b ORDER BY pos) AS before FROM b),
s AS (SELECT x.blob_id, x.pos, x.b, x.before, count(DISTINCT y.b) FILTER (WHERE y.pos > x.before) AS since, count(DISTINCT y.b) FILTER (WHERE y.b > x.b) AS above FROM l x LEFT JOIN b y ON y.blob_id = x.blob_id AND y.pos < x.pos GROUP BY ALL)
SELECT blob_id, pos, (CASE WHEN before IS NOT NULL THEN since ELSE b + above END)::INT AS idx FROM s""")
def q_t23_move_to_front(spark, sf_dir):
    """Relational move to front, for short blobs: the bytes since the last occurrence, or, for a new byte, those seen
    above it. A frame collects all bytes before, which grows with the square of a blob's length, so it runs on the items
    of `benchmark`; q_t23_t25_lists does the same on `documents` with a list of 256 entries."""
    rows = blobs.bytes_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    w = Window.partitionBy("blob_id").orderBy("pos")
    seen = F.collect_list(F.struct("b", "pos")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = rows.withColumn("before", F.lag("pos").over(Window.partitionBy("blob_id", "b").orderBy("pos"))).withColumn("seen", seen)
    since = F.size(F.array_distinct(F.transform(F.filter("seen", lambda s: s["pos"] > F.col("before")), lambda s: s["b"])))
    above = F.size(F.array_distinct(F.transform(F.filter("seen", lambda s: s["b"] > F.col("b")), lambda s: s["b"])))
    return r.select("blob_id", "pos", F.when(F.col("before").isNotNull(), since).otherwise(F.col("b") + above).cast("int").alias("idx"))


def _taped(data: bytes) -> tuple:
    parts = [data[k : k + 65533] for k in range(0, len(data), 65533)] or [b""]
    read = [containers.tape_blocks(containers.tape(p, "document")) for p in parts]
    return len(data), sum(len(d) for blocks in read for _, d, _ in blocks), all(ok for blocks in read for _, _, ok in blocks), b"".join(blocks[1][1] for blocks in read) == data


@query("SELECT doc_id AS blob_id, n AS n_bytes, n + 17 * greatest(1, (n + 65532) // 65533) AS stored_bytes, TRUE AS checks, TRUE AS trip FROM (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n FROM documents)")
def q_k3_k4_tape_image(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _taped, "n_bytes bigint, stored_bytes bigint, checks boolean, trip boolean")


def _merged(data: bytes) -> tuple:
    """An executable of four segments that holds the text: merging them changes nothing that a loader would see."""
    half = (len(data) // 2 + 3) // 4 * 4 + 8
    body = data + bytes(2 * half - len(data))
    code, more = body[:half], body[half:]
    places = set(range(0, half - 4, 12))
    S = containers.Segment
    segments = [S(containers.CODE, 0, code, half, {1: places, 2: {half - 4}}), S(containers.DATA, 0, more, half, {0: places}), S(containers.CODE, 0, more, half, {3: {4}}), S(containers.ZEROS, 0, b"", 64)]
    read = containers.parse(containers.build(segments))
    merged = containers.merge(read)
    at = [0x10000 + sum(s.size for s in merged[:k]) for k in range(len(merged))]
    single = [at[0], at[1], at[0] + half, at[2]]
    one, two = containers.load(read, single), containers.load(merged, at)
    return len(data), len(read), len(merged), len(containers.packed_relocs(merged)), one[0] + one[2] == two[0] and one[1] == two[1]


def _executable(data: bytes) -> list:
    half = (len(data) // 2 + 3) // 4 * 4 + 8
    body = data + bytes(2 * half - len(data))
    S = containers.Segment
    return [S(containers.CODE, 0, body[:half], half, {1: set(range(0, half - 4, 12)), 2: {half - 4}}), S(containers.DATA, 1, body[half:], half, {0: {0, 4}}), S(containers.ZEROS, 0, b"", 64)]


def _stripped(data: bytes) -> tuple:
    """An executable that holds the text, stripped of all but segments and relocations, and restored."""
    image = containers.build(_executable(data))
    small = containers.prepared(image, "strip")
    return len(data), len(image), len(small), containers.restored(small) == containers.parse(image)


@query()
def q_t27_t28_stripped_executables(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _stripped, "n_bytes bigint, image_bytes bigint, stripped_bytes bigint, same boolean")


#: A stand-in of 32 bytes for the machine code, which is not part of this package.
LOADER = containers.Loader(bytes(32), 12, 2, 24)


def _starting(data: bytes) -> tuple:
    image = containers.self_starting(LOADER, data, _executable(data))
    read = containers.parse(image)
    at = [0x10000 + sum(s.size for s in read[:k]) for k in range(len(read))]
    call = containers.load(read, at)[0][:8]
    return len(data), len(image), sum(s.size for s in read), call == struct.pack(">HIH", containers.CALL, at[-1], containers.AFTER), LOADER.stream(image) == data


_SIZED = "(SELECT doc_id AS blob_id, n AS n_bytes, (n + 35) // 4 * 4 AS last, (n // 2 + 3) // 4 * 4 + 8 AS half FROM (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n FROM documents))"


@query(f"SELECT blob_id, n_bytes, 112 + last AS image_bytes, 2 * half + 64 + last AS memory_bytes, TRUE AS called, TRUE AS trip FROM {_SIZED}")
def q_k5_k7_self_starting_images(spark, sf_dir):
    """Executables of two segments that hold each text and one of zeros, with a loader and the text as its stream."""
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _starting, "n_bytes bigint, image_bytes bigint, memory_bytes bigint, called boolean, trip boolean")


def _addressed(data: bytes) -> tuple:
    image = containers.at_address(LOADER, data, 0x40000, 0x40010)
    content = containers.parse(image)[0].data
    return len(data), len(image), *(struct.unpack_from(">I", content, p)[0] for p in (LOADER.load_at, LOADER.jump_at)), LOADER.stream(image) == data


@query(f"SELECT blob_id, n_bytes, 36 + last AS image_bytes, 262144::BIGINT AS load, 262160::BIGINT AS jump, TRUE AS trip FROM {_SIZED}")
def q_k6_k7_images_at_addresses(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _addressed, "n_bytes bigint, image_bytes bigint, load bigint, jump bigint, trip boolean")


@query()
def q_s8_t26_t32_executables(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _merged, "n_bytes bigint, n_read bigint, n_merged bigint, reloc_bytes bigint, same boolean")


def _aligned(data: bytes) -> tuple:
    tokens, stream = forward.aligned_tokens(data), forward.aligned_encode(data)
    return len(data), len(stream), sum(k == 1 for k, _ in tokens), sum(k > 1 for k, _ in tokens), forward.aligned_decode(stream) == data


@query()
def q_t13_t14_t31_aligned_format(spark, sf_dir):
    return kernels.per_blob(docs(spark, sf_dir), "doc_id", "text", "aligned", "n_bytes bigint, encoded_bytes bigint, n_literals bigint, n_matches bigint, trip boolean")


def _by_mode(data: bytes) -> tuple:
    streams = [forward.aligned_encode(data, m) for m in forward.MODES]
    return len(data), *map(len, streams), all(forward.aligned_decode(s) == data for s in streams)


@query()
def q_t14_w7_aligned_modes(spark, sf_dir):
    """Bytes of the aligned format by least cost, by matches that give way to later ones, and by the longest matches."""
    return kernels.per_blob(docs(spark, sf_dir), "doc_id", "text", "aligned modes", "n_bytes bigint, least_bytes bigint, deferred_bytes bigint, greedy_bytes bigint, trip boolean")


def _by_reach(data: bytes) -> tuple:
    streams = [forward.bucket_encode(data, r) for r in (1, 2, forward.REACH)]
    return len(data), *map(len, streams), all(forward.bucket_decode(s) == data for s in streams)


@query()
def q_t15_w7_bucketed_modes(spark, sf_dir):
    """Bytes of the bucketed format by the longest matches, by a look one place ahead, and by the full reach."""
    return kernels.per_blob(docs(spark, sf_dir), "doc_id", "text", "bucketed modes", "n_bytes bigint, greedy_bytes bigint, lazy_bytes bigint, deferred_bytes bigint, trip boolean")


def _bucketed(data: bytes) -> tuple:
    tokens, stream = forward.deferred_parse(data), forward.bucket_encode(data)
    return len(data), len(stream), sum(k == 1 for k, _ in tokens), sum(k > 1 for k, _ in tokens), forward.bucket_decode(stream) == data


@query()
def q_t15_k11_t31_bucketed_format(spark, sf_dir):
    return kernels.per_blob(docs(spark, sf_dir), "doc_id", "text", "bucketed", "n_bytes bigint, encoded_bytes bigint, n_literals bigint, n_matches bigint, trip boolean")


@query()
def q_k1_k10_raw_files(spark, sf_dir):
    """Every text's byte-aligned stream with its trailer as a raw file, read back as byte arrays and decoded. Texts of
    64 KB or more don't fit the trailer, and are told as such."""
    encoded = entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _trailed, "n_bytes bigint, fits boolean, data binary").withColumnRenamed("fits", "kept")
    path = scratch(spark, "streams")
    files.write_blobs(encoded.filter("kept"), path).write.format("noop").mode("overwrite").save()
    read = files.read_blobs(spark, path).join(docs(spark, sf_dir), F.col("blob_id") == F.col("doc_id"))
    return entropy.per_blob(read.withColumn("both", F.concat(F.hex("data"), F.lit(":"), F.coalesce(F.hex(blobs.utf8(F.col("text"))), F.lit("")))), "blob_id", "both", _read_back, "encoded_bytes bigint, n_bytes bigint, trip boolean")


def _trailed(data: bytes) -> tuple:
    fits = len(data) < 1 << 16
    return len(data), fits, forward.with_length(forward.aligned_encode(data), len(data)) if fits else b""


def _read_back(both: bytes) -> tuple:
    stream, text = (bytes.fromhex(x) for x in both.decode().split(":"))
    size = int.from_bytes(stream[-2:], "little")
    decoded = forward.aligned_decode(stream[:-2])
    return len(stream), size, decoded == text and size == len(text)


def _prefixed(data: bytes) -> tuple:
    z = parse.prefix_matches(data)
    return len(data), sum(v > 1 for v in z), max(z, default=0), sum(z)


@query()
def q_j4_prefix_matches(spark, sf_dir):
    return entropy.per_blob(docs(spark, sf_dir), "doc_id", "text", _prefixed, "n_bytes bigint, n_matches bigint, longest bigint, total bigint")


@query("SELECT doc_id, '84' || right('000000' || to_hex(octet_length(encode(text))), 6) AS header FROM documents WHERE text IS NOT NULL")
def q_k2_stream_headers(spark, sf_dir):
    return docs(spark, sf_dir).filter("text is not null").select("doc_id", blobs.stream_header(F.octet_length(blobs.utf8(F.col("text"))), True, False, 4).alias("header"))


@query("""WITH h AS (SELECT item_id, regexp_extract_all(lower(hex(encode(text))), '..') AS l FROM benchmark)
SELECT item_id, array_to_string([array_to_string(['0x' || x FOR x IN list_slice(l, 8 * k + 1, 8 * k + 8)], ',') FOR k IN range((len(l) + 7) // 8)], ',' || chr(10)) AS code FROM h""")
def q_k12_hex_arrays(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", blobs.hex_array(F.col("text")).alias("code"))


@query("SELECT l_orderkey, l_linenumber, greatest(2, least(l_quantity::INT * 8, 255)) AS good, greatest(1, least(l_partkey, 9999)) AS chain FROM lineitem")
def q_p13_clamped_options(spark, sf_dir):
    clamp = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(v, F.lit(hi)))
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", clamp(F.col("l_quantity").cast("int") * 8, 2, 255).alias("good"), clamp(F.col("l_partkey"), 1, 9999).alias("chain"))


@query("SELECT s_suppkey, kind FROM (SELECT s_suppkey, s_nationkey % 7 + 1000 AS kind FROM supplier) WHERE kind IN (1001, 1002, 1003)")
def q_p10_supported_parts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 7 + 1000).alias("kind"))
    return s.filter(F.col("kind").isin(containers.CODE, containers.DATA, containers.ZEROS))


_MARKED = "replace(replace(replace(replace(text, ' t', chr(1) || 'R'), ' a', chr(1) || '3'), ' o', chr(1) || 'N'), ' h', chr(1) || chr(130))"
_UNMARKED = "replace(replace(replace(replace(text, ' t', chr(3)), ' a', ''), ' o', chr(15)), ' h', '   ')"


@query(f"SELECT conv_id, turn, {_UNMARKED} AS plain FROM conversations")
def q_s5_f20_control_sequences(spark, sf_dir):
    marked = F.col("text")
    for found, code in ((" t", "\x01R"), (" a", "\x013"), (" o", "\x01N"), (" h", "\x01" + chr(130))):
        marked = F.replace(marked, F.lit(found), F.lit(code))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", blobs.translate_controls(marked).alias("plain"))


@query(f"SELECT doc_id, list_reduce([('0x' || h)::INT & 1 FOR h IN {HEXES}], lambda p, bit: CASE WHEN bit = 1 THEN greatest(1, p - greatest(1, (256 - p) // 32)) ELSE least(255, p + greatest(1, p // 32)) END, 128) AS p FROM documents WHERE text IS NOT NULL")
def q_f24_adapted_probability(spark, sf_dir):
    """The model's probability after the lowest bits of all bytes of a text, from an even start."""
    low = F.transform(blobs.hex_pairs(F.col("text")), lambda h: F.conv(h, 16, 10).cast("int").bitwiseAND(1))

    def moved(p, bit):
        step = F.greatest(F.lit(1), F.floor(F.when(bit == 1, 256 - p).otherwise(p) / 32)).cast("int")
        return F.when(bit == 1, F.greatest(F.lit(1), p - step)).otherwise(F.least(F.lit(255), p + step))

    return docs(spark, sf_dir).filter("text is not null").select("doc_id", F.aggregate(low, F.lit(128), moved).alias("p"))


@query(f"""WITH {BYTES}, s AS (SELECT d.lang, b.blob_id, CASE WHEN b = 0 THEN 0 ELSE floor(log2(b))::INT + 1 END AS sym, count(*) AS n FROM b JOIN documents d ON d.doc_id = blob_id GROUP BY ALL)
SELECT lang, sym, count(*) AS n_blobs, sum(n)::BIGINT AS total, max(n) AS most FROM s GROUP BY lang, sym""")
def q_f7_byte_class_frequencies(spark, sf_dir):
    df = docs(spark, sf_dir).withColumn("key", F.struct("doc_id", "lang"))
    b = F.col("b")
    each = blobs.bytes_of(df, "key", "text").groupBy("blob_id", F.when(b == 0, 0).otherwise(bits.floor_log2(b) + 1).cast("int").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.col("blob_id.lang").alias("lang"), "sym").agg(F.count(F.lit(1)).alias("n_blobs"), F.sum("n").alias("total"), F.max("n").alias("most"))
