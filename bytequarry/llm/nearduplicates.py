"""Near duplicates by Order MinHash.

A document is the sequence of its 5-word shingles (words: lower-cased runs of ASCII letters, digits and non-ASCII
bytes; a text of fewer words is one shingle), each labelled with its number of occurrence. A sketch takes the
ORDER smallest labelled shingles of a random order and keeps them in text order; SKETCHES of them are taken, and
documents that agree in one are candidates. Two long documents of similarity 0.8 share a sketch with probability
0.8 ** ORDER, so all SKETCHES are missed once in some forty thousand pairs. Of few shingles the smallest are more
often different, so texts of SHORT shingles at most are compared exactly with each other, whatever their sketches.

Documents with equal words are one class from the start, and only its first goes on. In every bucket the members
are compared with a centre, the one that meets most others in its own buckets; members that fail are compared with
the next best in the next round, and then with the best among themselves: a row per member and round, which joins
most families. Members of a bucket that still lie in different classes are compared exactly, by an inverted index of
their rarest labelled shingles: two sequences of similarity s share one of the n - ceil(s n) + 1 rarest of either.
A candidate is verified by banded alignment: the longest chain of equal labelled shingles that rises in both texts
within a band that holds every pair of enough similarity; chain / (both lengths - chain) must be SIMILARITY or more.
Links are joined to classes as connected components.

Defined results: a null text is a class of its own; texts without words are copies if they are equal; equal rows
are copies; the class is named by its smallest document id (nulls last); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import column, join_heavy, map_text, materialize, record, released, text_buffer, tune, with_row_id
from .graph import components
from .quality import duplicates
from .words import _ODD, ALNUM, ALNUM_MAP, Words, mix, window_valid, windows

SHINGLE, SIMILARITY = 5, 0.8
ORDER, SKETCHES = 4, 20
SHORT = 30
#: Rounds of centres; what they leave is compared exactly, so their number tells on time, not on results.
ROUNDS = 4
#: Texts of one rare shingle that meet in a task at once.
BLOCK = 500
_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of all labelled shingles in text order, the offsets of each row's, and the words."""
    n = len(offs) - 1
    words = Words(buf, offs, ALNUM, ALNUM_MAP)
    counts = words.counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint64)
    long = np.flatnonzero(counts >= SHINGLE)
    if len(long):
        keys = windows(words.hash, SHINGLE)[window_valid(counts, len(words.hash), SHINGLE)]
        place = np.ones(at[-1], bool)
        place[at[:-1][(counts > 0) & (counts < SHINGLE)]] = False
        out[place] = keys
    for r in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        w = words.hash[words.doc[r] : words.doc[r + 1]]
        out[at[r]] = windows(w, len(w))[0] ^ np.uint64(len(w))
    rows = np.repeat(np.arange(n), sizes)
    salted = out + mix(np.arange(1, n + 1, dtype=np.uint64))[rows]
    _, again = duplicates(salted)
    label = np.zeros(len(out), np.uint64)
    twice = np.flatnonzero(again)
    if len(twice):  # number of occurrence among equal ones
        order = twice[np.argsort(salted[twice], kind="stable")]
        ranked = salted[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        label[order] = np.arange(len(order)) - first
    return mix(out + label * np.uint64(0xA0761D6478BD642F)), at, words


def sketch(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SKETCHES hashes for each document; zeros where it has no shingles."""
    n, sizes = len(at) - 1, np.diff(at)
    out = np.zeros((n, SKETCHES), np.uint64)
    rows = np.repeat(np.arange(n), sizes)
    some = np.flatnonzero(sizes)
    # about 24 values of a document are below its threshold; documents where too few are get none
    level = np.full(n, _TOP)
    big = sizes > 24
    level[big] = (2.0**64 * 24 / sizes[big]).astype(np.uint64)
    limit = level[rows]
    weights = np.multiply.accumulate(np.full(ORDER, _ODD, np.uint64))
    need = np.minimum(sizes, ORDER)
    for s in range(SKETCHES):
        values = shingles * _MULTIPLIERS[s]
        low = np.flatnonzero(values <= limit)
        short = np.flatnonzero(np.bincount(rows[low], minlength=n) < need)
        if len(short):
            low = np.union1d(low, np.concatenate([np.arange(at[r], at[r + 1]) for r in short.tolist()]))
        r, v = rows[low], values[low]
        order = np.lexsort((v, r))
        begin = np.searchsorted(r, np.arange(n))  # r is sorted, with the places
        rank = np.arange(len(low)) - begin[r[order]]
        chosen = np.sort(low[order[rank < ORDER]])  # back in text order
        r = rows[chosen]
        begin = np.searchsorted(r, some)
        rank = np.arange(len(chosen)) - np.repeat(begin, np.diff(np.append(begin, len(chosen))))
        out[some, s] = mix(np.add.reduceat(shingles[chosen] * weights[rank], begin) + np.uint64(s)) if len(some) else 0
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sequences of labelled shingles by banded alignment; 0 where it can't reach SIMILARITY."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < SIMILARITY * max(na, nb):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = int((1 - SIMILARITY) / (1 + SIMILARITY) * (na + nb)) + 1
    near = np.abs(ia - ib) <= band
    order = np.argsort(ia[near])
    chain = ib[near][order]
    if len(chain) < SIMILARITY * (na + nb - len(chain)):
        return 0.0
    if np.all(chain[1:] > chain[:-1]):
        length = len(chain)
    else:
        tails: list[int] = []
        for x in chain.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        length = len(tails)
    return length / (na + nb - length)


def _digests(buf: np.ndarray, offs: np.ndarray, words: Words, rids: pa.Array, valid: pa.Array) -> np.ndarray:
    """BLAKE2 digests of 128 bits, as two numbers: of a text's words, of its bytes if it has none, or of its row id
    if it is null."""
    joined = words.starts[1:] > words.ends[:-1]  # a space stands for what divides two words of one text
    joined[words.doc[1:-1][(words.doc[1:-1] > 0) & (words.doc[1:-1] < len(words.starts))] - 1] = False
    space = words.ends[:-1][joined]
    low, keep = ALNUM_MAP[buf], words.inside.copy()
    low[space], keep[space] = 32, True
    sums = np.concatenate([[0], np.cumsum(keep)])[offs].tolist()
    low, raw, at, out = low[keep].tobytes(), buf.tobytes(), offs.tolist(), []
    for r, (n, there, rid) in enumerate(zip(words.counts.tolist(), valid.to_pylist(), rids.to_pylist())):
        content, kind = (low[sums[r] : sums[r + 1]], b"words") if n else (raw[at[r] : at[r + 1]], b"bytes") if there else (str(rid).encode(), b"null")
        out.append(hashlib.blake2b(content, digest_size=16, person=kind).digest())
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2).T


def _sketches(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """__rid, id, two hashes of the words (of the bytes, if there are none), number of shingles, sketches."""

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offs = text_buffer(part.column("__text"))
            shingles, at, words = labelled_shingles(buf, offs)
            n = part.num_rows
            keys = sketch(shingles, at)
            e1, e2 = _digests(buf, offs, words, part.column("__rid"), part.column("__text").is_valid())
            sizes = np.diff(at)
            some = sizes > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, SKETCHES, 0))]), pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
            return record(__rid=(part.column("__rid"), None), __id=(part.column("__id"), None), e1=(e1, pa.int64()), e2=(e2, pa.int64()), n=(sizes, pa.int32()), keys=(lists, None))

        return work

    kind = rows.schema[doc_id].dataType.simpleString()
    chosen = rows.select("__rid", F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    return map_text(chosen, "__text", kernel, f"__rid bigint, __id {kind}, e1 bigint, e2 bigint, n int, keys array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of row ids those that the alignment confirms."""
    one = texts.select(F.col("__rid").alias("a"), F.col("__text").alias("ta"))
    two = texts.select(F.col("__rid").alias("b"), F.col("__text").alias("tb"))

    def run(batches):
        for batch in batches:
            step = 200
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                sa, oa, _ = labelled_shingles(*text_buffer(part.column("ta")))
                sb, ob, _ = labelled_shingles(*text_buffer(part.column("tb")))
                good = [aligned(sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]) >= SIMILARITY for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(released(run), "a bigint, b bigint")


def _shingled(texts: DataFrame) -> DataFrame:
    """a, n, h: a row for each labelled shingle of a text, and their number."""

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            shingles, at, _ = labelled_shingles(*text_buffer(part.column("__text")))
            sizes = np.diff(at)
            ids = part.column("__rid").to_numpy()
            return record(a=(np.repeat(ids, sizes), pa.int64()), n=(np.repeat(sizes, sizes), pa.int32()), h=(shingles.view(np.int64), pa.int64()))

        return work

    return map_text(texts.select("__rid", "__text"), "__text", kernel, "a bigint, n int, h bigint")


def _open(entries: DataFrame, joined: DataFrame, total: int) -> DataFrame:
    """a, c (its class so far) of the members of buckets that hold several classes; two members have met already."""
    marked = materialize(entries.join(joined, F.col("a") == F.col("node"), "left").select("a", "key", F.coalesce("root", "a").alias("c")), "marked")
    mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi and size > 2")
    return join_heavy(marked, mixed.select("key", "size"), ["key"], "size", total).select("a", "c").distinct()


def _partners(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (a, c) of different classes c, with all of those of enough similarity."""
    labelled = materialize(_shingled(texts.join(members.select("a"), F.col("__rid") == F.col("a"), "left_semi")), "shingles")
    held = labelled.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.count(F.lit(1)).alias("size")).filter("f > 1")
    own = Window.partitionBy("a")
    # the rarest first; those of one text only come before all others, and meet nothing
    held = join_heavy(labelled, held, ["h"], "size", labelled.count()).select("a", "n", "h", (F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "h"))).alias("at"))
    held = held.filter(F.col("at") <= F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-6) + 1)
    held = held.join(members.select(F.col("a").alias("m"), "c"), F.col("a") == F.col("m")).select("a", "n", "h", "at", "c")
    held = materialize(held, "rarest")
    # a shingle of many texts is cut into blocks, and every two blocks meet under a key of their own
    open_ = held.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi")
    open_ = open_.select(F.col("h").alias("k"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    one = held.join(open_, F.col("h") == F.col("k")).drop("k").withColumn("u", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    two = one.withColumn("v2", every).select("v2", *(F.col(x).alias(f"{x}2") for x in ("a", "n", "h", "at", "c", "u")))
    one = one.withColumn("v", every)
    met = one.join(two, (F.col("h") == F.col("h2")) & (F.col("u") == F.col("v2")) & (F.col("v") == F.col("u2")) & (F.col("c") < F.col("c2")))
    # the first shingle that both have leaves room for the others that they must share
    met = met.filter(F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1 >= SIMILARITY / (1 + SIMILARITY) * (F.col("n") + F.col("n2")) - 1e-6)
    met = met.filter(F.least("n", "n2") >= SIMILARITY * F.greatest("n", "n2"))
    return met.select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b")).distinct()


def classes(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """__rid, doc_id, class_id, first (is it the first of its class) for each of the rows, which have __rid."""
    tune(rows.sparkSession)
    known = materialize(_sketches(rows, doc_id, text), "sketches")
    copies = materialize(known.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*[F.col("__id").isNull().alias("null"), "__id", "__rid", "n", "keys"])).alias("r")).select("e1", "e2", "copies", F.col("r.__rid").alias("rep"), F.col("r.__id").alias("rep_id"), F.col("r.n").alias("n"), F.col("r.keys").alias("keys")), "classes-of-copies")
    entries = copies.select(F.col("rep").alias("a"), "n", F.explode("keys").alias("key"))
    total = entries.count()
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("n_key", F.col("size"))
    entries = materialize(join_heavy(entries, met, ["key"], "n_key", total), "buckets")
    score = entries.groupBy("a").agg(F.sum("size").alias("score")).withColumnRenamed("a", "s")
    entries = entries.join(score, F.col("a") == F.col("s")).select("a", "n", "key", "score", "size")
    short = copies.filter(F.col("n").between(1, SHORT)).select(F.col("rep").alias("a"))
    texts = rows.select("__rid", F.col(text).cast("string").alias("__text")).join(entries.select("a").union(short).distinct(), F.col("__rid") == F.col("a"), "left_semi")
    texts = materialize(texts, "candidates")
    entries = materialize(entries, "bucket-members")
    links, tried, centres, left = None, None, None, entries
    for r in range(rounds):
        # the next centre is the best member that was none yet; in the last rounds, the best that is left
        pool = entries.join(centres, (F.col("key") == F.col("ck")) & (F.col("a") == F.col("cb")), "left_anti") if 0 < r < rounds - 2 else left
        centre = pool.groupBy("key").agg(F.max(F.struct("score", "a", "n")).alias("c"), F.max("size").alias("held")).select("key", F.col("c.a").alias("b"), F.col("c.n").alias("nb"), "held")
        centre = materialize(centre, "centres")
        against = materialize(join_heavy(left, centre, ["key"], "held", total).select("a", "b", "n", "nb", "key", "score", "size"), "against")
        led = against.select(F.col("key").alias("ck"), F.col("b").alias("cb")).distinct()
        centres = led if centres is None else centres.union(led)
        pairs = against.filter((F.col("a") != F.col("b")) & (F.least("n", "nb") >= SIMILARITY * F.greatest("n", "nb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        found = materialize(_verified(fresh, texts), "links")
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        near = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
        near = near.union(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
        left = against.filter("a <> b").join(near, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti").select("a", "n", "key", "score", "size")
        left = materialize(left, "left")
        if left.isEmpty():
            break
    joined = components(links, "a", "b")
    short = short.join(joined, F.col("a") == F.col("node"), "left").select("a", F.coalesce("root", "a").alias("c"))
    members = materialize(_open(entries, joined, total).union(short).distinct(), "open")
    if not members.isEmpty():
        pairs = materialize(_partners(texts, members).join(tried, ["a", "b"], "left_anti"), "partners")
        joined = components(links.union(materialize(_verified(pairs, texts), "links")), "a", "b")
    members = copies.select("e1", "e2", "copies", "rep", "rep_id").join(joined, F.col("rep") == F.col("node"), "left")
    members = materialize(members.select("e1", "e2", "copies", F.coalesce("root", "rep").alias("root"), "rep", "rep_id"), "members")
    order = F.struct(F.col("rep_id").isNull().alias("null"), F.col("rep_id"), F.col("rep"))
    named = members.groupBy("root").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("size"))
    members = join_heavy(members, named, ["root"], "size", members.count()).select("e1", "e2", "copies", F.col("head.rep_id").alias("class_id"), F.col("head.rep").alias("head_rid"))
    out = join_heavy(known.select("__rid", "__id", "e1", "e2"), materialize(members, "named"), ["e1", "e2"], "copies", known.count())
    return out.select("__rid", F.col("__id").alias("doc_id"), "class_id", (F.col("__rid") == F.col("head_rid")).alias("first"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, first for each document."""
    return classes(with_row_id(docs.select("doc_id", "text"))).select("doc_id", "class_id", "first")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, the first by id."""
    rows = with_row_id(docs.select(column(doc_id).alias("__doc"), column(text).alias("__body"), F.struct(*map(column, docs.columns)).alias("__row")))
    drop = classes(rows.select("__rid", F.col("__doc").alias("doc_id"), F.col("__body").alias("text"))).filter(~F.col("first")).select(F.col("__rid").alias("__drop"))
    left = rows.join(materialize(drop, "dropped"), F.col("__rid") == F.col("__drop"), "left_anti")
    return left.select(*(F.col("__row")[c].alias(c) for c in docs.columns))
