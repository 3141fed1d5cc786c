"""Quality rules with adaptive thresholds.

Per document some integer measures are taken. For every language and source a quantile sketch of each measure is
kept: counts of log-linear buckets (exact to 16, then 16 buckets to each doubling). Such sketches merge by adding
counts, so Spark builds them with partial aggregation, and the sketches of a language or of the whole corpus are
sums of the same rows. A document fails if a measure lies beyond its group's upper fence,
q75 + FENCE * (q75 - q25) + the measure's slack; groups of fewer than MIN_GROUP documents use their language's
fence, and languages of fewer the corpus's. No group's fence lies above its language's, and no language's above the
corpus's, by more than the slack, so that a group of which over a quarter is junk does not set its own measure.

Defined results: null text has no words and so fails the base rules; null languages and sources form groups of
their own; equal rows are judged alike; an empty table gives an empty result. Columns other than those named are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .base import column, map_text, materialize, record, text_buffer
from .words import SPACED, Words, mix, per_row, range_hash, same_bytes, window_valid, windows

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WORDS = 10, 20, 5
#: Per mille of word characters, lines or words, and hundredths of a character: what a group's fence is widened by.
SLACK = {"symbols_pm": 20, "dup_lines_pm": 400, "repeat_pm": 160, "upper_pm": 100, "marks_pm": 40, "word_length": 300}
FENCE, MIN_GROUP = 3, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True


def duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a later copy of an equal key, has an equal key) for each position."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def repeated(buf: np.ndarray, keys: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(is a later copy, has a copy) for each sequence of `size` byte ranges, from the range `first` on, with the
    given hashes, within the rows of the batch. Equal hashes are held against the bytes; a row where they mislead
    is done again by its bytes alone."""
    salted = keys + mix(np.arange(1, int(row.max(initial=0)) + 2, dtype=np.uint64))[row]
    later, any_ = duplicates(salted)
    order = np.flatnonzero(any_)
    order = order[np.argsort(salted[order], kind="stable")]
    same = np.flatnonzero(salted[order][1:] == salted[order][:-1])
    a, b = order[same], order[same + 1]
    right = row[a] == row[b]
    for j in range(size):
        x, y = first[a] + j, first[b] + j
        length = ends[x] - starts[x]
        right &= length == ends[y] - starts[y]
        live = np.flatnonzero(right)
        right[live] = same_bytes(buf, starts[x[live]], buf, starts[y[live]], length[live])
    for r in np.unique(np.concatenate([row[a[~right]], row[b[~right]]])).tolist():
        mine, seen = np.flatnonzero(row == r), {}
        later[mine] = any_[mine] = False
        for k in mine.tolist():
            content = tuple(buf[starts[x] : ends[x]].tobytes() for x in range(first[k], first[k] + size))
            if content in seen:
                later[k] = any_[k] = any_[seen[content]] = True
            seen.setdefault(content, k)
    return later, any_


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks, __lang,
    __source, and with `whole` the row of docs as the struct __row."""
    keep = ["__lang", "__source", *(["__row"] if whole else [])]

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            buf, offs = text_buffer(part.column("__text"))
            n = part.num_rows
            words = Words(buf, offs, SPACED)
            newline = np.flatnonzero(buf == 10)
            starts = np.unique(np.concatenate([offs[:-1], newline + 1]))
            # a line ends at the next newline or where its row ends
            row = np.searchsorted(offs[1:], starts, "right")
            row = np.minimum(row, n - 1)
            lead = np.searchsorted(newline, starts)
            ends = np.minimum(offs[row + 1], np.append(newline, len(buf))[lead])
            full = ends > starts
            starts, ends, row = starts[full], ends[full], row[full]
            worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
            starts, ends, row = starts[worded], ends[worded], row[worded]
            later, _ = repeated(buf, range_hash(buf, starts, ends), row, starts, ends, np.arange(len(starts)), 1)
            n_dup = np.bincount(row[later], minlength=n)
            n_lines = np.bincount(row, minlength=n)
            keys = windows(words.hash, REPEAT_WORDS)
            valid = window_valid(words.counts, len(words.hash), REPEAT_WORDS)
            place = np.flatnonzero(valid)
            _, twice = repeated(buf, keys[place], words.rows()[place], words.starts, words.ends, place, REPEAT_WORDS)
            cover = np.zeros(len(words.hash) + REPEAT_WORDS + 1, np.int64)
            cover[place[twice]] += 1
            cover[place[twice] + REPEAT_WORDS] -= 1
            again = np.cumsum(cover)[: len(words.hash)] > 0
            lead_byte = (buf & 0xC0) != 0x80
            out = {
                "doc_id": (part.column("__id"), None),
                "n_words": (words.counts, pa.int64()),
                "word_chars": (per_row(words.inside & lead_byte, offs), pa.int64()),
                "n_symbols": (per_row(_SYMBOL[buf], offs), pa.int64()),
                "n_dup_lines": (n_dup, pa.int64()),
                "n_repeat_words": (per_row(again, words.doc), pa.int64()),
                "n_lines": (n_lines, pa.int64()),
                "n_upper": (per_row(_UPPER[buf], offs), pa.int64()),
                "n_marks": (per_row(_MARK[buf], offs), pa.int64()),
            }
            for c in keep:
                out[c] = (part.column(c), None)
            return record(**out)

        return work

    chosen = {"__id": column(doc_id), "__text": column(text).cast("string"), "__lang": column(lang), "__source": column(source)}
    if whole:
        chosen["__row"] = F.struct(*map(column, docs.columns))
    chosen = docs.select(*(v.alias(k) for k, v in chosen.items()))
    numbers = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_marks".split()
    schema = StructType([StructField("doc_id", chosen.schema["__id"].dataType), *(StructField(c, LongType()) for c in numbers), *(chosen.schema[c] for c in keep)])
    return map_text(chosen, "__text", kernel, schema)


def ratios(df: DataFrame) -> DataFrame:
    """The adaptive measures, as whole numbers."""
    per = lambda a, b, k: F.when(F.col(b) > 0, F.floor(F.lit(k) * F.col(a) / F.col(b))).otherwise(0).cast("bigint")
    return df.withColumns(
        {
            "symbols_pm": per("n_symbols", "word_chars", 1000),
            "dup_lines_pm": per("n_dup_lines", "n_lines", 1000),
            "repeat_pm": per("n_repeat_words", "n_words", 1000),
            "upper_pm": per("n_upper", "word_chars", 1000),
            "marks_pm": per("n_marks", "word_chars", 1000),
            "word_length": per("word_chars", "n_words", 100),
        }
    )


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, measure, bucket, n): mergeable, of a size that the buckets bound."""
    names = list(SLACK)
    rows = measured.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in names))).alias("x"))
    rows = rows.select("g_lang", "g_source", "x.measure", F.col("x.v").alias("v"))
    rows = rows.withColumn("e", F.greatest(F.length(F.bin("v")) - 5, F.lit(0)))
    rows = rows.withColumn("bucket", F.when(F.col("v") < 16, F.col("v")).otherwise(F.col("e") * 16 + F.expr("shiftright(v, e)")))
    return rows.groupBy("g_lang", "g_source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(merged: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group: its size and a map from measure to fence."""
    w = Window.partitionBy(*keys, "measure").orderBy("bucket")
    total = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("cum", F.sum("n").over(w)).withColumn("size", F.sum("n").over(total))
    # the largest value of a bucket
    top = F.when(F.col("bucket") < 16, F.col("bucket")).otherwise(F.expr("shiftleft(bucket - (cast(floor(bucket / 16) as bigint) - 1) * 16 + 1, cast(floor(bucket / 16) as int) - 1) - 1"))
    ranked = ranked.withColumn("top", top.cast("bigint"))
    q = lambda p: F.min(F.when(F.col("cum") * 100 >= F.col("size") * p, F.col("top")))
    found = ranked.groupBy(*keys, "measure").agg(q(25).alias("q25"), q(75).alias("q75"), F.max("size").alias("size"))
    slack = F.create_map(*(F.lit(x) for kv in SLACK.items() for x in kv))
    fence = F.col("q75") + FENCE * (F.col("q75") - F.col("q25")) + slack[F.col("measure")]
    return found.groupBy(*keys).agg(F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("measure", fence.cast("bigint").alias("fence")))).alias("fences"))


def thresholds(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """g_lang, g_source, fences: a map from measure to the largest value that passes."""
    own = sketches(measured, lang, source)
    add = lambda keys: own.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    groups = _fences(own, ["g_lang", "g_source"])
    langs = _fences(add(["g_lang"]), ["g_lang"]).select(F.col("g_lang").alias("l_lang"), F.col("size").alias("l_size"), F.col("fences").alias("l_fences"))
    all_ = _fences(add([]).withColumn("one", F.lit(1)), ["one"]).select(F.col("fences").alias("a_fences"))
    joined = groups.join(langs, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(all_))  # one row
    fences = {}
    for m, slack in SLACK.items():
        whole = F.col("a_fences")[m]
        lang_ = F.when(F.col("l_size") >= MIN_GROUP, F.least(F.col("l_fences")[m], whole + slack)).otherwise(whole)
        fences[m] = F.when(F.col("size") >= MIN_GROUP, F.least(F.col("fences")[m], lang_ + slack)).otherwise(lang_)
    return joined.select("g_lang", "g_source", F.create_map(*(x for m, v in fences.items() for x in (F.lit(m), v.cast("bigint")))).alias("fences"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the measures of each document, base_failed, and kept.

    The measures (a few numbers a document) go through the shared folder, so that texts are scanned once."""
    measured = materialize(ratios(measure(docs, doc_id, text, lang, source)), "measures")
    return _judged(measured, materialize(thresholds(measured, "__lang", "__source"), "thresholds")).drop("__lang", "__source")


def filtered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names. Texts are scanned twice, and never
    shuffled: once for the thresholds, and once next to them (a row for each language and source)."""
    first = ratios(measure(docs, doc_id, text, lang, source))
    limits = materialize(thresholds(materialize(first, "measures"), "__lang", "__source"), "thresholds")
    judged = _judged(ratios(measure(docs, doc_id, text, lang, source, whole=True)), limits)
    return judged.filter("kept").select(*(F.col("__row")[c].alias(c) for c in docs.columns))


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    on = F.col("__lang").eqNullSafe(F.col("g_lang")) & F.col("__source").eqNullSafe(F.col("g_source"))
    judged = measured.join(limits, on, "left")
    passes = F.lit(True)
    for m in SLACK:
        passes = passes & (F.col(m) <= F.col("fences")[m])
    return judged.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.coalesce(passes, F.lit(True))).drop("fences", "g_lang", "g_source")
