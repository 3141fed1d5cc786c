"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes. The automaton of all items is streamed
over each document; at every word it knows the longest suffix read that occurs in some item. A match of `window`
words or more, or of a whole item that is shorter, is a hit. Only runs of words that all occur in the benchmark are
streamed: any other word sends the automaton back to its root, so nothing is lost. Runs are streamed side by side, a
word of each at a time, in pieces that overlap by `window` - 1 words.

The automaton is a handful of arrays. A benchmark of more than BLOCK_WORDS words makes several, of at most that many
words each (longer items are cut, the pieces overlapping); a task reads them one after the other for every part of
its documents, so its memory holds one, and its time grows in proportion to their number.

Defined results: null or empty text has no words and no hits; an item without words has no window; equal rows are
judged alike, each on its own; an empty benchmark leaves every document clean. Other columns than the id and the text
are carried as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .base import column, map_text, record, text_buffer
from .words import ALNUM, ALNUM_MAP, Lexicon, Words

WINDOW = 10
#: Words of items in one automaton; its arrays take some 100 bytes a word, which bounds what is broadcast.
BLOCK_WORDS = 400_000
#: Words of a run that are streamed as one piece.
PIECE = 128


class _Builder:
    """A generalised suffix automaton while words are added."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


def _lists(of: dict[int, set], states: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by state, and the lists one after the other."""
    sizes = np.zeros(states + 1, np.int64)
    for s, values in of.items():
        sizes[s + 1] = len(values)
    flat = [sorted(of[s]) for s in sorted(of)]
    return np.cumsum(sizes), np.array([v for values in flat for v in values], np.int64)


class Automaton:
    """The automaton of items (lists of words), as arrays; each state's windows know their items."""

    def __init__(self, items: list[list[bytes]], window: int):
        self.window, self.shortest = window, window
        ids: dict[bytes, int] = {}
        made = _Builder()
        for words in items:
            at = 0
            for w in words:
                at = made.extend(at, ids.setdefault(w, len(ids)))
        n = len(made.length)
        self.length, self.link = np.array(made.length, np.int32), np.array(made.link, np.int32)
        self.lexicon = Lexicon(list(ids))
        # transitions, by state and word
        self.width = max(1, len(ids))
        state = np.repeat(np.arange(n), [len(x) for x in made.next])
        key = state * self.width + np.array([c for x in made.next for c in x], np.int64)
        order = np.argsort(key)
        self.key, self.target = key[order], np.array([t for x in made.next for t in x.values()], np.int32)[order]
        # states are split while items are added, so the items are walked again when all are in
        found: dict[int, set] = {}
        short: dict[int, set] = {}
        for k, words in enumerate(items):
            at = 0
            for i, w in enumerate(words):
                at = made.next[at][ids[w]]
                if i + 1 >= window:
                    found.setdefault(self._at(made, at, window), set()).add(k)
            if 0 < len(words) < window:
                short.setdefault(self._at(made, at, len(words)), set()).add(len(words) * len(items) + k)
                self.shortest = min(self.shortest, len(words))
        self.items, self.item_list = _lists(found, n)
        self.short, self.short_list = _lists(short, n)
        self.many = max(1, len(items))
        # from each state, the state of its last `window` words, and the next one up the links with short items
        self.whole, self.up = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            p = made.link[s]
            self.whole[s] = s if made.length[p] < window else self.whole[p]
            self.up[s] = s if s in short else self.up[p]

    @staticmethod
    def _at(made: _Builder, state: int, length: int) -> int:
        """The state of the suffix of that length of what `state` has read."""
        while made.length[made.link[state]] >= length:
            state = made.link[state]
        return state

    def stream(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, matched lengths and items of all hits, by the place of their last word; `doc` are the offsets of
        the rows' words."""
        edge = np.zeros(len(ids) + 1, bool)  # a run of known words begins or ends here
        known = ids >= 0
        edge[1:-1] = known[1:] != known[:-1]
        edge[doc] = edge[0] = edge[-1] = True
        at = np.flatnonzero(edge)
        at, size = at[:-1], np.diff(at)
        use = known[at] & (size >= self.shortest) if len(ids) else np.zeros(0, bool)
        at, size = at[use], size[use]
        # pieces of the runs
        pieces = -(-size // PIECE)
        inner = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        at, size = np.repeat(at, pieces), np.repeat(size, pieces)
        first = np.maximum(inner - self.window + 1, 0)
        start, size = at + first, np.minimum(inner + PIECE, size) - first
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        out = []
        for t, n in enumerate(active.tolist()):
            c = ids[start[:n] + t]
            todo = np.arange(n)
            while len(todo):
                s = state[todo]
                wanted = s * self.width + c[todo]
                place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
                there = self.key[place] == wanted
                go = todo[there]
                state[go] = self.target[place[there]]
                length[go] += 1
                back = todo[~there & (s > 0)]  # the root knows every word of an item
                state[back] = self.link[state[back]]
                length[back] = self.length[state[back]]
                todo = back
            hit = np.flatnonzero(length[:n] >= self.shortest)
            if len(hit):
                out += self._hits(start[hit] + t, state[hit], length[hit])
        return out

    def _hits(self, place: np.ndarray, state: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        full = length >= self.window
        if full.any():
            at = self.whole[state[full]].astype(np.int64)
            n = self.items[at + 1] - self.items[at]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(place[full], n), np.full(n.sum(), self.window), self.item_list[np.repeat(self.items[at], n) + inner]))
        at = self.up[state].astype(np.int64)
        while len(live := np.flatnonzero(at > 0)):
            place, length, at = place[live], length[live], at[live]
            n = self.short[at + 1] - self.short[at]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size, item = np.divmod(self.short_list[np.repeat(self.short[at], n) + inner], self.many)
            fits = size <= np.repeat(length, n)
            out.append((np.repeat(place, n)[fits], size[fits], item[fits]))
            at = self.up[self.link[at]].astype(np.int64)
        return out


def automata(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int):
    """The benchmark in blocks of `block_words` words at most: (ids of the items as strings, automaton)."""
    ids, items, n = [], [], 0
    block_words = max(block_words, 2 * window)
    for row in benchmark.select(column(item_id).cast("string").alias("i"), column(text).cast("string").alias("t")).toLocalIterator():
        buf, offs = text_buffer(pa.array([row.t], pa.string()))
        w, low = Words(buf, offs, ALNUM, hashed=False), ALNUM_MAP[buf].tobytes()
        words = [low[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist())]
        for k in range(0, max(1, len(words) - window + 1), block_words - window + 1):
            part = words[k : k + block_words]
            if items and n + len(part) > block_words:
                yield ids, Automaton(items, window)
                ids, items, n = [], [], 0
            items.append(part)
            ids.append(row.i or "")
            n += len(part)
    if n:
        yield ids, Automaton(items, window)


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, cleaned: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (ids as strings) and with `cleaned` the text without
    its hit spans, and the row of docs as the struct __row."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in automata(benchmark, item_id, item_text, window, block_words)]
    many = len(blocks) > 1

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            n = part.num_rows
            buf, offs = text_buffer(part.column("__text"))
            words = Words(buf, offs, ALNUM, ALNUM_MAP)
            hit = np.zeros(len(words.starts) + 1, np.int64)
            found: list[set[str]] = [set() for _ in range(n)]
            low = ALNUM_MAP[buf]
            for b in blocks:
                names, auto = b.value
                for place, size, item in auto.stream(auto.lexicon.find(words, low), words.doc):
                    np.add.at(hit, place + 1 - size, 1)
                    np.add.at(hit, place + 1, -1)
                    row = np.searchsorted(words.doc, place, "right") - 1
                    for r, k in {*zip(row.tolist(), item.tolist())}:
                        found[r].add(names[k])
                if many:  # arrays are read again in no time
                    b.__dict__.pop("_value", None)
            covered = np.cumsum(hit[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(covered)])
            n_hit = sums[words.doc[1:]] - sums[words.doc[:-1]]
            out = {"doc_id": (part.column("__id"), None), "n_words": (words.counts, pa.int64()), "n_hit": (n_hit, pa.int64()), "items": ([sorted(f) for f in found], pa.list_(pa.string()))}
            if cleaned:
                texts = part.column("__text").to_pylist()
                for r in np.flatnonzero(n_hit).tolist():
                    raw, pieces, done = buf[offs[r] : offs[r + 1]].tobytes(), [], 0
                    mine = np.flatnonzero(covered[words.doc[r] : words.doc[r + 1]]) + words.doc[r]
                    for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
                        pieces.append(raw[done : words.starts[run[0]] - offs[r]])
                        done = words.ends[run[-1]] - offs[r]
                    texts[r] = b"".join([*pieces, raw[done:]]).decode("utf-8", "replace")
                out["cleaned"] = (texts, pa.string())
                out["__row"] = (part.column("__row"), None)
            return record(**out)

        return work

    chosen = [column(doc_id).alias("__id"), column(text).cast("string").alias("__text")]
    rows = docs.select(*chosen, *([F.struct(*map(column, docs.columns)).alias("__row")] if cleaned else []))
    fields = [StructField("doc_id", rows.schema["__id"].dataType), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))]
    return map_text(rows, "__text", kernel, StructType(fields + ([StructField("cleaned", StringType()), rows.schema["__row"]] if cleaned else [])))


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = scan(docs, benchmark, **how)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """docs without the spans that occur in the benchmark. A document with more than `max_coverage` of its words
    in such spans goes; the others keep all their columns, with the text cut and `n_chars` counted again."""
    found = scan(docs, benchmark, doc_id=doc_id, text=text, cleaned=True, **how)
    kept = found.filter(F.col("n_hit") <= max_coverage * F.col("n_words"))
    columns = {c: F.col("__row")[c] for c in docs.columns}
    if n_chars in columns:
        length = F.length("cleaned").cast(docs.schema[n_chars].dataType)
        columns[n_chars] = F.when(F.col("n_hit") > 0, length).otherwise(columns[n_chars])
    columns[text] = F.when(F.col("n_hit") > 0, F.col("cleaned").cast(docs.schema[text].dataType)).otherwise(columns[text])
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
