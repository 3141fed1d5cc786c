"""Main text of web pages by gradient-boosted trees over DOM nodes.

A model gives every block element the probability that its subtree holds main text. Decoding picks the most likely
labels in which an element is kept only if its parent is (a two-state dynamic program from the leaves up), so that
no kept text stands in a dropped element. The text runs of kept elements, in page order, are the result.

The model is trained here, on TRAIN_PAGES generated pages of many layouts (a fixed seed; no table is read), and is
small enough to travel with the tasks. Defined results: null, empty or textless html gives an empty text; malformed
and cut html is read as far as it goes; equal rows are treated alike; an empty table gives an empty result. Only the
id, url and html columns are read.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_text, record
from .dom import Page, features

TRAIN_PAGES, TREES, DEPTH, RATE, BINS = 400, 40, 4, 0.3, 32


# --- generated pages ---------------------------------------------------------------------------------------------
def _words(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        w = "".join(r.choice(("an", "be", "co", "di", "er", "fo", "gu", "in", "lo", "mé", "no", "or", "pe", "re", "st", "tion", "un", "ve", "th", "a")) for _ in range(r.randint(1, 4)))
        out.append(w + r.choice(("", "", "", "", "", ",", ".")))
    return " ".join(out).capitalize()


def _paragraph(r: random.Random) -> str:
    return _words(r, r.choice((1, 2, 3, r.randint(3, 12), r.randint(15, 60), r.randint(40, 160)))) + "."


def _boiler(r: random.Random, kind: str) -> str:
    """Boilerplate; data-k="0" marks the element, and so all within it, for training."""
    items = lambda n: "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(n))
    short = lambda: _words(r, r.randint(2, 30))
    pick = r.choice
    if kind == "nav":
        inner = f"<ul>{items(r.randint(3, 9))}</ul>"
        return pick((f'<nav data-k="0">{inner}</nav>', f'<div data-k="0" class="{pick(("menu", "navbar", "nav main-nav", "breadcrumbs"))}">{inner}</div>', f'<ul data-k="0" id="menu">{items(6)}</ul>'))
    if kind == "header":
        return pick((f'<header data-k="0"><div>{short()}</div></header>', f'<div data-k="0" class="{pick(("header", "masthead", "site-header top"))}"><p>{short()}</p></div>', f'<header data-k="0"><h1>{_words(r, 2)}</h1><p>{short()}</p></header>'))
    if kind == "footer":
        said = pick(("&copy; example.com &middot; ", "Copyright 2020 ", "", "All rights reserved. ")) + short()
        return pick((f'<footer data-k="0">{said}</footer>', f'<footer data-k="0"><p>{said}</p><ul>{items(3)}</ul></footer>', f'<div data-k="0" id="footer"><p>{said}</p></div>'))
    if kind == "side":
        body = pick((f"<h3>{_words(r, 2)}</h3><ul>{items(r.randint(2, 8))}</ul>", f"<p>{short()}</p>", f"<h2>{_words(r, 2)}</h2><p>{_paragraph(r)}</p>"))
        return pick((f'<aside data-k="0">{body}</aside>', f'<div data-k="0" class="{pick(("sidebar", "widget", "related", "more-stories", "side-bar rail"))}">{body}</div>'))
    if kind == "ad":
        return f'<div data-k="0" class="{pick(("ad", "ads", "advert", "sponsored", "promo-box", "ad-banner"))}">{pick((short(), f"<p>{short()}</p>", f"<p>{_paragraph(r)}</p>"))}</div>'
    if kind == "notice":
        return f'<div data-k="0" {pick(("class", "id"))}="{pick(("cookie-notice", "cookies", "consent", "newsletter", "alert notice", "popup"))}">{pick((short(), f"<p>{short()}</p><button>OK</button>"))}</div>'
    if kind == "comments":
        said = "".join(f'<div class="comment"><p>{_paragraph(r)}</p></div>' for _ in range(r.randint(1, 5)))
        return pick((f'<section data-k="0" id="comments"><h2>{_words(r, 1)}</h2>{said}</section>', f'<div data-k="0" class="comments">{said}</div>', f'<div data-k="0" class="discussion reader-replies"><ol><li><p>{_paragraph(r)}</p></li></ol></div>'))
    return pick((f'<form data-k="0"><label>{_words(r, 1)}</label><input name="q"><button>{_words(r, 1)}</button></form>', f'<div data-k="0" class="share social"><ul>{items(3)}</ul></div>', f'<form data-k="0" class="search"><p>{short()}</p></form>'))


def generated(r: random.Random) -> str:
    """A page; elements of main text have data-k="1"."""
    def block() -> str:
        kind = r.random()
        if kind < 0.72:
            p = _paragraph(r)
            return r.choice((f'<p data-k="1">{p}</p>', f'<p data-k="1">{p} <a href="/x">{_words(r, 2)}</a> {_words(r, 8)}</p>', f'<p data-k="1"><b>{_words(r, r.randint(1, 9))}<br>'))
        if kind < 0.82:
            return f'<h2 data-k="1">{_words(r, r.randint(1, 6))}</h2>'
        if kind < 0.88:
            return '<ul data-k="1">' + "".join(f'<li data-k="1">{_words(r, r.randint(3, 25))}</li>' for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f'<blockquote data-k="1"><p data-k="1">{_paragraph(r)}</p></blockquote>'
        if kind < 0.95:
            return '<table data-k="1">' + "".join(f'<tr data-k="1"><td data-k="1">{_words(r, 2)}</td><td data-k="1">{_words(r, 4)}</td></tr>' for _ in range(3)) + "</table>"
        return f'<div data-k="1"><p data-k="1">{_paragraph(r)}</p></div>'

    if r.random() < 0.08:  # hardly any markup: text and line ends in one element, or in the body itself
        text = r.choice(("<br>", "<br><br>", " ")).join(r.choice(("{}", "<span>{}</span>")).format(_paragraph(r)) for _ in range(r.choice((1, 2, 4, 9))))
        around = [_boiler(r, k) if r.random() < 0.3 else "" for k in ("nav", "footer")]
        if r.random() < 0.5:
            return f'<html><body data-k="1">{around[0]}{text}{around[1]}</body></html>'
        return f'<html><body>{around[0]}<div data-k="1">{text}</div>{around[1]}</body></html>'
    inner = [block() for _ in range(r.choice((1, 2, 3, 6, 12, 25)))]
    for kind in ("ad", "form", "side", "notice"):
        if r.random() < 0.12:
            inner.insert(r.randint(0, len(inner)), _boiler(r, kind))
    title = f'<h1 data-k="1">{_words(r, r.randint(1, 10))}</h1>' if r.random() < 0.85 else ""
    tail = _boiler(r, "comments") if r.random() < 0.15 else ""
    body = title + "".join(inner) + tail
    layout = r.random()
    if layout < 0.45:
        body = f'<article data-k="1">{body}</article>'
    elif layout < 0.6:
        body = f'<main data-k="1">{body}</main>'
    elif layout < 0.75:
        body = f'<div data-k="1" class="{r.choice(("content", "post", "entry-content", "main article-body", "story"))}">{body}</div>'
    elif layout < 0.85:
        body = f'<div data-k="1"><article data-k="1" class="post">{body}</article></div>'
    elif layout < 0.93:
        body = f'<div data-k="1" id="{r.choice(("main", "content", "text"))}"><section data-k="1">{body}</section></div>'
    else:
        body = f'<div data-k="1">{body}</div>'
    before = [_boiler(r, k) for k in ("header", "nav", "notice", "ad", "form", "side") if r.random() < (0.75 if k == "nav" else 0.4)]
    after = [_boiler(r, k) for k in ("side", "comments", "ad", "form", "footer", "notice") if r.random() < (0.8 if k == "footer" else 0.3)]
    if r.random() < 0.03:
        body = ""
    page = "".join(before) + body + "".join(after)
    if r.random() < 0.25:
        page = f'<div class="{r.choice(("page", "wrapper", "container"))}">{page}</div>'
    return f"<html><head><title>{_words(r, 4)}</title></head><body>{page}</body></html>"


def training_set(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all nodes of generated pages. An element is 1 if it or what it holds is main text."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        marked = generated(r)
        # the marks become attribute words that the features don't know, and are read back from the tree
        page = Page(marked.replace('data-k="0"', 'itemprop="kzero"').replace('data-k="1"', 'itemprop="kone"'))
        label = np.zeros(len(page.tags), bool)
        dead = np.zeros(len(page.tags), bool)
        for i in range(1, len(page.tags)):
            dead[i] = dead[page.parent[i]] or "kzero" in page.words[i]
            label[i] = "kone" in page.words[i] and not dead[i]
        for i in range(len(page.tags) - 1, 0, -1):
            label[page.parent[i]] |= label[i]
        xs.append(features(page))
        ys.append(label)
    return np.concatenate(xs), np.concatenate(ys)


# --- gradient boosting -------------------------------------------------------------------------------------------
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Newton boosting of the logistic loss, with histograms of BINS quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # bin b: value <= cuts[b]
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    score = np.full(n, base)
    features_, thresholds, leaves = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for d in range(DEPTH):
            first, count = 2**d - 1, 2**d
            best, chosen = np.full(count, 1e-6), [(0, np.inf, BINS)] * count
            for j in range(width):
                if not len(cuts[j]):
                    continue
                cell = (at - first) * (BINS + 1) + binned[:, j]
                gs = np.bincount(cell, g, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                hs = np.bincount(cell, h, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[:, len(cuts[j]) :] = 0
                b = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(count), b] > best).tolist():
                    best[k], chosen[k] = gain[k, b[k]], (j, cuts[j][b[k]], int(b[k]))
            goes = np.zeros(n, np.int64)
            for k, (j, cut, b) in enumerate(chosen):
                f[first + k], t[first + k] = j, cut
                mine = at == first + k
                goes[mine] = binned[mine, j] > b if np.isfinite(cut) else 0
            at = 2 * at + 1 + goes
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[leaf]
        features_.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Trees(np.array(features_), np.array(thresholds), np.array(leaves), base)


@cache
def model() -> Trees:
    return fit(*training_set(TRAIN_PAGES, 1))


def kept_nodes(page: Page, logit: np.ndarray) -> list[bool]:
    """The most likely labels in which no node is kept under a dropped one; the root is kept."""
    n = len(page.tags)
    keep = (-np.logaddexp(0, -logit)).tolist()
    drop = (-np.logaddexp(0, logit)).tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] and keep[i] > drop[i]
    return out


def main_text(page: Page, logit: np.ndarray) -> str:
    kept = kept_nodes(page, logit)
    return "\n\n".join(text for node, text, _ in page.runs if kept[node])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    trees = model()

    def kernel():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            read = [Page(h or "") for h in part.column("__html").to_pylist()]
            made = [features(p) for p in read]
            ends = np.cumsum([len(m) for m in made])
            logits = np.split(trees.logit(np.concatenate(made)), ends[:-1])
            texts = [main_text(p, v) for p, v in zip(read, logits)]
            return record(page_id=(part.column("__id"), None), url=(part.column("__url"), None), text=(texts, pa.string()), n_chars=([len(t) for t in texts], pa.int64()))

        return work

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    chosen = pages.select(F.col(page_id).alias("__id"), F.col(url).alias("__url"), F.col(source).cast("string").alias("__html"))
    return map_text(chosen, "__html", kernel, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint")
