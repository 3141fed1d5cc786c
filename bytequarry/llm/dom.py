"""A small HTML tree of block elements, and the features of its nodes.

Only what text extraction needs is kept: block-level elements with their attribute words and the runs of text that
stand directly in them; of inline elements only links are told apart. Ends of p, li, dt, dd, td, th, tr and option are implied as in HTML; scripts, styles and the
head have no text; a tag that the page's end cuts off is dropped."""

from __future__ import annotations

import html
import re

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(/?)>|<[a-zA-Z][^>]*\Z|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes the open elements named here, up to the scope's border.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDS_P = BLOCKS - {"option", "button", "label", "body", "html", "tbody", "tr", "td", "th", "thead", "tfoot", "caption", "legend", "select"} | {"hr"}

GROUPS = {
    "main": "article content main post entry story body text blog page news".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc pager pagination skip".split(),
    "frame": "header footer masthead banner top bottom copyright legal colophon".split(),
    "side": "sidebar side aside related widget recommended popular trending rail more tags".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner".split(),
    "notice": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe signup paywall dialog".split(),
    "talk": "comment comments discussion reply replies respond disqus reader readers".split(),
    "form": "form search login share social buttons button toolbar".split(),
    "hidden": "hidden none invisible".split(),
}
KINDS = [("article", "main"), ("section",), ("div", "center", "body", "html"), ("p", "pre", "blockquote"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "select", "option", "button", "label", "legend"), ("table", "tbody", "thead", "tr", "td", "th"), ("figure", "figcaption", "details", "summary", "address", "dialog")]
_KIND = {t: k for k, ts in enumerate(KINDS) for t in ts}
_GROUP = {w: k for k, ws in enumerate(GROUPS.values()) for w in ws}
_WARN = frozenset(("nav", "header", "footer", "aside", "form", "dialog", "button", "select", "label"))


class Page:
    """Nodes in page order: tag, parent, words of attributes, and text runs (order, node, text, characters in links)."""

    __slots__ = ("tags", "parent", "words", "runs")

    def __init__(self, source: str):
        self.tags, self.parent, self.words, self.runs = ["html"], [-1], [()], []
        self._read(source)

    def _read(self, source: str) -> None:
        # open blocks and links with their nodes (a link has that of its block), and the places of each tag in there
        stack: list[tuple[str, int]] = [("html", 0)]
        places: dict[str, list[int]] = {"html": [0]}
        pieces: list[str] = []
        linked = at = 0
        node, in_head, size = 0, False, len(source)
        links = places.setdefault("a", [])

        def flush():
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                self.runs.append((node, text, min(linked, len(text))))
            pieces.clear()
            linked = 0

        def put(text):
            nonlocal linked
            if text and not in_head:
                if "&" in text:
                    text = html.unescape(text)
                pieces.append(text)
                if links:
                    linked += len(text)

        def push(tag, of):
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, of))

        def cut(to):
            while len(stack) > to:
                places[stack.pop()[0]].pop()

        def last(tags):
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close(names, border):
            """Ends the elements of these names within the border; a row also ends the cell around it."""
            while (k := last(names)) > last(border):
                cut(k)

        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                put(source[at:])
                break
            put(source[at : m.start()])
            at = m.end()
            end, start = m[1], m[2] or m[5]
            if start:
                tag, attrs = start.lower(), m[3] or m[6] or ""
                if tag in RAW:
                    if tag == "svg" and (m[4] or attrs.rstrip().endswith("/")):
                        continue
                    ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = ending.end() if ending else size
                    continue
                if tag == "head":
                    in_head = True
                    continue
                if tag == "br" or tag == "img" or tag == "input":
                    put(" ")
                if tag in VOID:
                    if tag == "hr":
                        flush()
                    continue
                if tag == "body":
                    in_head = False
                if tag == "html":
                    continue
                if tag not in BLOCKS:
                    if tag == "a":
                        push(tag, node)
                    continue
                in_head = False
                flush()
                if tag in ENDS_P:
                    close(("p",), ("button", "td", "th", "table"))
                if tag in CLOSES:
                    close(*CLOSES[tag])
                parent = stack[-1][1]
                node = len(self.tags)
                self.tags.append(tag)
                self.parent.append(parent)
                words: tuple = ()
                if attrs:
                    found = []
                    for a in _ATTR.finditer(attrs):
                        value = (a[2] or a[3] or a[4] or "").lower()
                        found += [a[1].lower()] if a[1].lower() == "hidden" else _PART.findall(value) if a[1].lower() != "style" or "none" in value or "hidden" in value else []
                    words = tuple(found)
                self.words.append(words)
                push(tag, node)
            elif end:
                tag = end.lower()
                if tag == "head":
                    in_head = False
                elif tag == "a":
                    if stack[-1][0] == "a":
                        cut(len(stack) - 1)
                elif tag in BLOCKS and (k := last((tag,))):
                    flush()
                    cut(k)
                    node = stack[-1][1]
        flush()


N_FEATURES = len(KINDS) + 2 * len(GROUPS) + 18


def features(page: Page) -> np.ndarray:
    """A row of numbers for each node."""
    n = len(page.tags)
    kinds = [_KIND.get(t, 2) for t in page.tags]
    own = [0] * n
    chars, linked, marks, blocks, tags, heads, caps = ([0] * n for _ in range(7))
    for node, text, link in page.runs:
        k = len(text)
        own[node] += k
        chars[node] += k
        linked[node] += link
        marks[node] += text.count(". ") + text.count(", ") + text.count("; ") + (text[-1] in ".!?:")
        caps[node] += text.count("©") + text.count("|")
        blocks[node] += 1
    depth, index, children = [0] * n, [0] * n, [0] * n
    warned = [0] * n  # elements of a frame around the node
    group = np.zeros((n, 2 * len(GROUPS)), np.float32)
    parents = page.parent
    twins: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        index[i] = children[p]
        children[p] += 1
        key = (p, page.tags[i])
        twins[key] = twins.get(key, 0) + 1
        warned[i] = warned[p] + (page.tags[i] in _WARN)
        half = len(GROUPS)
        group[i, half:] = group[p, half:] + group[p, :half]
        for w in page.words[i]:
            g = _GROUP.get(w)
            if g is not None:
                group[i, g] += 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        blocks[p] += blocks[i]
        caps[p] += caps[i]
        tags[p] += tags[i] + 1
        heads[p] += heads[i] + (page.tags[i] == "h1")
    f = lambda x: np.asarray(x, np.float32)
    chars_, linked_, marks_, blocks_, tags_ = f(chars), f(linked), f(marks), f(blocks), f(tags)
    parent = np.maximum(np.asarray(parents), 0)
    one = np.zeros((n, len(KINDS)), np.float32)
    one[np.arange(n), kinds] = 1
    around = f(children)[parent]
    rest = [
        np.log1p(chars_),
        np.log1p(f(own)),
        linked_ / np.maximum(chars_, 1),
        marks_ / np.maximum(blocks_, 1),
        chars_ / (1 + tags_),
        chars_ / max(1, chars[0]),
        np.log1p(blocks_),
        chars_ / np.maximum(blocks_, 1),
        f(heads),
        f(depth),
        f(index) / np.maximum(around, 1),
        np.log1p(around),
        f([twins.get((parents[i], page.tags[i]), 1) for i in range(n)]) / np.maximum(around, 1),
        f(warned),
        np.log1p(chars_[parent]),
        linked_[parent] / np.maximum(chars_[parent], 1),
        f(kinds)[parent],
        f(caps),
    ]
    return np.column_stack([one, group, *rest])
