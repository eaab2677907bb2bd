"""Main text of web pages: boosted trees over the features of DOM nodes, decoded so that ancestors and descendants agree.

The trees learn from a bounded sample of pages, each taken twice: as it is, and with its semantic tags and attributes made plain, so
that the shape of the text (density, links, depth, siblings) counts too. What is main text in the sample is told by the pages' own
semantic elements; a page without any teaches by paragraph shape.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .shared import least_of_tasks

SAMPLE_PAGES = 300  # pages the trees learn from: those with the smallest hashed ids
SAMPLE_CHARS = 200_000  # longer pages are no sample

# HTML element names by their role.
BLOCKS = frozenset("html body p div article section main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre header footer nav aside form fieldset figure figcaption address hr center details summary dialog menu select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg head".split())
NESTED = frozenset("noscript template svg".split())  # of RAW, those that hold elements
CLOSES_P = BLOCKS - {"html", "body", "option"}
SAME_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table select body div article section main td th".split())  # an open p outside the innermost of these stays open
LISTS = frozenset("ul ol dl table select".split())  # the same for items and cells
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("nav header footer aside form menu select dialog".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
OTHER_WORDS = frozenset("ad ads advert advertisement banner promo sponsor nav navigation navbar menu header footer sidebar side aside widget cookie consent notice popup modal comment comments reply replies share social related recommended breadcrumb breadcrumbs newsletter subscribe login form search".split())

# A quote opens a value only directly after "=", and only if it closes; any other is an ordinary character of a tag that ends at ">".
_tag = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|=)*)(?:>|$)", re.S)
_attribute = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_token = re.compile(r"[a-z]+")
TAG_KINDS = ("p", "div", "li", "h", "article", "main", "section", "nav", "header", "footer", "aside", "form", "td", "body")


class Ends:
    """Where the next end tag of an element stands; each part of a page is searched once for a name, however often it is asked for."""

    def __init__(self, source: str):
        self.source, self.known = source, {}

    def after(self, at: int, name: str) -> tuple[int, int]:
        """(start, end) of the first end tag from `at` on; without one both are the page's end."""
        if (got := self.known.get(name)) is None or got[0] < at:
            m = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(self.source, at)
            got = self.known[name] = m.span() if m else (len(self.source),) * 2
        return got


def _end(source: str, at: int, name: str, around: dict[str, list[int]], ends: Ends) -> int:
    """Where an svg, noscript or template whose content begins at `at` ends: without an end tag of its own before that of an element
    around it, with that element (an svg also before a block).
    """
    start, end = ends.after(at, name)
    if start < len(source) and not re.compile(rf"<{name}\b", re.I).search(source, at, start):
        return end
    inside: dict[str, int] = {}
    for m in _tag.finditer(source, at):
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1]:
            if name == "svg" and tag in BLOCKS:
                return m.start()
            if tag not in VOID and not m[3].endswith("/"):
                inside[tag] = inside.get(tag, 0) + 1
        elif inside.get(tag):
            inside[tag] -= 1
        elif tag == name:
            return m.end()
        elif around.get(tag):
            return m.start()
    return len(source)


class _Open:
    """The open elements. Besides their order it knows the places of each name, of those that end the search for an open p or item, and the
    open block nodes, so that no step walks over the elements that stay open."""

    def __init__(self):
        self.names: list[str] = []
        self.nodes: list[int] = []  # -1 for inline elements
        self.places: dict[str, list[int]] = {}
        self.limits: list[int] = []
        self.lists: list[int] = []
        self.blocks: list[int] = []

    def push(self, name: str, node: int) -> None:
        at = len(self.names)
        self.names.append(name)
        self.nodes.append(node)
        self.places.setdefault(name, []).append(at)
        if name in LIMITS:
            self.limits.append(at)
        if name in LISTS:
            self.lists.append(at)
        if node >= 0:
            self.blocks.append(node)

    def cut(self, to: int) -> None:
        while len(self.names) > to:
            name = self.names.pop()
            self.places[name].pop()
            if name in LIMITS:
                self.limits.pop()
            if name in LISTS:
                self.lists.pop()
            if self.nodes.pop() >= 0:
                self.blocks.pop()

    def last(self, names: tuple[str, ...]) -> int:
        """The innermost place of any of the names; the root does not count."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)


class Page:
    """Block nodes in document order (`parent`, `tag`, `words` of attributes) and the runs of text (node, text, characters in links). One pass, linear in the page."""

    def __init__(self, source: str, plain: bool = False):
        self.parent, self.tag, self.words, self.runs = [-1], ["html"], [frozenset()], []
        open_, ends = _Open(), Ends(source)
        open_.push("html", 0)
        parts: list[str] = []
        linked = at = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.runs.append((open_.blocks[-1], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def close(to: int) -> None:
            flush()
            open_.cut(to)

        n = len(source)
        while at < n:
            m = _tag.search(source, at)
            if m is None or m.end() == m.start():
                text = source[at:]
                parts.append(text)
                linked += len(text) * bool(open_.places.get("a"))
                break
            if m.start() > at:
                text = source[at : m.start()]
                parts.append(text)
                linked += len(text) * bool(open_.places.get("a"))
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:  # an end tag closes down to its element, if that is open
                if k := open_.last((name,)):
                    if any(i >= 0 for i in open_.nodes[k:]):
                        flush()
                    open_.cut(k)
                continue
            if name in RAW:
                if not m[3].endswith("/") and name in NESTED:
                    at = _end(source, at, name, open_.places, ends)
                elif not m[3].endswith("/") and name != "head":
                    at = ends.after(at, name)[1]
                continue
            if name == "br" or name == "wbr":
                parts.append(" " if name == "br" else "")
                continue
            if name in VOID and name != "hr":
                continue
            if name not in BLOCKS:
                open_.push(name, -1)
                continue
            flush()
            if name in ("html", "body") and open_.places.get(name):
                continue
            if name in CLOSES_P and (k := open_.last(("p",))) > (open_.limits[-1] if open_.limits else 0):
                close(k)
            if name in SAME_CLOSE and (k := open_.last(SAME_CLOSE[name])) > (open_.lists[-1] if open_.lists else 0):
                close(k)
            if name == "hr":
                continue
            words = frozenset(w for a in _attribute.findall(m[3]) for w in _token.findall("".join(a).lower())) if m[3] else frozenset()
            shown = name
            if plain:
                words = frozenset()
                shown = "div" if name in MAIN_TAGS or name in OTHER_TAGS or name == "section" else name
            self.parent.append(open_.blocks[-1])
            self.tag.append(shown)
            self.words.append(words)
            open_.push(name, len(self.tag) - 1)
        flush()


def features(page: Page) -> np.ndarray:
    """One row a node: subtree density, attribute tokens, depth and sibling statistics."""
    n = len(page.tag)
    own, links, runs, stops = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text, linked in page.runs:
        own[node] += len(text)
        links[node] += linked
        runs[node] += 1
        stops[node] += text.count(". ") + text.count(", ") + (text[-1] in ".!?")
    chars, nodes, kids = list(own), [1] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
        stops[p] += stops[i]
        nodes[p] += nodes[i]
        kids[p] += 1
    total = max(1, chars[0])
    depth, good, bad, before = [0] * n, [0] * n, [0] * n, [0] * n
    seen = [0] * n
    sums: dict[tuple[int, str], list[int]] = {}
    out = np.zeros((n, 18))
    done = 0
    for i in range(n):
        p, tag, words = page.parent[i], page.tag[i], page.words[i]
        main, other = (tag in MAIN_TAGS) or bool(words & MAIN_WORDS), (tag in OTHER_TAGS) or bool(words & OTHER_WORDS)
        if p >= 0:
            depth[i] = depth[p] + 1
            good[i], bad[i] = good[p] | main, bad[p] | other
            seen[p] += 1
            before[i] = seen[p]
            s = sums.setdefault((p, tag), [0, 0])
            s[0] += 1
            s[1] += chars[i]
        else:
            good[i], bad[i] = int(main), int(other)
        c = max(1, chars[i])
        kind = "h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else tag
        out[i, :14] = (math.log1p(chars[i]), links[i] / c, nodes[i] / c * 100, math.log1p(chars[i] / nodes[i]), stops[i] / c * 100, depth[i], main, other, good[i], bad[i], chars[i] / total, own[i] / c, TAG_KINDS.index(kind) if kind in TAG_KINDS else -1, done / total)
        done += own[i]
    for i in range(1, n):
        p = page.parent[i]
        s = sums[p, page.tag[i]]
        out[i, 14:] = (math.log1p(kids[p]), s[0] / max(1, kids[p]), chars[i] / max(1, chars[p]), math.log1p(s[1] / s[0]))
    return out


def _targets(source: str) -> tuple[Page, np.ndarray]:
    """Whether at least nine tenths of a node's text is main text, as the page's own elements tell."""
    page = Page(source)
    n = len(page.tag)
    semantic = any(t in MAIN_TAGS for t in page.tag)
    inside = [False] * n
    for i in range(n):
        p = page.parent[i]
        up = p >= 0 and inside[p]
        tag, words = page.tag[i], page.words[i]
        drop = (tag in OTHER_TAGS and not (tag == "header" and up)) or bool(words & OTHER_WORDS)
        inside[i] = not drop and (up or tag in MAIN_TAGS if semantic else up or tag == "p" or bool(words & MAIN_WORDS) or (len(tag) == 2 and tag[0] == "h"))
    all_, main = np.zeros(n), np.zeros(n)
    for node, text, linked in page.runs:
        all_[node] += len(text)
        if inside[node] and (semantic or linked < len(text) / 2):
            main[node] += len(text)
    for i in range(n - 1, 0, -1):
        all_[page.parent[i]] += all_[i]
        main[page.parent[i]] += main[i]
    return page, (main >= 0.9 * np.maximum(all_, 1)) & (all_ > 0)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> BoostedTrees | None:
    """Trees learnt from at most SAMPLE_PAGES pages, rows that repeat a page_id counting once; None where no page has any text."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html")).where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    # First the ids, then their pages: a task sends on no page, and no more ids, than the sample can hold.
    some = least_of_tasks(rows.where("id IS NOT NULL").select(F.xxhash64("id").alias("h"), "id"), ["h", "id"], SAMPLE_PAGES)
    ids = [r.id for r in some.distinct().orderBy("h", "id").limit(SAMPLE_PAGES).collect()]
    sample = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect() if ids else []
    x, y = [], []
    for r in sample:
        page, target = _targets(r.html)
        shaped = Page(r.html, plain=True)
        for p in (page, shaped):
            f = features(p)
            text = f[:, 0] > 0
            x.append(f[text])
            y.append(target[text])
    if not x or not sum(len(t) for t in y) or not any(t.any() for t in y):
        return None
    return BoostedTrees(np.concatenate(x), np.concatenate(y).astype(float))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are main text. A node is above main text, in it, or out; below `in` a node is in or out, below `out` all are out, and the
    choice of greatest likelihood over the whole tree is taken."""
    n = len(page.tag)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    out, within, above = no.tolist(), yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        out[p] += out[i]
        within[p] += max(within[i], out[i])
        above[p] += max(within[i], out[i], above[i])
    state, kept = [0] * n, [False] * n
    for i in range(n):
        up = state[page.parent[i]] if i else 2
        if up == 0:
            continue
        best = max(within[i], out[i], above[i]) if up == 2 else max(within[i], out[i])
        state[i] = 1 if within[i] == best else 0 if out[i] == best else 2
        kept[i] = state[i] == 1
    return kept


def extract(pages: DataFrame, model: BoostedTrees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, block after block, one newline between them.

    Character references are decoded, white space inside a block becomes one space. Null and empty pages, pages without text and a missing
    model give the empty text; repeated rows each give a row, an empty table none; a null page_id or url stays null; other columns are ignored. Markup
    may be broken off anywhere: elements left open end with the page. Each page is worked on whole and alone, in time linear in its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for lo in range(0, batch.num_rows, 256):
                parsed = [Page(x.as_py() or "") for x in batch.column(2).slice(lo, 256)]
                made = [features(p) for p in parsed]
                odds = model.log_odds(np.concatenate(made)) if model else np.full(sum(map(len, made)), -9.0)
                at = 0
                for p, f in zip(parsed, made, strict=True):
                    kept = decode(p, np.where(f[:, 0] > 0, odds[at : at + len(f)], 0.0))
                    at += len(f)
                    texts.append("\n".join(t for node, t, _ in p.runs if kept[node]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
