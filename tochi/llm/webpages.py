"""Main text of web pages by wrapper induction.

The pages of a host are grouped by layout, the set of paths of their containers, and
one page of each layout is its pivot. Every other page of the layout is parsed to a
tree and aligned with the pivot by simple tree matching (Yang, 1991). Spark counts, at
each slot of the pivot and over the different pages of the layout, how many hold a text:
a text that recurs at its slot on many of them is a constant node, which belongs to the
template and goes; what varies there is content and stays. What the pivot lacks is
placed by its path of tags and is template only if half of all different pages have it.
Pages whose article is the same count once, so copies of one article make no template.
Pages of rare layouts are aligned with the pivot of their host's most frequent one.

Tags and class words are a prior. Elements that say by tag, class or id what they are
(menus, adverts, forms, comments, ...) are never content, and where a page has an
<article> or <main>, what stands outside it is not the article. Inside it a text is
template only if nearly all articles of the host have it at that slot.

Definitions for odd input: null html is an empty page with an empty text; a null or
odd url is the host ``''``; fewer than SMALL_HOST different pages make no wrapper, which
``wrapped`` tells, and keep what tags and class words leave; repeated pages each give a row; elements may be nested to
any depth, and a page may be of any length.
"""

from __future__ import annotations

import html as references
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tochi.llm.common import saved, small_batches, table, with_facts

#: A text is template at a slot if at least this many different pages have it there,
#: and at least this share of those that fill the slot.
LEAST_PAGES, TEMPLATE_SHARE = 5, 0.5
#: Of fewer pages, at least this many, a text is template if all have it at its slot.
SMALL_HOST = 3
#: The same inside <article> or <main>, over different articles.
LEAST_ARTICLES, ARTICLE_SHARE = 10, 0.9
#: Pages that a layout needs for a pivot of its own, and the depth of its paths.
LAYOUT_PAGES, LAYOUT_DEPTH = 10, 3
#: The pivot of a layout is the page whose length is nearest to this.
PIVOT_CHARS = 4000
#: Pivots or wrappers of all layouts are broadcast up to this many bytes; beyond,
#: they are joined with salted layouts.
BROADCAST_BYTES = 32 << 20
SALT_PAGES = 2000
#: Cells of a grid of children that is kept whole.
SMALL_GRID = 4000

# Names of HTML elements and the class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("head nav header footer aside form script style textarea title noscript template iframe svg math button select option dialog menu object canvas audio video".split())
CLASS_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words of a class that says what is beside an element, not what it is.
BESIDE = frozenset("with without has no not".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^'\">]*(?:(?:\"[^\"]*\"|'[^']*')[^'\">]*)*)>", re.S)
_names = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_word = re.compile(r"[a-z]+")
_container = re.compile(r"<(/?)(article|aside|div|footer|form|header|main|nav|section|table)\b", re.I)


class Node:
    """An element or, with tag ``#``, a run of text."""

    __slots__ = ("tag", "children", "text", "chrome", "inside", "shape", "slot")

    def __init__(self, tag: str, chrome: bool, inside: bool) -> None:
        self.tag, self.chrome, self.inside = tag, chrome, inside
        self.children: list[Node] = []
        self.text: list[str] = []
        self.shape: object = None
        self.slot = -1


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in FURNITURE:
        return not (tag == "header" and inside)
    if tag in ("html", "body") or "=" not in attributes:
        return False
    for m in _names.finditer(attributes):
        tokens = [set(_word.findall(t)) for t in (m[1] or m[2] or m[3] or "").lower().split()]
        words = set().union(*(t for t in tokens if not t & BESIDE)) & CLASS_WORDS
        if words - {"header"} or words and not inside:
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; text between block borders is one run."""
    root = Node("root", False, False)
    stack = [root]
    open_ = Counter()  # tags of the stack, so that a stray end tag costs no search
    at, n = 0, len(page)

    def add(raw: str) -> None:
        if not raw:
            return
        top = stack[-1]
        if not (top.children and top.children[-1].tag == "#"):
            run = Node("#", top.chrome, top.inside)
            top.children.append(run)
        top.children[-1].text.append(raw)

    def close(to: int) -> None:
        open_.subtract(x.tag for x in stack[to:])
        del stack[to:]

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        m = _token.match(page, begin)
        if not m:
            if begin + 1 < n and (page[begin + 1].isalpha() or page[begin + 1] == "/") and (end := page.find(">", begin)) > 0:
                at = end + 1
            else:
                add("<")
                at = begin + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if m[3].endswith("/") else n)
            continue
        if tag in VOID:
            if tag == "hr":
                stack[-1].children.append(Node("hr", stack[-1].chrome, stack[-1].inside))
            continue
        chrome = _is_furniture(tag, m[3], stack[-1].inside)
        if tag in INLINE and not chrome:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if open_["p"] > 0 else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "tbody"):
                    break
        top = stack[-1]
        node = Node(tag, top.chrome or chrome, top.inside or tag in ("article", "main"))
        top.children.append(node)
        if not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def _finish(root: Node, shapes: dict) -> None:
    """Drop empty runs, decode the others, and intern the shape of each subtree."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if c.tag != "#"]
    for node in reversed(order):  # children before their parents
        kept = []
        for child in node.children:
            if child.tag == "#":
                child.text = [" ".join(references.unescape("".join(child.text)).split())]
                if not child.text[0]:
                    continue
                child.shape = shapes.setdefault("#", len(shapes))
            kept.append(child)
        node.children = kept
        node.shape = shapes.setdefault((node.tag, *[c.shape for c in kept]), len(shapes))


def layout_of(page: str) -> int:
    """A hash of the set of paths of containers, LAYOUT_DEPTH deep; never 0."""
    paths: set[tuple[str, ...]] = set()
    stack: list[str] = []
    for m in _container.finditer(page):
        tag = m[2].lower()
        if not m[1]:
            stack.append(tag)
            if len(stack) <= LAYOUT_DEPTH:
                paths.add(tuple(stack))
        elif tag in stack[-8:]:  # an end tag out of order closes what was left open
            while stack.pop() != tag:
                pass
    return 1 + zlib.crc32(" ".join(sorted("/".join(p) for p in paths)).encode())


@F.pandas_udf(T.LongType())
def _layout(pages: pd.Series) -> pd.Series:
    return pages.fillna("").map(layout_of)


def _place_rest(root: Node) -> None:
    """Give the runs that the pivot lacks a negative slot by their path of tags."""
    todo = [(root, 0)]
    while todo:
        node, path = todo.pop()
        if node.tag != "#":
            todo += [(c, zlib.crc32(c.tag.encode(), path)) for c in node.children]
        elif node.slot < 0:
            node.slot = -1 - path % (1 << 30)


def _runs(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            yield node
        else:
            todo += reversed(node.children)


class Aligner:
    """Simple tree matching of pages with one pivot; sizes are kept by shape."""

    def __init__(self, pivot: str) -> None:
        self.shapes: dict = {}
        self.sizes: dict = {}
        self.pivot = self.tree(pivot)
        for k, run in enumerate(_runs(self.pivot)):
            run.slot = k

    def tree(self, page: str) -> Node:
        root = parse(page)
        _finish(root, self.shapes)
        return root

    def align(self, page: str) -> Node:
        """The tree of a page, its runs carrying the pivot's slots (-1: none)."""
        if len(self.shapes) > 100_000:
            self.sizes.clear()
        root = self.tree(page)
        self._match(root, self.pivot)
        return root

    def _known(self, a: Node, b: Node) -> int | None:
        """The size of a pair's matching if it needs no look at the children, or was found before."""
        if a.tag != b.tag:
            return 0
        if not a.children or not b.children:
            return 1
        return self.sizes.get((a.shape, b.shape))

    def _unknown(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """A pair of children for each two shapes whose matching has not been sized yet."""
        xs, ys = ({c.shape: c for c in n.children}.values() for n in (a, b))
        return [(x, y) for x in xs for y in ys if self._known(x, y) is None]

    def _size(self, a: Node, b: Node) -> int:
        """Nodes in the largest top-down order-keeping matching."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is None:
                open_ = self._unknown(x, y)
                if open_:
                    todo += open_
                    continue
                if len(x.children) * len(y.children) <= SMALL_GRID:
                    row = self._grid(x, y)[-1]
                else:
                    row, _ = self._first_row(x, y)
                    weights = self._weights(x, y)
                    for child in x.children:
                        row = self._next_row(row, weights[child.shape])
                self.sizes[x.shape, y.shape] = 1 + int(row[-1])
            todo.pop()
        return self._known(a, b)

    def _grid(self, a: Node, b: Node) -> list[list[int]]:
        """All rows of a small grid."""
        rows = [[0] * (len(b.children) + 1)]
        for x in a.children:
            last, row = rows[-1], [0]
            for j, y in enumerate(b.children):
                best = last[j + 1] if last[j + 1] >= row[j] else row[j]
                if x.tag == y.tag and (both := last[j] + self._known(x, y)) > best:
                    best = both
                row.append(best)
            rows.append(row)
        return rows

    def _first_row(self, a: Node, b: Node) -> tuple[np.ndarray, int]:
        """Row 0 of the grid of a pair's children, and the distance of rows that are kept for the way back."""
        return np.zeros(len(b.children) + 1, np.int64), math.isqrt(len(a.children)) + 1

    def _weights(self, a: Node, b: Node) -> dict[object, np.ndarray]:
        """By shape of a's children, the sizes of their matchings with all of b's."""
        found: dict[object, np.ndarray] = {}
        for x in a.children:
            if x.shape not in found:
                own = {y.shape: self._known(x, y) for y in {c.shape: c for c in b.children}.values()}
                found[x.shape] = np.array([own[y.shape] for y in b.children], np.int64)
        return found

    @staticmethod
    def _next_row(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The grid's next row: best without this child, with it, or as to the left."""
        return np.append(0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights)))

    def _pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The matched children of a pair, last first.

        Every so many rows of the grid are kept and those between computed again on the
        way back, so wide nodes take memory by the square root of their width.
        """
        i, j = len(a.children), len(b.children)
        small = i * j <= SMALL_GRID
        row, step = self._first_row(a, b)
        if not small:
            weights, kept = self._weights(a, b), [row]
            for k, x in enumerate(a.children, 1):
                row = self._next_row(row, weights[x.shape])
                if k % step == 0:
                    kept.append(row)
        while i and j:
            base = 0 if small else (i - 1) // step * step
            rows = self._grid(a, b) if small else [kept[base // step]]
            for x in () if small else a.children[base:i]:
                rows.append(self._next_row(rows[-1], weights[x.shape]))
            while i > base and j:
                here, above = rows[i - base], rows[i - base - 1]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield a.children[i], b.children[j]

    def _match(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a.tag == "#":
                a.slot = b.slot
                continue
            if a.shape == b.shape:
                todo += zip(a.children, b.children)
                continue
            for x, y in self._unknown(a, b):
                self._size(x, y)
            todo += self._pairs(a, b)


_BLOCKS = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("inside", T.BooleanType()), T.StructField("text", T.StringType())]))


def _align_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligners: dict[tuple[str, int], Aligner] = {}
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("inside", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        hosts, pivots, pages = (batch.column(k).to_pylist() for k in (2, 4, 5))
        out = []
        for host, pivot, page in zip(hosts, pivots, pages):
            key = (host, hash(pivot))
            if key not in aligners:
                if len(aligners) >= 200:
                    aligners.clear()
                aligners[key] = Aligner(pivot or "")
            root = aligners[key].align(page or "")
            _place_rest(root)
            runs = [r for r in _runs(root) if not r.chrome]
            out.append([{"slot": r.slot, "inside": r.inside, "text": r.text[0]} for r in runs])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, kind)], names=["page_id", "url", *WRAPPER, "blocks"])


def host_of(url: Column) -> Column:
    """The host of a url in lower case, ``''`` where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: What pages share a wrapper by.
WRAPPER = ["host", "layout"]


def by_layout(rows: DataFrame, facts: DataFrame, size: Column) -> DataFrame:
    """``rows`` left-joined with one fact row per layout of a host: broadcast if small, else dealt by salts.

    A layout has a salt for every SALT_PAGES of its pages, so a large one is many tasks.
    """
    facts = saved(facts, "hosts")
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), WRAPPER, "left")
    salts = F.ceil(F.col("pages") / SALT_PAGES)
    large = F.broadcast(saved(facts.filter(salts > 1).select(*WRAPPER, salts.alias("_salts")), "hosts-large"))
    salted = rows.join(large, WRAPPER, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns[:2]), F.coalesce("_salts", F.lit(1).cast("long")))).drop("_salts")
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return salted.join(spread, [*WRAPPER, "_salt"], "left").drop("_salt")


def with_layout(pages: DataFrame) -> DataFrame:
    """``pages`` (with host, html) with layout, 0 for the most frequent of a host and those too rare, and its ``main``.

    ``main`` is false on the pages of rare layouts: none of them is a pivot.
    """
    pages = pages.withColumn("found", _layout("html"))
    sizes = saved(pages.groupBy("host", "found").agg(F.count("*").alias("n")), "web-layouts")
    tops = sizes.groupBy("host").agg(F.max_by("found", F.struct("n", "found")).alias("top"), F.count("*").alias("layouts"))
    first = F.col("found") == F.col("top")
    chosen = sizes.join(tops.filter("layouts > 1"), "host").filter(first | (F.col("n") >= LAYOUT_PAGES))
    chosen = saved(chosen.select("host", "found", "n", F.when(first, 0).otherwise(F.col("found")).cast("long").alias("layout")), "web-chosen")
    placed = with_facts(pages, chosen, ["host", "found"], "n")
    return placed.select(*(c for c in pages.columns if c != "found"), F.coalesce("layout", F.lit(0).cast("long")).alias("layout"), F.col("layout").isNotNull().alias("main"))


def different_pages(blocks: DataFrame) -> DataFrame:
    """(host, layout, body, own): a row for each different article of a layout, with its places."""
    landmark = F.exists("blocks", lambda b: b["inside"])
    rows = blocks.withColumn("own", F.filter("blocks", lambda b: b["inside"] | ~landmark)).filter(F.size("own") > 0)
    body = F.xxhash64(F.transform("own", lambda b: b["text"]))
    place = F.transform("own", lambda b: F.struct(b["slot"].alias("slot"), b["inside"].alias("inside"), F.xxhash64(b["text"]).alias("text_hash")))
    return rows.groupBy(*WRAPPER, body.alias("body")).agg(F.first(place).alias("own"))


def wrappers(blocks: DataFrame) -> DataFrame:
    """(host, layout, different, template): the different pages of a layout, and the template's (slot, text_hash)."""
    pages = saved(different_pages(blocks), "web-pages")
    sizes = pages.groupBy(*WRAPPER).agg(F.count("*").alias("different"))
    places = pages.select(*WRAPPER, "body", F.explode(F.array_distinct("own")).alias("b")).select(*WRAPPER, "body", "b.*")
    texts = saved(places.groupBy(*WRAPPER, "slot", "inside", "text_hash").agg(F.count("*").alias("n")), "web-texts")
    fill = texts.filter("slot >= 0").groupBy(*WRAPPER, "slot", "inside").agg(F.sum("n").alias("filled"))
    often = texts.filter(F.col("n") >= SMALL_HOST).join(fill, [*WRAPPER, "slot", "inside"], "left").join(sizes, WRAPPER)
    n, of = F.col("n"), F.coalesce("filled", "different")
    inside = (n >= LEAST_ARTICLES) & (n >= ARTICLE_SHARE * of)
    outside = (n >= LEAST_PAGES) & (n >= TEMPLATE_SHARE * of) | (n == F.col("different"))
    template = often.filter(F.when(F.col("inside"), inside).otherwise(outside)).groupBy(*WRAPPER).agg(F.collect_set(F.struct("slot", "text_hash")).alias("template"))
    return sizes.join(template, WRAPPER, "left")


def main_text(pages: DataFrame, landmarks: bool = True) -> DataFrame:
    """page_id, url, text, n_chars and wrapped of every page; without ``landmarks`` <article> and <main> say nothing."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    pages = with_layout(pages)
    near = F.abs(F.length("html") - PIVOT_CHARS)
    order = F.struct((~F.col("main")).alias("rare"), near.alias("d"), F.xxhash64("html").alias("h"))
    pivots = pages.filter(F.length("html") > 0).groupBy(*WRAPPER).agg(F.min_by("html", order).alias("pivot"), F.count("*").alias("pages"))
    joined = by_layout(pages.drop("main"), pivots, F.length("pivot") * 4).select("page_id", "url", *WRAPPER, "pivot", "html")
    kept = [T.StructField(c, pages.schema[c].dataType) for c in ("page_id", "url", *WRAPPER)]
    blocks = joined.mapInArrow(_align_batches, T.StructType([*kept, T.StructField("blocks", _BLOCKS)]))
    if not landmarks:
        blocks = blocks.withColumn("blocks", F.transform("blocks", lambda b: b.withField("inside", F.lit(False))))
    blocks = saved(blocks, "web-blocks")
    found = wrappers(blocks).join(blocks.groupBy(*WRAPPER).agg(F.count("*").alias("pages")), WRAPPER)
    out = by_layout(blocks, found, F.coalesce(F.size("template"), F.lit(0)) * 16 + 64)
    landmark = F.exists("blocks", lambda b: b["inside"])
    known = F.coalesce(F.col("template"), F.array().cast("array<struct<slot:int,text_hash:bigint>>"))
    constant = lambda b: F.array_contains(known, F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("text_hash")))
    chosen = F.filter("blocks", lambda b: (b["inside"] | ~landmark) & ~constant(b))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    wrapped = F.coalesce(F.col("different") >= SMALL_HOST, F.lit(False))
    return out.select("page_id", "url", text.alias("text"), wrapped.alias("wrapped")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "wrapped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
