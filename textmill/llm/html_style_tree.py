"""HTML extraction by a site style tree (Yi, Liu and Li, 2003).

The DOM trees of a host's pages are merged from the root: an element node has one style node for
each sequence of children it is seen with; a style node's children are element nodes again.  An
element that m pages share is important if its presentation or its content varies:

    internal   (1 - g^l) * H_m(styles) + g^l * sum_i p_i * mean(importance of style i's children)
    leaf       1 - mean over its distinct contents of log_m(pages with that content)

with l styles of shares p_i, H_m the entropy to base m, and g = ``damping``.  Elements of one page
only have importance 1.  A branch is removed from a page if its root's importance is at most
``threshold``; what is left is the page's text.

Pages emit (element, style) pairs as hash keys and one aggregation counts them.  Importance is carried
up from the deepest elements: a host at a time in one task, or with joins level by level where a host
has more than ``max_tree`` pairs.  The keys of removable elements are broadcast if they are at most
``max_broadcast_bytes``; beyond that they are joined to the pages.

Defined results: a null html has a null text; an empty one an empty text; a null or malformed url
counts as host ``""``; broken markup is read leniently, to any depth; rows with the same host and html
count as one page and are each cleaned; rows with equal page_id are cleaned one by one; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import cut_lineage

_MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[!?][^>]*>)", re.S)
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SOURCE = re.compile(r"""\bsrc\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLANKS = re.compile(r"\s+")


@dataclass(frozen=True)
class Settings:
    damping: float = 0.9
    threshold: float = 0.4
    max_broadcast_bytes: int = 32_000_000
    max_tree: int = 2_000_000


class Node:
    __slots__ = ("name", "children", "content")

    def __init__(self, name: str, content: str | None = None) -> None:
        self.name, self.content = name, content
        self.children: list[Node] = []


def parse(html: str) -> Node:
    """The DOM as far as it matters: elements by tag and class, texts, image sources."""
    root = Node("#page")
    stack = [root]
    opened: Counter = Counter()  # tags on the stack
    at, size = 0, len(html)

    def text(raw: str) -> None:
        clean = _BLANKS.sub(" ", entities.unescape(raw)).strip()
        if clean:
            stack[-1].children.append(Node("#text", clean))

    for found in iter(lambda: _MARKUP.search(html, at), None):
        if found.start() > at:
            text(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            while opened[tag]:
                gone = stack.pop().name.partition(".")[0]
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        ends = _ENDS.get(tag)
        if ends and stack[-1].name.partition(".")[0] in ends:
            opened[stack.pop().name.partition(".")[0]] -= 1
        kind = _CLASS.search(found[3]) if found[3] else None
        node = Node(f"{tag}.{kind[1].strip(chr(34) + chr(39)).lower()}" if kind else tag)
        stack[-1].children.append(node)
        if tag in _VOID:
            source = _SOURCE.search(found[3]) if tag == "img" else None
            if source:
                node.content = source[1].strip("\"'")
        elif not found[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < size:
        text(html[at:])
    return root


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def walk(host: str, root: Node) -> Iterator[tuple[Node, int, int, int, int, int]]:
    """(node, key, parent's style, own style, depth, number of children) of every element, top down.

    A leaf's style is its content; its number of children is -1.
    """
    todo = [(root, _hash("host", host), 0, 0)]
    while todo:
        node, key, parent, depth = todo.pop()
        if node.content is not None:
            yield node, key, parent, _hash(key, "content", node.content), depth, -1
            continue
        style = _hash(key, "style", *(c.name for c in node.children))
        yield node, key, parent, style, depth, len(node.children)
        todo += [(c, _hash(style, i), style, depth + 1) for i, c in enumerate(node.children)]


class Keys:
    """A set of 64-bit keys as one sorted array of bytes: 8 bytes a key wherever it is sent."""

    def __init__(self, keys: np.ndarray) -> None:
        self.raw = np.sort(keys.astype(np.int64)).tobytes()

    def __contains__(self, key: int) -> bool:
        keys = memoryview(self.raw).cast("q")
        at = bisect_left(keys, key)
        return at < len(keys) and keys[at] == key


def clean(host: str, html: str, noisy: Container[int]) -> tuple[str, int]:
    """(text without the noisy branches, number of branches removed)."""
    texts: list[str] = []
    removed = 0
    todo = [(parse(html), _hash("host", host))]
    while todo:
        node, key = todo.pop()
        if key in noisy:
            removed += 1
        elif node.content is not None:
            if node.name == "#text":
                texts.append(node.content)
        else:
            style = _hash(key, "style", *(c.name for c in node.children))
            todo += [(c, _hash(style, i)) for i, c in reversed(list(enumerate(node.children)))]
    return "\n".join(texts), removed


def _pages(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s:]*)", 1)), F.lit(""))
    return pages.select("page_id", host.alias("host"), "html")


def _once(rows: DataFrame, settings: Settings) -> DataFrame:
    """Distinct rows (host, html); only rows that share a hash with others are moved."""
    keyed = rows.withColumn("key", F.xxhash64("host", "html"))
    repeated = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    n = repeated.count()
    if n == 0:
        return rows
    if n * 8 > settings.max_broadcast_bytes:
        return rows.distinct()
    repeated = F.broadcast(repeated)
    copies = keyed.join(repeated, "key", "left_semi").select("host", "html").distinct()
    return keyed.join(repeated, "key", "left_anti").select("host", "html").union(copies)


def style_counts(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(site, elem, parent, style, depth, kids, n): distinct pages in which an element has a style; site: the tree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["site", "elem", "parent", "style", "depth", "kids", "n"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())

        def flush(counts: Counter) -> pa.RecordBatch:
            columns = zip(*(k + (n,) for k, n in counts.items()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        counts: Counter = Counter()
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            for lo in range(0, batch.num_rows, 256):
                for host, html in zip(hosts[lo : lo + 256], batch.column("html").slice(lo, 256).to_pylist()):
                    site = _hash("host", host)
                    counts.update((site, *x[1:]) for x in walk(host, parse(html)))
                if len(counts) > 100_000:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    rows = _once(_pages(pages).where("html IS NOT NULL").select("host", "html"), settings)
    counted = rows.mapInArrow(run, "site bigint, elem bigint, parent bigint, style bigint, depth int, kids int, n bigint")
    return counted.groupBy("site", "elem", "parent", "style", "depth", "kids").agg(F.sum("n").alias("n"))


def importance(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(elem, importance) of every element that two or more pages of a host share.

    The tree of a host with at most ``max_tree`` rows is brought up in one pass of one task, hosts side
    by side; a larger one level by level with joins.  The result is the same.
    """
    counts = style_counts(pages, settings)
    elems = counts.groupBy("elem").agg(F.sum("n").alias("m")).where("m > 1")
    shared = cut_lineage(counts.join(elems, "elem"))
    large = cut_lineage(shared.groupBy("site").agg(F.count("*").alias("rows")).where(F.col("rows") > settings.max_tree).select("site"))
    if large.isEmpty():
        return _whole_trees(shared, settings)
    return _whole_trees(shared.join(large, "site", "left_anti"), settings).union(_by_level(shared.join(large, "site", "left_semi"), settings))


def _whole_trees(shared: DataFrame, settings: Settings) -> DataFrame:
    """Deepest elements first; only the sums of one level are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        below: dict[int, float] = {}
        above: dict[int, float] = {}
        elem, parent, m = None, 0, 1
        styles: list[tuple[int, int, int]] = []

        def settle() -> float:
            base = math.log(m)
            if any(kids == -1 for _, kids, _ in styles):
                return 1 - sum(math.log(n) / base for _, _, n in styles) / len(styles)
            entropy = sum(-n / m * math.log(n / m) / base for _, _, n in styles)
            inside = sum(n / m * (0.0 if kids == 0 else 1.0 if n == 1 else below.get(style, 0.0) / kids) for style, kids, n in styles)
            fade = settings.damping ** len(styles)
            return (1 - fade) * entropy + fade * inside

        for batch in _then_none(batches):
            keys, values = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("site", "depth", "elem", "parent", "m", "style", "kids", "n"))) if batch is not None else [(None,) * 8]
            for site, depth, e, p, total, style, kids, n in rows:
                if e != elem:
                    if elem is not None:
                        value = settle()
                        above[parent] = above.get(parent, 0.0) + value
                        keys.append(elem)
                        values.append(value)
                    if (site, depth) != at:
                        below, above = above if at is not None and site == at[0] else {}, {}
                        at = site, depth
                    elem, parent, m, styles = e, p, total, []
                styles.append((style, kids, n))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], names=["elem", "importance"])

    ordered = shared.repartition("site").sortWithinPartitions("site", F.desc("depth"), "elem")
    return ordered.mapInArrow(run, "elem bigint, importance double")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _by_level(shared: DataFrame, settings: Settings) -> DataFrame:
    spark = shared.sparkSession
    deepest = shared.agg(F.max("depth")).first()[0]
    done = spark.createDataFrame([], "elem bigint, importance double")
    below = spark.createDataFrame([], "style bigint, total double")
    share, base = F.col("n") / F.col("m"), F.log("m")
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = shared.where(F.col("depth") == depth).join(below, "style", "left")
        inside = F.when(F.col("kids") == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(F.col("total") / F.col("kids"))
        parts = level.groupBy("elem", "parent").agg(
            F.max(F.col("kids") == -1).alias("leaf"),
            F.count("*").alias("styles"),
            F.avg(F.log("n") / base).alias("common"),
            F.sum(-share * F.log(share) / base).alias("entropy"),
            F.sum(share * inside).alias("inside"),
        )
        fade = F.pow(F.lit(settings.damping), F.col("styles"))
        value = F.when(F.col("leaf"), 1 - F.col("common")).otherwise((1 - fade) * F.col("entropy") + fade * F.col("inside"))
        found = cut_lineage(parts.select("elem", "parent", value.alias("importance")))
        done = done.union(found.select("elem", "importance"))
        below = found.groupBy(F.col("parent").alias("style")).agg(F.sum("importance").alias("total"))
    return done


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, text, n_removed) of every page."""
    spark = pages.sparkSession
    noisy = cut_lineage(importance(pages, settings).where(F.col("importance") <= settings.threshold).select("elem"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_removed bigint"
    rows = _pages(pages)
    if noisy.count() * 8 <= settings.max_broadcast_bytes:
        shared = spark.sparkContext.broadcast(Keys(noisy.toArrow().column("elem").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _cleaned(batches, lambda _: shared.value)

        return rows.mapInArrow(run, schema)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                page, elem = [], []
                for i, (host, html) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
                    found = [x[1] for x in walk(host, parse(html))] if html is not None else []
                    page += [i] * len(found)
                    elem += found
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(page, pa.int64())), pa.array(elem, pa.int64())], names=["row", "elem"])

    # a page is named by what its cleaning depends on
    named = rows.withColumn("row", F.xxhash64("host", "html"))
    hits = named.select("row", "host", "html").mapInArrow(keys, "row bigint, elem bigint").distinct().join(noisy, "elem")
    hits = hits.groupBy("row").agg(F.collect_list("elem").alias("noisy"))
    return named.join(hits, "row", "left").mapInArrow(lambda batches: _cleaned(batches, lambda x: frozenset(x or ())), schema)


def _cleaned(batches: Iterator[pa.RecordBatch], noisy) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            own = part.column("noisy").to_pylist() if "noisy" in part.schema.names else [None] * part.num_rows
            out = [(None, None) if h is None else clean(host, h, noisy(x)) for host, h, x in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["page_id", "text", "n_removed"])
