"""Named indexes, requests and their results, and the caches of a driver."""

from __future__ import annotations

import json
import random
import time
from collections import Counter, OrderedDict, deque
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.analyzer import Analyzer
from textmill.operators import features, rank
from textmill.operators.filters import Condition
from textmill.operators.index import Index, IndexConfig
from textmill.operators.query import Filter, Phrase, Query, Sql, Term
from textmill.sources import ingest


@dataclass(frozen=True)
class Request:
    """``match``: whether all or any of the conditions must hold; ``search_type``: fuzzy, exact or phrase."""

    query: str = ""
    conditions: tuple[Condition, ...] = ()
    match: str = "all"
    reverse: bool = False
    rule: str = ""
    search_type: str = "fuzzy"
    fuzzy: bool = False
    fuzzy_threshold: int = 2
    sort_field: str = ""
    sort_order: str = "asc"
    page: int = 1
    size: int = 10
    fast: bool = False

    def checksum(self) -> int:
        """The same for requests that differ only in the order of their conditions."""
        # field by field: a condition may hold a table of keys, which can't be copied
        body = {f.name: getattr(self, f.name) for f in fields(self)}
        body["conditions"] = sorted((c.field, c.operator, str(c.value), c.reverse, id(c.keys) if c.keys is not None else 0) for c in self.conditions)
        return xxhash.xxh64_intdigest(json.dumps(body, sort_keys=True, default=str))

    def text_query(self) -> Query | None:
        if not self.query.strip():
            return None
        k = self.fuzzy_threshold if self.fuzzy_threshold > 0 else 2
        if self.search_type == "phrase":
            return Phrase(self.query, self.fuzzy, k)
        if self.search_type == "exact":
            return Term(self.query)
        return Phrase(self.query, True, k) if " " in self.query.strip() else Term(self.query.strip(), True, k)

    def plan(self) -> Query:
        inner = self.text_query()
        if inner is None and not self.conditions and not self.rule:
            raise ValueError("a request needs a query, a condition or a rule")
        if self.conditions:
            inner = Filter(self.conditions, "or" if self.match == "any" else "and", self.reverse, inner)
        return Sql(self.rule, inner) if self.rule else inner


class LruCache:
    """``policy``: what goes when it is full (lru, lfu or random); entries expire ``ttl`` seconds after their last use."""

    def __init__(self, capacity: int = 100, ttl: float | None = None, policy: str = "lru", clock: Callable[[], float] = time.monotonic) -> None:
        self.capacity, self.ttl, self.policy, self.clock = max(1, capacity), ttl, policy, clock
        self._held: OrderedDict[Any, list] = OrderedDict()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key: Any, default: Any = None) -> Any:
        entry = self._held.get(key)
        if entry is not None and self.ttl is not None and self.clock() - entry[1] > self.ttl:
            del self._held[key]
            entry = None
        if entry is None:
            self.misses += 1
            return default
        self.hits += 1
        entry[1] = self.clock()
        entry[2] += 1
        self._held.move_to_end(key)
        return entry[0]

    def put(self, key: Any, value: Any) -> None:
        if key not in self._held and len(self._held) >= self.capacity:
            if self.policy == "lfu":
                gone = min(self._held, key=lambda k: self._held[k][2])
            elif self.policy == "random":
                gone = random.choice(list(self._held))
            else:
                gone = next(iter(self._held))
            del self._held[gone]
        self._held[key] = [value, self.clock(), 0]
        self._held.move_to_end(key)

    def remove(self, key: Any) -> None:
        self._held.pop(key, None)

    def clear(self) -> None:
        self._held.clear()

    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


@dataclass(frozen=True)
class Result:
    """A page of records with ``score``, in order; ``items`` is lazy, the numbers are known."""

    items: DataFrame
    total: int
    page: int
    per_page: int
    total_pages: int
    next_page: int | None
    prev_page: int | None
    latency_ms: float


#: Searches that the log keeps.
LOG_SIZE = 10_000


@dataclass
class Engine:
    """Named indexes over one session; each search is logged, and its page is kept until an index changes."""

    spark: SparkSession
    indexes: dict[str, Index] = field(default_factory=dict)
    log: deque[tuple[str, str, float, float, int]] = field(default_factory=lambda: deque(maxlen=LOG_SIZE))
    asked: Counter = field(default_factory=Counter)
    cache: LruCache = field(default_factory=LruCache)

    def create(self, name: str, source: Any, id_col: str | None = None, stem: bool = False, **options: Any) -> Index:
        config = IndexConfig(name=name, analyzer=Analyzer.make(stem=stem), **options) if "analyzer" not in options else IndexConfig(name=name, **options)
        self.indexes[name] = Index.build(ingest.replaced(ingest.as_corpus(self.spark, source, id_col)), config)
        self.cache.clear()
        return self.indexes[name]

    def get(self, name: str) -> Index:
        if name not in self.indexes:
            raise KeyError(f"no index {name!r}")
        return self.indexes[name]

    def drop(self, name: str) -> None:
        self.get(name).unpersist()
        del self.indexes[name]
        self.cache.clear()

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def replace(self, name: str, index: Index) -> None:
        """Put a changed snapshot in an index's place."""
        self.get(name)
        self.indexes[name] = index
        self.cache.clear()

    def hits(self, name: str, request: Request) -> DataFrame:
        """(doc_id, score) of all hits."""
        index = self.get(name)
        plain = request.fast and not request.conditions and not request.rule
        return rank.conjunctive(index, request.query) if plain else rank.search(index, request.plan())

    def search(self, name: str, request: Request) -> Result:
        """Ids of a page first, then the records of these alone; a repeated request searches nothing."""
        began = time.perf_counter()
        index = self.get(name)
        # the key tables of a kept request are kept with it, so an id is never another table's
        key = name, index.version, request.checksum()
        kept = self.cache.get(key)
        if kept is None:
            kept = self._page(index, self.hits(name, request), request), request.conditions
            self.cache.put(key, kept)
        page = kept[0]
        took = (time.perf_counter() - began) * 1000
        self.log.append((name, request.query, time.time(), took, page.total))
        self.asked[name] += 1
        return replace(page, latency_ms=took)

    def _page(self, index: Index, hits: DataFrame, request: Request) -> Result:
        sort_field, descending = request.sort_field, request.sort_order.lower() == "desc"
        if not sort_field and index.config.default_sort:
            sort_field, descending = index.config.default_sort
        hits = hits.join(index.corpus.select("doc_id", *([f"`{sort_field}`"] if sort_field and sort_field != "doc_id" else [])), "doc_id").persist()
        try:
            page = rank.paginate(hits, rank.ordering(index, sort_field, descending), request.page, request.size)
            rows = [(r.doc_id, r.score, k) for k, r in enumerate(page.results.select("doc_id", "score").collect())]  # a page
        finally:
            hits.unpersist()
        place = "_place"
        while place in index.corpus.columns:
            place += "_"
        found = self.spark.createDataFrame(rows, f"doc_id bigint, score double, {place} int")
        records = index.corpus.where(F.col("doc_id").isin([r[0] for r in rows]))
        items = F.broadcast(found).join(records, "doc_id").orderBy(place).drop(place)
        return Result(items, page.total, page.page, page.per_page, page.total_pages, page.next_page, page.prev_page, 0.0)

    def search_with_highlights(self, name: str, request: Request) -> Result:
        found = self.search(name, request)
        return Result(features.highlight(found.items, rank.query_words(request.query)), *list(vars(found).values())[1:])

    def query_log(self) -> DataFrame:
        """(index, query, ts, latency_ms, results) of all searches."""
        rows = self.spark.createDataFrame(list(self.log), "index string, query string, ts double, latency_ms double, results bigint")
        return rows.withColumn("ts", F.timestamp_seconds("ts"))

    def metrics(self) -> DataFrame:
        """(index, documents, queries) of every index."""
        asked = self.spark.createDataFrame(list(self.asked.items()), "index string, queries bigint")
        parts = [i.stats.select(F.lit(n).alias("index"), F.col("n").alias("documents")) for n, i in sorted(self.indexes.items())]
        every = self.spark.createDataFrame([], "index string, documents bigint")
        for part in parts:
            every = every.unionByName(part)
        return every.join(asked, "index", "left").fillna(0, ["queries"])
