"""The query tree. A node gives the ids that match, and the tokens that its hits are scored by.

Nodes that look at one record only (``column``) fuse into a single filter over the corpus; nodes that
need postings become semi joins.  Conjunctions of exact terms are one relational division over the
postings instead of a join for each term.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text
from textmill.operators import filters
from textmill.operators.index import Index

_WORD = re.compile(r"[a-z0-9_]+")


def lower(s: str) -> str:
    """ASCII lower case, as the index has it."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s: str) -> list[str]:
    return _WORD.findall(lower(s))


class Query:
    def ids(self, index: Index) -> DataFrame:
        """Distinct (doc_id)."""
        found = self.column(index)
        if found is None:
            raise NotImplementedError
        return index.corpus.where(found).select("doc_id")

    def column(self, index: Index) -> Column | None:
        """The same as a condition on one record, where that is possible."""
        return None

    def tokens(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Term(Query):
    """One whole lower-case term, never cut; ``fuzzy``: also terms within ``k`` edits."""

    term: str
    fuzzy: bool = False
    k: int = 2

    def ids(self, index: Index) -> DataFrame:
        t = lower(self.term)
        if not self.fuzzy:
            return index.postings.where(F.col("term") == t).select("doc_id").distinct()
        near = (F.col("term") == t) | text.within(F.col("term"), F.lit(t), self.k)
        return _with_terms(index, near).select("doc_id").distinct()

    def tokens(self) -> list[str]:
        return [lower(self.term)]


@dataclass(frozen=True)
class Phrase(Query):
    """All words, and the phrase as it stands in the record's text; ``fuzzy``: all words within ``k`` edits, anywhere."""

    phrase: str
    fuzzy: bool = False
    k: int = 2

    def ids(self, index: Index) -> DataFrame:
        parts = words(self.phrase)
        if not parts:
            return index.corpus.limit(0).select("doc_id")
        if self.fuzzy:
            spark = index.corpus.sparkSession
            wanted = spark.createDataFrame(list(enumerate(parts)), "pos int, token string")
            near = index.vocab.select("term").join(wanted, text.within(F.col("term"), F.col("token"), self.k)).select("term", "pos")
            hits = index.postings.select("term", "doc_id").join(near, "term")
            return hits.groupBy("doc_id").agg(F.countDistinct("pos").alias("n")).where(F.col("n") == len(parts)).select("doc_id")
        candidates = all_terms(index, parts)
        here = index.corpus.where(text.ascii_lower(index.record_text()).contains(lower(self.phrase)))
        return here.select("doc_id").join(candidates, "doc_id", "left_semi")

    def tokens(self) -> list[str]:
        return words(self.phrase)


def _with_terms(index: Index, condition: Column) -> DataFrame:
    """Postings of the terms that meet a condition, which a stored vocabulary decides once for each term."""
    if not index.has_vocab:
        return index.postings.where(condition)
    return index.postings.join(index.vocab.where(condition).select("term"), "term", "left_semi")


def all_terms(index: Index, terms: Sequence[str]) -> DataFrame:
    """Ids of documents with every one of the terms: one pass over their postings."""
    wanted = sorted(set(terms))
    found = index.postings.where(F.col("term").isin(*wanted))
    if len(wanted) == 1:
        return found.select("doc_id").distinct()
    return found.groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def token_union(index: Index, tokens: Sequence[str]) -> DataFrame:
    """A bag of ids: one for each posting of each token, repeated tokens again."""
    spark = index.corpus.sparkSession
    wanted = spark.createDataFrame([(t,) for t in tokens], "term string")
    return index.postings.where(F.col("term").isin(*set(tokens))).join(wanted, "term").select("doc_id")


@dataclass(frozen=True)
class Field(Query):
    """A field's text equals the value, with case."""

    field: str
    value: str

    def column(self, index: Index) -> Column | None:
        if self.field not in index.corpus.columns:
            return F.lit(False)
        kind = index.corpus.schema[self.field].dataType
        return F.coalesce(text.to_text(F.col(f"`{self.field}`"), kind) == self.value, F.lit(False))

    def tokens(self) -> list[str]:
        return [lower(self.value)]


@dataclass(frozen=True)
class Wildcard(Query):
    """``*`` and ``?`` over a field's whole text, with case; without a field, over the terms of the index."""

    pattern: str
    field: str = ""

    def expression(self) -> str:
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in self.pattern)
        return rf"(?d)^{body}\z"

    def _match(self, c: Column) -> Column:
        head, star, rest = self.pattern.partition("*")
        if star and not rest and "?" not in head:
            return c.startswith(head) & ~F.substring(c, len(head) + 1, 1 << 30).contains("\n")
        return c.rlike(self.expression())

    def column(self, index: Index) -> Column | None:
        if not self.field:
            return None
        if self.field not in index.corpus.columns:
            return F.lit(False)
        kind = index.corpus.schema[self.field].dataType
        return F.coalesce(self._match(text.to_text(F.col(f"`{self.field}`"), kind)), F.lit(False))

    def ids(self, index: Index) -> DataFrame:
        if self.field:
            return super().ids(index)
        return _with_terms(index, self._match(F.col("term"))).select("doc_id").distinct()

    def tokens(self) -> list[str]:
        return [lower(self.pattern)]


@dataclass(frozen=True)
class Range(Query):
    """Both bounds included; texts that are numbers count."""

    field: str
    least: float
    most: float

    def column(self, index: Index) -> Column | None:
        if self.field not in index.corpus.columns:
            return F.lit(False)
        c = F.col(f"`{self.field}`")
        kind = index.corpus.schema[self.field].dataType.typeName()
        numeric = kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")
        if not numeric:
            c = text.to_number(c.cast("string"))
        return F.coalesce(c.between(self.least, self.most), F.lit(False))

    def tokens(self) -> list[str]:
        return []


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms of the index, or tokens of one field, within ``k`` edits."""

    term: str
    k: int = 2
    field: str = ""

    def column(self, index: Index) -> Column | None:
        if not self.field:
            return None
        if self.field not in index.corpus.columns:
            return F.lit(False)
        kind = index.corpus.schema[self.field].dataType
        found = text.tokenize(text.to_text(F.col(f"`{self.field}`"), kind))
        return F.coalesce(F.exists(found, lambda t: text.within(t, F.lit(lower(self.term)), self.k)), F.lit(False))

    def ids(self, index: Index) -> DataFrame:
        return super().ids(index) if self.field else Term(self.term, True, self.k).ids(index)

    def tokens(self) -> list[str]:
        return [lower(self.term)]


@dataclass(frozen=True)
class Sql(Query):
    """A SQL predicate over the record, and another query's hits if there is one. Errors in it are raised."""

    predicate: str
    inner: Query | None = None

    def column(self, index: Index) -> Column | None:
        own = F.coalesce(F.expr(self.predicate), F.lit(False))
        return own if self.inner is None else None

    def ids(self, index: Index) -> DataFrame:
        found = index.corpus.where(F.expr(self.predicate)).select("doc_id")
        return found if self.inner is None else found.join(self.inner.ids(index), "doc_id", "left_semi")


@dataclass(frozen=True)
class Filter(Query):
    """Conditions of which all (``and``) or any (``or``) hold, or don't if ``reverse``; and another query's hits."""

    conditions: tuple[filters.Condition, ...]
    how: str = "and"
    reverse: bool = False
    inner: Query | None = None

    def column(self, index: Index) -> Column | None:
        if self.inner is not None or any(c.keys is not None for c in self.conditions):
            return None
        found = filters.combine([c.column() for c in self.conditions], self.how)
        return F.coalesce(~found if self.reverse else found, F.lit(False))

    def ids(self, index: Index) -> DataFrame:
        found = filters.apply(index.corpus, self.conditions, self.how, self.reverse).select("doc_id")
        return found if self.inner is None else found.join(self.inner.ids(index), "doc_id", "left_semi")

    def tokens(self) -> list[str]:
        return self.inner.tokens() if self.inner else []


@dataclass(frozen=True)
class Bool(Query):
    parts: tuple[Query, ...]
    how: str = "and"

    def column(self, index: Index) -> Column | None:
        each = [p.column(index) for p in self.parts]
        return None if any(c is None for c in each) else filters.combine(each, self.how)

    def ids(self, index: Index) -> DataFrame:
        fused = self.column(index)
        if fused is not None:
            return index.corpus.where(fused).select("doc_id")
        if self.how.lower() == "or":
            return reduce(DataFrame.union, [p.ids(index) for p in self.parts]).distinct()
        exact = [p.term for p in self.parts if isinstance(p, Term) and not p.fuzzy]
        local = [p for p in self.parts if p.column(index) is not None]
        rest = [p for p in self.parts if not (isinstance(p, Term) and not p.fuzzy) and p.column(index) is None]
        sets = [p.ids(index) for p in rest]
        if exact:
            sets.append(all_terms(index, [lower(t) for t in exact]))
        if local:
            sets.append(index.corpus.where(filters.combine([p.column(index) for p in local])).select("doc_id"))
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets)

    def tokens(self) -> list[str]:
        return [t for p in self.parts for t in p.tokens()]


@dataclass(frozen=True)
class Not(Query):
    inner: Query

    def column(self, index: Index) -> Column | None:
        found = self.inner.column(index)
        return None if found is None else ~found

    def ids(self, index: Index) -> DataFrame:
        fused = self.column(index)
        if fused is not None:
            return index.corpus.where(fused).select("doc_id")
        return index.corpus.select("doc_id").join(self.inner.ids(index), "doc_id", "left_anti")

    def tokens(self) -> list[str]:
        return self.inner.tokens()


@dataclass(frozen=True)
class Custom(Query):
    """A user's own node: a function from the index to (doc_id)."""

    function: Callable[[Index], DataFrame]

    def ids(self, index: Index) -> DataFrame:
        return self.function(index).select("doc_id").distinct()
