"""Around search: highlights, suggestions, corrections, query log, metrics, Bloom filter."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text
from textmill.operators.index import Index
from textmill.operators.query import lower


def mark(c: Column, terms: Sequence[str]) -> Column:
    """Every occurrence of a term, in any case, between ``<mark>`` and ``</mark>``; longer terms first."""
    wanted = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not wanted:
        return c
    return F.regexp_replace(c, F.lit("(?i)(" + "|".join(map(re.escape, wanted)) + ")"), F.lit("<mark>$1</mark>"))


def highlight(records: DataFrame, terms: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Add ``highlights``: for each text field that a term occurs in, its marked text."""
    names = [f.name for f in records.schema.fields if isinstance(f.dataType, T.StringType) and (fields is None or f.name in fields)]
    if not names:
        return records.withColumn("highlights", F.create_map().cast("map<string,string>"))
    pairs = [x for n in names for x in (F.lit(n), F.struct(F.col(f"`{n}`").alias("old"), mark(F.col(f"`{n}`"), terms).alias("new")))]
    changed = F.map_filter(F.create_map(*pairs), lambda _, v: v["new"] != v["old"])
    return records.withColumn("highlights", F.transform_values(changed, lambda _, v: v["new"]))


def suggest(index: Index, prefix: str, n: int = 10) -> DataFrame:
    """(term, cf): the most frequent terms with the prefix."""
    return index.vocab.where(F.col("term").startswith(lower(prefix))).orderBy(F.desc("cf"), "term").limit(n).select("term", "cf")


#: Unknown words that are compared with the whole vocabulary: they alone are broadcast.
MAX_ASKED = 10_000


def autocorrect(index: Index, tokens: DataFrame, k: int = 2) -> DataFrame:
    """(token, corrected): a token of the index stays; else the nearest term within ``k`` edits, else itself.

    Up to ``MAX_ASKED`` unknown tokens are sent to the vocabulary and meet terms of like length and
    letters.  More of them meet it in an equi-join on deletion variants: two words within k edits share
    a variant with at most k characters deleted from each.
    """
    asked = tokens.select("token").distinct()
    vocab = index.vocab.select("term")
    known = asked.join(vocab, F.col("token") == F.col("term"), "left_semi")
    unknown = asked.join(vocab, F.col("token") == F.col("term"), "left_anti")
    if unknown.limit(MAX_ASKED + 1).count() <= MAX_ASKED:
        few = F.broadcast(unknown.select("token", F.length("token").alias("size"), letters(F.col("token")).alias("own")))
        terms = vocab.select("term", letters(F.col("term")).alias("theirs"), F.explode(F.sequence(F.length("term") - k, F.length("term") + k)).alias("size"))
        near = terms.join(few, "size").where(F.bit_count(F.col("own").bitwiseXOR(F.col("theirs"))) <= 2 * k)
        near = near.select("token", "term")
    else:
        left = unknown.select("token", F.explode(deletions(F.col("token"), k)).alias("key"))
        right = vocab.select("term", F.explode(deletions(F.col("term"), k)).alias("key"))
        near = left.join(right, "key").select("token", "term").distinct()
    near = near.withColumn("d", F.levenshtein("token", "term", k)).where("d >= 0")
    best = near.groupBy("token").agg(F.min(F.struct("d", "term")).alias("best")).select("token", F.col("best.term").alias("term"))
    fixed = unknown.join(best, "token", "left").select("token", F.coalesce("term", "token").alias("corrected"))
    return known.select("token", F.col("token").alias("corrected")).unionByName(fixed)


def letters(word: Column) -> Column:
    """A bit for each letter or digit that a word has; an edit changes at most two of them."""
    out = F.lit(0).cast("bigint")
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_"):
        out = out.bitwiseOR(F.when(F.contains(word, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out


def deletions(word: Column, k: int) -> Column:
    """The word and all that is left of it with up to k characters deleted."""
    out = F.array(word)
    for _ in range(k):
        shorter = F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def last_entries(log: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The newest n entries of a log."""
    return log.orderBy(F.desc(order)).limit(n)


def popular_queries(log: DataFrame, n: int = 10) -> DataFrame:
    """(query, times) of the most frequent queries."""
    return log.groupBy("query").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "query").limit(n)


def latency_stats(log: DataFrame, column: str = "latency_ms") -> DataFrame:
    """(queries, min_ms, max_ms, avg_ms)."""
    c = F.col(column)
    return log.agg(F.count(c).alias("queries"), F.min(c).alias("min_ms"), F.max(c).alias("max_ms"), F.avg(c).alias("avg_ms"))


def hit_rate(log: DataFrame, hit: Column) -> DataFrame:
    """(total, hits, rate)."""
    hits = F.sum(F.when(hit, 1).otherwise(0))
    return log.agg(F.count("*").alias("total"), hits.alias("hits"), F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0).alias("rate"))


def running_mean(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, mean): the halving mean m = (m + x) / 2 over a key's values in order, begun with the first."""
    listed = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("x"))
    values = F.transform("x", lambda s: s[value].cast("double"))
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return listed.select(key, F.aggregate(rest, values[0], lambda m, x: (m + x) / 2).alias("mean"))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) for n elements at false-positive rate p."""
    bits = max(1, int(-1.44 * n * math.log2(p)))
    return bits, max(1, int(round(0.693 * bits / max(n, 1))))


def bloom_positions(element: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(element, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def bloom_build(elements: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the filter in words of 32 bits; its size depends on ``bits`` alone."""
    at = elements.select(F.explode(bloom_positions(F.col(column), bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32).cast("bigint").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("mask"))


def bloom_contains(filter_: DataFrame, elements: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(element, maybe); never wrongly false."""
    asked = elements.select(F.col(column).alias("element")).distinct()
    at = asked.select("element", F.explode(bloom_positions(F.col("element"), bits, hashes)).alias("at"))
    at = at.withColumn("word", F.floor(F.col("at") / 32).cast("bigint"))
    hit = at.join(filter_, "word", "left").withColumn("hit", F.coalesce(F.getbit("mask", F.pmod(F.col("at"), F.lit(32)).cast("int")), F.lit(0)))
    return hit.groupBy("element").agg((F.min("hit") == 1).alias("maybe"))


def per_query_top(scored: DataFrame, key: str, k: int) -> DataFrame:
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def listing(corpus: DataFrame, page: int = 1, size: int = 20, condition: Column | None = None) -> DataFrame:
    """A page of records in id order; a page beyond the last is empty."""
    page, size = max(page, 1), 20 if size < 1 else size
    rows = corpus if condition is None else corpus.where(condition)
    return rows.orderBy("doc_id").offset((page - 1) * size).limit(size)
