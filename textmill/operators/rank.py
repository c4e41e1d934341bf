"""Scores, order, pages, and retrieval of many queries in one job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.index import Index, parts_for
from textmill.operators.query import Query, all_terms, words


def bm25_weight(df: Column, n: Column, avgdl: Column, tf: Column, dl: Column, k1: float, b: float) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(index: Index, tokens: Sequence[str], hits: DataFrame | None = None) -> DataFrame:
    """(doc_id, score). With ``hits``: of exactly these, 0 where no token occurs. Repeated tokens count again."""
    spark = index.corpus.sparkSession
    config = index.config
    if not tokens:
        none = index.corpus.limit(0) if hits is None else hits
        return none.select("doc_id", F.lit(0.0).alias("score"))
    counted = Counter(tokens)
    wanted = spark.createDataFrame(list(counted.items()), "term string, qtf long")
    found = index.postings.where(F.col("term").isin(*counted))
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = found.join(frequency.join(wanted, "term"), "term").crossJoin(F.broadcast(index.stats))  # stats: one row
    weight = F.col("qtf") * bm25_weight(F.col("df"), F.col("n"), F.col("avgdl"), F.col("tf"), F.col("dl"), config.k1, config.b)
    scored = weighted.groupBy("doc_id").agg(F.sum(weight).alias("score"))
    if hits is None:
        return scored
    return hits.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def tf_scores(index: Index, term: str) -> DataFrame:
    """(doc_id, score) by the frequency of one exact term."""
    return index.postings.where(F.col("term") == term.lower()).select("doc_id", F.col("tf").cast("double").alias("score"))


def conjunctive(index: Index, query: str) -> DataFrame:
    """The fast path of plain queries: one word by frequency, several by AND with score 1."""
    terms = query.lower().split()
    if len(terms) == 1:
        return tf_scores(index, terms[0])
    return all_terms(index, terms).select("doc_id", F.lit(1.0).alias("score"))


def search(index: Index, query: Query) -> DataFrame:
    """(doc_id, score) of the query's hits."""
    return bm25(index, query.tokens(), query.ids(index))


def ordering(index: Index, sort_field: str | None = None, descending: bool = False) -> list[Column]:
    """By the field, nulls last, then by score, then by id."""
    best = [F.desc("score"), F.asc("doc_id")]
    if not sort_field:
        return best
    first = F.col(f"`{sort_field}`")
    return [first.desc_nulls_last() if descending else first.asc_nulls_last(), *best]


def ranked(hits: DataFrame, order: Sequence[Column], top: int) -> DataFrame:
    """The first ``top`` hits with their rank from 1: a top-k, so the window sees ``top`` rows only."""
    best = hits.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@dataclass(frozen=True)
class Page:
    results: DataFrame
    total: int
    page: int
    per_page: int
    total_pages: int
    next_page: int | None
    prev_page: int | None


def page_bounds(total: int, page: int, per_page: int) -> tuple[int, int, int]:
    """(page, per_page, pages): a size below 1 means 10, a page outside goes to the nearest one."""
    size = 10 if per_page < 1 else per_page
    pages = -(-total // size)
    return (1 if not total else min(max(page, 1), pages)), size, pages


def paginate(hits: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 10) -> Page:
    total = hits.count()
    page, size, pages = page_bounds(total, page, per_page)
    rows = hits.orderBy(*order).offset((page - 1) * size).limit(size)
    return Page(rows, total, page, size, pages, page + 1 if page < pages else None, page - 1 if total and page > 1 else None)


def fetch(index: Index, hits: DataFrame) -> DataFrame:
    """The records of hits, with their score and rank; hits without a record go."""
    return hits.join(index.corpus, "doc_id")


#: Pairs of a query and a term that are broadcast; more of them meet postings in joins by term.
MAX_ASKED = 100_000


def batch_topk(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, doc_id, score): BM25 over any number of queries (qid, term) at once.

    Terms meet postings in one join whatever the number of queries; a query is an OR of its terms.  The
    postings found are spread by document before queries multiply them: a document's scores are whole in
    one partition, and only each partition's best k of a query move on.
    """
    config = index.config
    terms = queries.where("term IS NOT NULL").groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = terms.select("term").distinct()
    if index.has_vocab:
        frequency = index.vocab.join(asked, "term", "left_semi").select("term", "df")
    else:
        frequency = index.postings.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # else all postings are spread by term before the other side's size is known
    small = F.broadcast if terms.limit(MAX_ASKED + 1).count() <= MAX_ASKED else lambda df: df
    weight = bm25_weight(F.col("df"), F.col("n"), F.col("avgdl"), F.col("tf"), F.col("dl"), config.k1, config.b)
    weighted = index.postings.join(small(frequency), "term").crossJoin(F.broadcast(index.stats)).select("term", "doc_id", weight.alias("w"))  # stats: one row
    spread = weighted.repartition(parts_for(index.postings), "doc_id")  # a fixed number: what is read here is small beside what it makes
    # a term's queries as one list: a row for each pair of a posting and a query is made only where it is summed up
    lists = terms.groupBy("term").agg(F.collect_list(F.struct("qid", "qtf")).alias("asked"))
    each = spread.join(small(lists), "term").select("doc_id", "w", F.explode("asked").alias("a"))
    scored = each.groupBy(F.col("a.qid").alias("qid"), "doc_id").agg(F.sum(F.col("a.qtf") * F.col("w")).alias("score"))
    # equal sums of differently ordered doubles may differ in their last bits: ties are decided at 9 decimals
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def batch_terms(queries: DataFrame, id_col: str, text_col: str, tokens) -> DataFrame:
    """(qid, term) of query texts; ``tokens`` maps a text column to an array of terms."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(tokens(F.col(text_col))).alias("term"))


def merge_shards(shards: Sequence[DataFrame], k: int = 10) -> DataFrame:
    """(doc_id, score, rank): the best k of several lists (doc_id, score), each of which needs only its own best k."""
    order = [F.desc("score"), F.asc("doc_id")]
    best = shards[0].orderBy(*order).limit(k)
    for shard in shards[1:]:
        best = best.unionByName(shard.orderBy(*order).limit(k))
    return ranked(best, order, k)


def query_words(query: str) -> list[str]:
    return words(query)
