"""Exact dedup: a log-structured merge index from text digest to smallest document id.

Each task is a memtable: it gathers (digest, id) entries and, when full, flushes a run sorted by
digest, with its Bloom filter.  Runs are written to the shared folder as Parquet.  Compaction merges
the runs by digest, keeping the smallest identifier, and writes runs of the next level, again sorted
and with filters.  A digest that two or more rows have is a hit.

Hits are verified on the bytes, and only their texts are moved: a filter over the hits is broadcast
and read before the exchange.  Equal texts are combined in each task first, so any number of copies
costs one row a task; the copies' ids then come from the runs, which hold no text.  A later batch is
probed against the filters of an index with ``probe``.

Defined results: a null text is no copy of anything; empty texts are copies of each other; of equal
texts the smallest doc_id stays, a null doc_id only where no row of that text has an id; of rows that
repeat id and text one stays; an id that also has other texts keeps those.  Empty tables give empty
results.  Other columns are carried by ``drop_copies`` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import bloom_filter, column_bytes, cut_lineage, filter_of, fresh, may_contain, release, written

#: Entries that a memtable holds before it is flushed, and digests of a compacted run.
MEMTABLE = 200_000
#: Bytes of filters that are broadcast; beyond, texts (or later batches) meet the hits by a plain join.
MAX_FILTER_BYTES = 8_000_000


def digest(text: str | Column) -> Column:
    """32 bytes of SHA-256, null of a null; computed in the JVM."""
    return F.unhex(F.sha2(text, 256))


def _keys(column: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.ascontiguousarray(column_bytes(column)[0].reshape(-1, 32)[:, :8]).view(np.uint64)[:, 0]


def _flush(table: pa.Table) -> pa.RecordBatch:
    """A run: sorted, and its filter on the first row."""
    table = table.sort_by([("digest", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    batch = table.select(["digest", "doc_id", "copies"]).to_batches()[0]
    mark = pa.array([bloom_filter(_keys(batch.column("digest")))] + [None] * (len(batch) - 1), pa.binary())
    return pa.RecordBatch.from_arrays([*batch.columns, mark], names=["digest", "doc_id", "copies", "filter"])


_RUN = "digest binary, doc_id bigint, copies bigint, filter binary"


def runs(docs: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs (digest, doc_id, copies, filter), a row for each digest and id; the filter is on a run's first row."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        entries = pa.Table.from_batches(held).group_by(["digest", "doc_id"]).aggregate([([], "count_all")])
        return _flush(entries.rename_columns({"count_all": "copies"}))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for lo in range(0, len(batch), memtable):
                held.append(batch.slice(lo, memtable))
                rows += len(held[-1])
                if rows >= memtable:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    rows = docs.where("text IS NOT NULL").select(digest("text").alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.mapInArrow(build, _RUN)


def compact(written_runs: DataFrame) -> DataFrame:
    """Runs of the next level: (digest, doc_id, copies, filter), one row for each digest, with its smallest id."""
    merged = written_runs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _flush(pa.Table.from_batches([batch]))

    return merged.sortWithinPartitions("digest").mapInArrow(build, _RUN)


def build_index(docs: DataFrame, memtable: int = MEMTABLE) -> tuple[DataFrame, DataFrame]:
    """(runs, compacted runs), both written to the shared folder."""
    first = written(runs(docs, memtable), "digest-runs")
    return first, written(compact(first), "digest-index")


def _tester(docs: DataFrame, filters: list[bytes]):
    """Arrow UDF digest -> whether one of the filters may contain it."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def test(digests: pa.Array) -> pa.Array:
        there = np.asarray(digests.is_valid())
        found = np.zeros(len(digests), bool)
        keys = _keys(digests.drop_null())
        hit = np.zeros(len(keys), bool)
        for bits in shared.value:
            miss = np.flatnonzero(~hit)
            hit[miss] = may_contain(bits, keys[miss])
        found[there] = hit
        return pa.array(found)

    return F.arrow_udf(test, "boolean")


def _gone(docs: DataFrame) -> tuple[DataFrame, bytes | None]:
    """(digest, clash, doc_id, kept_doc_id, n) of what goes, n rows of each, and a filter over the digests.

    ``clash``: the text, where texts that differ share a digest; else null.
    """
    first, index = build_index(docs)
    hits = index.where("copies > 1").select("digest")
    bits = filter_of(hits, "digest", _keys, MAX_FILTER_BYTES)
    rows = docs.where("text IS NOT NULL").select(digest("text").alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(hits, "digest", "left_semi") if bits is None else rows.where(_tester(docs, [bits])("digest"))
    # a class is all rows with the same bytes; what the filter lets through by mistake is alone in its class
    classes = cut_lineage(rows.groupBy("digest", "text").agg(F.min("doc_id").alias("kept_doc_id"), F.count("*").alias("rows")).select("digest", "kept_doc_id", "rows"))
    clashes = cut_lineage(classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    entries = first.groupBy("digest", "doc_id").agg(F.sum("copies").alias("n"))
    named = ["digest", "clash", "doc_id", "kept_doc_id", "n"]
    gone = entries.join(classes.where("rows > 1"), "digest").withColumn("clash", F.lit(None).cast("string")).select(*named)
    if not clashes.isEmpty():
        theirs = rows.join(clashes, "digest", "left_semi")
        kept = theirs.groupBy("digest", "text").agg(F.min("doc_id").alias("kept_doc_id"))
        each = theirs.groupBy("digest", "text", "doc_id").agg(F.count("*").alias("n"))
        gone = gone.join(clashes, "digest", "left_anti").union(each.join(kept, ["digest", "text"]).withColumnRenamed("text", "clash").select(*named))
    stays = F.when(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")), 1).otherwise(0)
    return gone.withColumn("n", F.col("n") - stays).where("n > 0"), bits


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) of every row whose text another row keeps.

    A row that repeats the kept row's id and text is listed with ``doc_id = kept_doc_id``.
    """
    gone, _ = _gone(docs)
    # in two steps, so that no list grows with the number of repeated rows
    some = gone.select("doc_id", "kept_doc_id", "n", F.explode(F.expr("sequence(0L, n - 1, 100000L)")).alias("at"))
    return some.select("doc_id", "kept_doc_id", F.explode(F.expr("sequence(1L, least(100000L, n - at))")).alias("each")).drop("each")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns; rows without text stay.

    Only rows that the filter lets through meet the copies; the others don't move.
    """
    names = {x: fresh(docs, f"_gone_{x}") for x in ("digest", "clash", "doc_id", "again")}
    gone, bits = _gone(docs)
    gone = gone.withColumn("again", F.col("doc_id").eqNullSafe(F.col("kept_doc_id")))
    gone = cut_lineage(gone.select(*[F.col(x).alias(name) for x, name in names.items()]))
    maybe = F.lit(True) if bits is None else F.coalesce(_tester(docs, [bits])(digest(docs["text"])), F.lit(False))
    met, sure = docs.where(maybe), docs.where(~maybe)
    clash = F.col(names["clash"])
    key = (digest(met["text"]) == F.col(names["digest"])) & met["doc_id"].eqNullSafe(F.col(names["doc_id"])) & (clash.isNull() | (clash == met["text"]))
    kept = met.join(gone, key, "left_anti")
    repeated = gone.where(F.col(names["again"]))
    if not repeated.isEmpty():
        kept = kept.unionByName(met.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "text"]))
    return sure.unionByName(kept)


def probe(index: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) of rows of ``new`` whose text ``old`` has, by the compacted index of ``old``.

    Digests that no run's filter may contain are dropped before anything moves.
    """
    filters = index.where("filter IS NOT NULL").select("filter", F.octet_length("filter").alias("size"))
    rows = new.where("text IS NOT NULL").select(digest("text").alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if (filters.agg(F.sum("size")).first()[0] or 0) <= MAX_FILTER_BYTES:
        rows = rows.where(_tester(new, [bytes(r[0]) for r in filters.select("filter").collect()])("digest"))
    found = rows.join(index.select("digest", F.col("doc_id").alias("there")), "digest")
    texts = old.select(F.col("doc_id").cast("bigint").alias("there"), F.col("text").alias("text_there"))
    return found.join(texts, found["there"].eqNullSafe(texts["there"]) & (found["text"] == texts["text_there"])).select("doc_id", found["there"].alias("kept_doc_id")).distinct()
