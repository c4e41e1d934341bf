"""Postings in blocks, made by Python workers from Arrow buffers.

A block holds consecutive records of one file.  Its postings are lists by term, so that sorting an index
moves a list where it else would move each posting.  The functions that workers run are closures that
import what they need: executors need not have this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from textmill.operators.index import Index

#: Bytes of text in a block (64 more count for each record); postings in a row, so that rows are of like weight.
BLOCK, ROW = 32 << 20, 32


def _file(by_file: bool) -> Column:
    return (F.xxhash64(F.input_file_name()) if by_file else F.lit(0).cast("bigint")).alias("file")


def blocks_of(index: Index, block: int = BLOCK, row: int = ROW, by_file: bool = False) -> DataFrame:
    """(term, first, df, cf, ids, tfs, dls): each block's postings, ``row`` at most in a row.

    ``first`` is the first of the ids.  The row without a term lists all records of a block with their lengths.
    ``by_file``: the corpus is read from files, and blocks end where these end.
    """
    plain = index.plain_text()
    source = index.corpus.select("doc_id", _file(by_file), (index.tokens if plain is None else plain).alias("value"))
    stop = index.plain_stop_words() if plain is not None else None
    return source.mapInArrow(_maker(stop, block, row), "term string, first bigint, df bigint, cf bigint, ids array<bigint>, tfs array<int>, dls array<int>")


def _maker(stop: tuple[str, ...] | None, block: int, row: int) -> Callable[[Iterator], Iterator]:
    """``stop``: what isn't indexed of a text's tokens; None: the column has lists of terms."""

    def make(batches: Iterator) -> Iterator:
        from array import array
        from collections import Counter, defaultdict

        import numpy as np
        import pyarrow as pa

        # a word's bytes in lower case, all others as blanks: bytes of other scripts are 128 and more
        table = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c == 95 else 32 for c in range(256))
        unwanted = [w.encode() for w in stop or ()]
        kind = pa.string() if stop is None else pa.binary()

        def packed(ids: list, lengths: array, distinct: array, code: dict, codes: array, tfs: array) -> pa.RecordBatch:
            c, tf = np.frombuffer(codes, np.int32), np.frombuffer(tfs, np.int32)
            order = np.argsort(c, kind="stable")
            c, tf, at = c[order], tf[order], np.repeat(np.arange(len(ids)), np.frombuffer(distinct, np.int32))[order]
            runs = np.flatnonzero(np.r_[np.ones(min(1, len(c)), bool), c[1:] != c[:-1]])
            place = np.arange(len(c)) - np.repeat(runs, np.diff(np.r_[runs, len(c)]))
            starts = np.flatnonzero(place % row == 0)
            ends, dl, known = np.r_[starts[1:], len(c)][: len(starts)], np.frombuffer(lengths, np.int32), pa.array(ids, pa.int64())
            offsets = np.r_[starts, len(c), len(c) + len(ids)].astype(np.int32)
            names = pa.array(list(code), kind).cast(pa.string())
            every = np.r_[at, np.arange(len(ids))]
            tf_offsets = np.r_[starts, len(c), len(c)].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([names.take(pa.array(c[starts])), pa.nulls(1, pa.string())]),
                    known.take(pa.array(np.r_[at[starts], 0])),
                    pa.array(np.r_[ends - starts, len(ids)].astype(np.int64)),
                    pa.array(np.r_[np.add.reduceat(tf, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64), dl.sum(dtype=np.int64)]),
                    pa.ListArray.from_arrays(pa.array(offsets), known.take(pa.array(every))),
                    pa.ListArray.from_arrays(pa.array(tf_offsets), pa.array(tf)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(dl[every])),
                ],
                names=["term", "first", "df", "cf", "ids", "tfs", "dls"],
            )

        def fresh() -> tuple:
            code: defaultdict = defaultdict()
            code.default_factory = code.__len__
            return [], array("i"), array("i"), code, array("i"), array("i")

        held, size, file = fresh(), 0, None
        for batch in batches:
            values = batch.column(2)
            values = values.to_pylist() if stop is None else values.cast(pa.binary()).to_pylist()
            for doc_id, of, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                if held[0] and (of != file or size >= block):
                    yield packed(*held)
                    held, size = fresh(), 0
                if stop is None:
                    counts = Counter(value or ())
                    size += 64 + 8 * counts.total()
                else:
                    counts = Counter((value or b"").translate(table).split())
                    for word in unwanted:
                        counts.pop(word, None)
                    size += 64 + len(value or b"")
                file = of
                ids, lengths, distinct, code, codes, tfs = held
                ids.append(doc_id)
                lengths.append(sum(counts.values()))
                distinct.append(len(counts))
                codes.extend(map(code.__getitem__, counts))
                tfs.extend(counts.values())
        if held[0]:
            yield packed(*held)

    return make


def postings_in(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl), in the order of the blocks' rows."""
    each = blocks.where("term IS NOT NULL").select("term", "tfs", "dls", F.posexplode("ids").alias("k", "doc_id"))
    return each.select("term", "doc_id", *[F.get(c, "k").cast("bigint").alias(n) for c, n in (("tfs", "tf"), ("dls", "dl"))])


def doc_stats_in(blocks: DataFrame) -> DataFrame:
    """(doc_id, dl) of all records."""
    each = blocks.where("term IS NULL").select("dls", F.posexplode("ids").alias("k", "doc_id"))
    return each.select("doc_id", F.get("dls", "k").cast("bigint").alias("dl"))


def vocab_in(blocks: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return blocks.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def runs_of(postings: DataFrame, by_file: bool = False) -> DataFrame:
    """(term, first, last, postings, rest): runs of a term's ids in a partition's order, cut at the ends of files and batches.

    ``rest``: bytes of the frequencies and of the steps between the ids, at seven bits a byte.
    """
    listed = postings.select("term", "doc_id", "tf", _file(by_file))
    return listed.mapInArrow(_measurer(), "term string, first bigint, last bigint, postings bigint, rest bigint")


def _measurer() -> Callable[[Iterator], Iterator]:
    def measure(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def size(values: np.ndarray) -> np.ndarray:
            out = np.ones(len(values), np.int64)
            for n in range(1, 9):
                out += values >= 1 << 7 * n
            return out

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            term, ids, tfs, file = batch.column(0), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            step = np.diff(ids)
            other = pc.fill_null(pc.not_equal(term.slice(1), term.slice(0, rows - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.r_[0, 1 + np.flatnonzero(other | (step < 0) | (np.diff(file) != 0))]
            ends = np.r_[starts[1:], rows]
            bytes_ = size(tfs)
            bytes_[1:] += size(step)
            bytes_[starts[1:]] -= size(step[starts[1:] - 1])
            yield pa.RecordBatch.from_arrays(
                [term.take(pa.array(starts)), pa.array(ids[starts]), pa.array(ids[ends - 1]), pa.array(ends - starts), pa.array(np.add.reduceat(bytes_, starts))],
                names=["term", "first", "last", "postings", "rest"],
            )

    return measure


def by_id(corpus: DataFrame, parts: int) -> DataFrame:
    """The corpus in ``parts`` ranges of doc_id, each sorted. The ranges are decided from the ids alone: no text is read for them."""
    shares = [k / parts for k in range(1, parts)]
    bounds = corpus.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] if shares else None
    range_ = "_range"
    while range_ in corpus.columns:
        range_ += "_"
    below: Column = F.lit(0)
    if bounds:
        below = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("doc_id"))), F.lit(0))
    return corpus.withColumn(range_, below).repartitionById(parts, range_).drop(range_).sortWithinPartitions("doc_id")
