"""Suffix-array dedup: passages of many words that repeat across documents, by sparse suffix arrays.

Only suffixes at content-selected positions are retained: a word position is selected if the hash of
its ``seed`` words is the least of some ``words - seed + 1`` neighbouring ones (a minimiser), so every
passage of ``words`` words has a selected position, the same one in each of its copies.

1. Each selected position gives (seed hash, document, position); seeds of one document only go.
2. Positions that are left give the suffix (``words`` words) and the words before it that a passage
   through this position can have, as 32-bit word hashes.
3. Suffixes with equal seeds meet, sorted.  The longest common prefix with both neighbours bounds
   how far any match reaches to the right; within that bound each extension to the left is compared
   again, in sorted order, with its neighbours.  A passage found twice is marked in full.
4. Marked passages of a document are merged to maximal spans.

The seeds that are left are sent to the texts as a filter, so no text moves; where it would exceed
``max_filter_bytes``, positions and texts are joined by document.  Seeds that more than ``crowd``
positions share never meet in one task: their passages are counted in each task first, and those that
two documents have are joined back, with the same result.  Every repeated passage of ``words`` words
or more is found.

Words are separated by ASCII white space and compared by 31 bits of their hashes: passages that differ
in one word only pass for equal with a probability of 2**-31, in more words with less.  Defined
results: null, empty and shorter texts have no spans; rows without doc_id are left out; rows that
share a doc_id are one document, so they don't repeat each other; a passage that repeats only within
one document isn't reported.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import GRAPHIC, PIECE, U64, Words, column_bytes, cut_lineage, filter_of, may_contain, mix, row_slices, word_table, written

_Q = 0xD6E8FEB86659FD93
_Q_INV = pow(_Q, -1, 1 << 64)
_TOP = np.iinfo(np.uint64).max


@dataclass(frozen=True)
class Settings:
    """``words``: least length of a passage; ``seed``: words of a selected position's hash."""

    words: int = 50
    seed: int = 10
    crowd: int = 100_000
    max_filter_bytes: int = 32_000_000

    @property
    def window(self) -> int:
        return self.words - self.seed + 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * _powers(_Q, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_Q_INV, n - k + 1))


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each w neighbours."""
    pick = np.minimum if least else np.maximum
    if len(x) < w:
        return x[:0]
    span = 1
    while 2 * span <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def selected(words: Words, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, seed hash) of the minimisers of all texts."""
    k, w, n = settings.seed, settings.window, len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < settings.words:
        return none, none, np.zeros(0, U64)
    g = rolling(words.hashes, k)
    # windows lie in one text: position i begins one if settings.words words follow in its text
    room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)
    least = sliding(g, w, least=True)
    least[room[: len(least)] < settings.words] = 0
    wall = np.zeros(w - 1, U64)
    reach = sliding(np.concatenate([wall, least, wall]), w, least=False)
    at = np.flatnonzero((reach == g) & (reach > 0))
    text = np.searchsorted(words.first, at, "right") - 1
    return text, at - words.first[text], g[at]


def _tables(batch: pa.RecordBatch, settings: Settings) -> Iterator[tuple[int, int, Words]]:
    data, offsets = column_bytes(batch.column("text"))
    for lo, hi in row_slices(offsets, PIECE):
        yield lo, hi, word_table(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], GRAPHIC)


def contexts(words: Words, text: np.ndarray, at: np.ndarray, settings: Settings) -> np.ndarray:
    """For each position the window - 1 words before and the ``words`` words from it; 0 outside the text."""
    before, after = settings.window - 1, settings.words
    short = (words.hashes >> U64(32)).astype(np.uint32) | np.uint32(1)
    where = (words.first[text] + at)[:, None] + np.arange(-before, after)
    inside = (where >= words.first[text][:, None]) & (where < words.first[text + 1][:, None])
    return np.where(inside, short[np.clip(where, 0, len(short) - 1)], np.uint32(0))


def window_hashes(context: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Column s: hash of the passage that begins s words before the position, and whether it lies in the text."""
    n, width = context.shape
    sums = np.zeros((n, width + 1), U64)
    np.cumsum(context * _powers(_Q, width), axis=1, out=sums[:, 1:])
    hashed = mix((sums[:, settings.words :] - sums[:, : -settings.words]) * _powers(_Q_INV, settings.window))
    bad = np.zeros((n, width + 1), np.int32)
    np.cumsum(context == 0, axis=1, out=bad[:, 1:])
    return hashed[:, ::-1], (bad[:, settings.words :] == bad[:, : -settings.words])[:, ::-1]


def repeated(seeds: np.ndarray, docs: np.ndarray, context: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): the extensions to the left, least and most, with which rows repeat.

    Rows are sorted by seed and suffix; all rows of a seed are here.
    """
    suffix = context[:, settings.window - 1 :]
    differs = suffix[1:] != suffix[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), settings.words)
    common[seeds[1:] != seeds[:-1]] = 0
    reach = np.zeros(len(seeds), np.int64)
    reach[1:] = common
    reach[:-1] = np.maximum(reach[:-1], common)
    hashed, inside = window_hashes(context, settings)
    shift = np.arange(settings.window)
    row, s = np.nonzero(inside & (settings.words - shift <= reach[:, None]))
    none = np.zeros(0, np.int64)
    if not len(row):
        return none, none, none
    key = mix(hashed[row, s] ^ mix(seeds[row].view(U64) + s.astype(U64)))
    order = np.argsort(key, kind="stable")
    row, s, key = row[order], s[order], key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    doc = docs[row]
    many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    many = np.repeat(many, np.diff(np.append(begin, len(row))))
    row, s = row[many], s[many]
    first, last = np.full(len(seeds), settings.window), np.full(len(seeds), -1)
    np.minimum.at(first, row, s)
    np.maximum.at(last, row, s)
    found = np.flatnonzero(last >= 0)
    return found, first[found], last[found]


_AROUND = "seed bigint, suffix binary, doc_id bigint, at int, before binary"
_PASSAGE = "key bigint, doc_id bigint, at int"


def _surroundings(ids: np.ndarray, words: Words, text: np.ndarray, at: np.ndarray, seeds: np.ndarray, settings: Settings) -> Iterator[pa.RecordBatch]:
    """What is compared of each position; ``ids`` by text."""
    for part in range(0, len(at), 1 << 14):
        t, a, h = (x[part : part + (1 << 14)] for x in (text, at, seeds))
        context = contexts(words, t, a, settings)
        tail = np.ascontiguousarray(context[:, settings.window - 1 :])
        head = np.ascontiguousarray(context[:, : settings.window - 1])
        yield pa.RecordBatch.from_arrays([pa.array(h), _fixed(tail), pa.array(ids[t]), pa.array(a.astype(np.int32)), _fixed(head)], names=["seed", "suffix", "doc_id", "at", "before"])


def _passages(ids: np.ndarray, words: Words, text: np.ndarray, at: np.ndarray, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Every passage through each position, by its hash and beginning."""
    for part in range(0, len(at), 1 << 14):
        t, a = (x[part : part + (1 << 14)] for x in (text, at))
        hashed, inside = window_hashes(contexts(words, t, a, settings), settings)
        row, s = np.nonzero(inside)
        yield pa.RecordBatch.from_arrays([pa.array(mix(hashed[row, s] + U64(1)).view(np.int64)), pa.array(ids[t[row]]), pa.array((a[row] - s).astype(np.int32))], names=["key", "doc_id", "at"])


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): maximal spans covered by passages that other documents have."""
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, _, words in _tables(batch, settings):
                text, at, seed = selected(words, settings)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(ids[lo + text]), pa.array(at.astype(np.int32))], names=["seed", "doc_id", "at"])

    seeds = rows.mapInArrow(select, "seed bigint, doc_id bigint, at int")
    counted = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    shared = cut_lineage(counted.where("lo < hi").select("seed", (F.col("n") > settings.crowd).alias("crowded")))
    plain, crowded = shared.where("NOT crowded").select("seed"), shared.where("crowded").select("seed")
    found = _at(rows, seeds, plain, crowded, _AROUND, _surroundings, settings)
    ordered = found.repartition("seed").sortWithinPartitions("seed", "suffix", "doc_id", "at")
    spans = ordered.mapInArrow(_comparison(settings), "doc_id bigint, start_word int, end_word int")
    if not crowded.isEmpty():
        passages = written(_at(rows, seeds, crowded, crowded.limit(0), _PASSAGE, lambda ids, words, text, at, _, s: _passages(ids, words, text, at, s), settings), "passages")
        several = passages.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
        theirs = passages.join(several, "key", "left_semi").select("doc_id", "at", (F.col("at") + settings.words).cast("int"))
        spans = spans.union(theirs)
    return merge_spans(spans)


#: Seeds that are left out of a filter's hits by name; 8 bytes each.
_MAX_BANNED = 1_000_000


def _at(rows: DataFrame, seeds: DataFrame, wanted: DataFrame, banned: DataFrame, schema: str, make, settings: Settings) -> DataFrame:
    """What ``make`` gives for the positions of the wanted seeds, and for a few others but the banned ones; these match nothing."""
    bits = filter_of(wanted, "seed", lambda c: c.to_numpy(), settings.max_filter_bytes)
    if bits is not None and banned.limit(_MAX_BANNED + 1).count() <= _MAX_BANNED:
        sent = rows.sparkSession.sparkContext.broadcast((bits, banned.toArrow().column("seed").to_numpy()))

        def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                for lo, _, words in _tables(batch, settings):
                    text, at, seed = selected(words, settings)
                    hit = may_contain(sent.value[0], seed) & ~np.isin(seed.view(np.int64), sent.value[1])
                    yield from make(ids[lo:], words, text[hit], at[hit], seed[hit].view(np.int64), settings)

        return rows.mapInArrow(sieve, schema)
    marks = seeds.join(wanted, "seed").groupBy("doc_id").agg(F.collect_list(F.struct("at", "seed")).alias("marks"))
    marks = marks.select("doc_id", F.col("marks.at").alias("at"), F.col("marks.seed").alias("seed"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = batch.column("doc_id").to_numpy(), batch.column("at").offsets.to_numpy()
            at_all, seed_all = (batch.column(c).values.to_numpy() for c in ("at", "seed"))
            for lo, hi, words in _tables(batch, settings):
                mine = slice(int(bounds[lo]), int(bounds[hi]))
                text = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                at, seed = at_all[mine], seed_all[mine]
                fits = at < np.diff(words.first)[text]  # rows that share an id have other positions
                yield from make(ids[lo:], words, text[fits], at[fits], seed[fits], settings)

    return rows.join(marks, "doc_id").mapInArrow(listed, schema)


def _comparison(settings: Settings):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept = 0

        def settle(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(tables)
            if not table.num_rows:
                return
            seeds, ids, at = (table.column(c).to_numpy() for c in ("seed", "doc_id", "at"))
            sides = [_matrix(table.column(c), len(seeds)) for c in ("before", "suffix")]
            row, first, last = repeated(seeds, ids, np.concatenate(sides, axis=1), settings)
            spans = ids[row], (at[row] - last).astype(np.int32), (at[row] - first + settings.words).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["doc_id", "start_word", "end_word"])

        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = batch.column("seed").to_numpy()
            cut = int(np.searchsorted(seeds, seeds[-1])) if kept + len(seeds) >= 1 << 13 else 0
            if cut or (held and kept + len(seeds) >= 1 << 13 and held[-1].column("seed")[-1].as_py() != seeds[-1]):
                yield from settle([*held, batch.slice(0, cut)])
                held, kept = [batch.slice(cut)], len(seeds) - cut
            else:
                held.append(batch)
                kept += len(seeds)
        if held:
            yield from settle(held)

    return compare


def _fixed(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(4 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column_bytes(column)[0].view(np.uint32).reshape(n, -1)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Unite overlapping and touching spans of a document."""
    by_doc = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    begun = F.coalesce(F.max("end_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start_word"), F.lit(True))
    marked = spans.withColumn("begun", begun.cast("int")).withColumn("island", F.sum("begun").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    united = marked.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return united.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
