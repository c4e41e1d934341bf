"""Benchmark decontamination: Wu-Manber search for benchmark passages in documents.

Texts and test items are normalised alike: lower case, words (letters, digits, underscore; no
punctuation or spaces of any script) joined by single blanks.  The patterns are all ``NGRAM``-word passages of every item, or the whole item where
it is shorter, each between blanks so that only whole words match.  A block shift table tells how
far the search window may jump; where it tells nothing, the hash of the window's last block selects
a bucket of patterns, and comparison of the bytes decides.  Windows of all stripes of a batch of
texts advance together in numpy.  As the shortest pattern bounds the jumps, patterns of less than
``SHORT`` bytes are searched on their own.

The patterns (the benchmark, not the corpus) are broadcast in parts of ``MAX_BENCHMARK_BYTES`` at most
(one pattern more); a larger benchmark is searched in several passes over the documents.  A worker
keeps a part's tables from task to task.

Defined results: null or wordless texts and items match nothing; a document found with two rows is
reported once for each item with the n-grams of all its rows counted once; repeated items share
their passages and are all reported; a null doc_id or item_id is reported as null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textmill.llm.common import PIECE, U64, column_bytes, cut_lineage, fresh, keep, mix, row_slices, without, word_bytes

#: Words of a passage that count as contamination.
NGRAM = 13
#: Bytes of a block, and bits of the shift table's index.
BLOCK, TABLE_BITS = 8, 20
#: Bytes of a pattern that is searched with the long ones.
SHORT = 32
#: Bytes of a text that one search lane covers.
STRIPE = 4096
#: Normalised benchmark text that goes into one broadcast.
MAX_BENCHMARK_BYTES = 16_000_000
_BLANK = 32


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as blank, words with single blanks between, blank; the texts are lower case already."""
    total = len(offsets) - 1
    out = np.full(len(data) + 2 * total, _BLANK, np.uint8)
    begin = offsets[:-1] + 2 * np.arange(total) + 1
    put = np.arange(len(data)) + np.repeat(2 * np.arange(total) + 1, np.diff(offsets))
    out[put] = np.where(word_bytes(data), data, _BLANK)
    first = begin - 1
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _BLANK) | (out[:-1] != _BLANK)
    keep[first] = True
    ends = np.concatenate([first, [len(out)]])
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def passages(text: str, n: int = NGRAM) -> list[bytes]:
    """The patterns of one item."""
    raw = text.lower().encode()
    data, _ = normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    words = data.tobytes().split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))]


class WuManber:
    """Search for many patterns at once; ``find`` gives (position, pattern) of every occurrence."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = sorted(set(patterns))
        self.m = m = min(map(len, self.patterns), default=0)
        self.block = b = min(BLOCK, m)
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int32)
        self.buckets: dict[int, list[int]] = {}
        if not m:
            return
        heads = np.frombuffer(b"".join(p[:m] for p in self.patterns), np.uint8).reshape(-1, m)
        for end in range(b, m + 1):
            at = self._index(self._load(heads[:, end - b : end]))
            np.minimum.at(self.shift, at, m - end)
        last = self._load(heads[:, m - b :])
        for i, h in enumerate(mix(last).tolist()):
            self.buckets.setdefault(h, []).append(i)

    @staticmethod
    def _load(blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), U64)
        for i in range(blocks.shape[1]):
            out = out << U64(8) | blocks[:, i]
        return out

    @staticmethod
    def _index(blocks: np.ndarray) -> np.ndarray:
        return (mix(blocks) >> U64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that begin in ``data``; none reaches over the end of its text."""
        none = np.zeros(0, np.int64)
        if not self.m or len(data) < self.m:
            return none, none
        # lanes: windows that begin in [at, stop)
        sizes = np.diff(offsets) - self.m + 1
        lanes = np.maximum(0, -(-sizes // STRIPE))
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = offsets[text] + nth * STRIPE
        stop = np.minimum(at + STRIPE, offsets[text] + sizes[text])
        eight = np.lib.stride_tricks.sliding_window_view(data, self.block)
        hits = []
        while len(at):
            value = self._load(eight[at + self.m - self.block])
            step = self.shift[self._index(value)]
            zero = step == 0
            if zero.any():
                hits.append((at[zero], mix(value[zero])))
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        where, which = [], []
        raw = data.tobytes()
        for places, keys in hits:
            text_end = offsets[np.searchsorted(offsets, places, "right")]
            for p, h, end in zip(places.tolist(), keys.tolist(), text_end.tolist()):
                for i in self.buckets.get(h, ()):
                    pattern = self.patterns[i]
                    if p + len(pattern) <= end and raw.startswith(pattern, p):
                        where.append(p)
                        which.append(i)
        return np.array(where, np.int64), np.array(which, np.int64)


def searchers(patterns: list[bytes]) -> list[WuManber]:
    """One for the short patterns and one for the others, as far as there are any."""
    classes = [p for p in patterns if len(p) < SHORT], [p for p in patterns if len(p) >= SHORT]
    return [WuManber(c) for c in classes if c]


def _parts(benchmark: DataFrame, n: int) -> Iterator[dict[bytes, list]]:
    """Passage -> items, in parts of at most MAX_BENCHMARK_BYTES of patterns and items' mentions."""
    part: dict[bytes, dict] = {}
    size = 0

    def done() -> dict[bytes, list]:
        return {passage: list(items) for passage, items in part.items()}

    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        for passage in passages(row["text"], n):
            items = part.setdefault(passage, {})
            size += 16 if items else len(passage)
            items[row["item_id"]] = None
            if size > MAX_BENCHMARK_BYTES:
                yield done()
                part, size = {}, 0
    if part:
        yield done()


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """(doc_id, item_id, n_passages): documents that contain passages of an item, and how many distinct ones."""
    spark = docs.sparkSession
    rows = docs.where("text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, passage binary"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = spark.createDataFrame([], schema)
    for part in _parts(benchmark, n):
        shared, key = spark.sparkContext.broadcast(part), ("leaks", uuid.uuid4().hex)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            items, tools = keep(key, lambda: (shared.value, searchers(list(shared.value))))
            for batch in batches:
                data, offsets = column_bytes(batch.column("text"))
                docs_, items_, passages_ = [], [], []
                for lo, hi in row_slices(offsets, PIECE):
                    clean, bounds = normalise(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    for tool in tools:
                        where, which = tool.find(clean, bounds)
                        rows_ = lo + np.searchsorted(bounds, where, "right") - 1
                        for r, i in sorted(set(zip(rows_.tolist(), which.tolist()))):
                            for item in items[tool.patterns[i]]:
                                docs_.append(r)
                                items_.append(item)
                                passages_.append(tool.patterns[i])
                if docs_:
                    ids = batch.column("doc_id").take(pa.array(docs_))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(items_, item_type), pa.array(passages_, pa.binary())], names=["doc_id", "item_id", "passage"])

        found = found.union(rows.mapInArrow(search, schema))
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("passage").alias("n_passages"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Documents without any benchmark passage, with all their columns."""
    leaked = fresh(docs, "_leaked_id")
    leaks = cut_lineage(contaminated(docs, benchmark, n).select(F.col("doc_id").alias(leaked)).distinct())
    return without(docs, leaks, docs["doc_id"].eqNullSafe(F.col(leaked)))
