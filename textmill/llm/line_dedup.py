"""Line dedup: lines within one edit of an earlier line, by a deletion-neighbourhood join.

Two lines are within one edit (insertion, deletion or substitution of a character) exactly if some
variants with at most one character deleted are equal.  Variants are hashed keys; equal keys are
joined, the pairs' texts are compared, and every line points to the earliest one in reach.  Equal
lines are one class, named by a 128-bit BLAKE2b digest of their bytes.

Emitting all variants of all lines would cost a row for each character of the corpus.  Two sieves
that lose nothing come first: cut a line into blocks; an edit lies in one block, so all that is
before it and all that is behind it is shared.  Classes for which no other class shares this for some
half have no partner; then the same with eight blocks, after which only deletions in the blocks that
may hold the edit are emitted.  Texts are cut into lines twice: once for digests and keys of halves,
which are written to the shared folder, and once to fetch the lines that the first sieve lets through.

Lines are the parts of a text between line feeds.  Defined results: null texts have no lines; lines
without a visible character are never copies; lines of fewer than ``least`` characters match only
exactly; the earliest line is that of the smallest (doc_id, line_no); a line matches directly, not
through a third one; rows with a null doc_id are left out; of repeated rows (same id and text) each
line is one line.  Other columns are carried by ``drop_lines`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import PIECE, U64, column_bytes, cut_lineage, fresh, mix, row_slices, written

#: Characters from which on a line may differ by one edit: below, most lines are near some other by chance.
LEAST = 8
_COARSE, _FINE = 2, 8
_ONE = U64(1)
#: Hashes of ranges are polynomials modulo this prime, at two points; together 62 bits.
_PRIME = U64((1 << 31) - 1)
_POINTS = (0x2545F491, 0x5851F42D)


#: Bytes of text that are cut into lines at once: tables of some hundred thousand numbers stay in the cache.
_PART = PIECE // 8


def _once(x: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo the prime."""
    return (x & _PRIME) + (x >> U64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo the prime."""
    x = _once(_once(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _number(characters: np.ndarray, which: int) -> np.ndarray:
    """A number below 2**31 for each character (its UTF-8 bytes, the first one lowest)."""
    return mix(characters + U64((0x51, 0xA7)[which])) >> U64(33)


_ASCII = tuple(_number(np.arange(256, dtype=U64), i) for i in (0, 1))


_tables_of_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """For each point its powers and those of its inverse, n or more of them."""
    if not _tables_of_powers or len(_tables_of_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _tables_of_powers.clear()
        for point in _POINTS:
            for base in (point, pow(point, -1, int(_PRIME))):
                table = np.ones(1, U64)
                while len(table) < size:
                    table = np.concatenate([table, _fold(table * U64(pow(base, len(table), int(_PRIME))))])
                _tables_of_powers.append(table)
    return _tables_of_powers


class Lines:
    """Lines of many texts as ranges of characters, with prefix sums for hashes of any range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        wide = np.flatnonzero(data >= 0xC0)  # first bytes of characters of several bytes
        starts = np.flatnonzero((data & 0xC0) != 0x80) if len(wide) else np.arange(len(data))
        first_byte = data[starts] if len(wide) else data
        self.data, self.starts = data, np.append(starts, len(data))
        text_at = np.searchsorted(starts, offsets)
        breaks = np.flatnonzero(first_byte == 10)
        full = np.flatnonzero(np.diff(text_at) > 0)
        # where a text ends in a line feed, the nothing after it comes before the next text's first line
        begin = np.concatenate([breaks + 1, text_at[full]])
        order = np.argsort(begin, kind="stable")
        begin = begin[order]
        stop = np.concatenate([breaks, text_at[full + 1]])
        stop = stop[np.argsort(stop * 2 + np.concatenate([np.zeros(len(breaks), np.int64), np.ones(len(full), np.int64)]), kind="stable")]
        first = np.concatenate([np.zeros(len(breaks), bool), np.ones(len(full), bool)])[order]
        self.text = full[np.cumsum(first) - 1]
        at = np.flatnonzero(first)
        self.number = np.arange(len(begin)) - np.repeat(at, np.diff(np.append(at, len(begin))))
        self.begin, self.length = begin, stop - begin
        visible = np.concatenate([[0], np.cumsum(first_byte > 32, dtype=np.int32)])
        keep = (visible[stop] - visible[begin]) > 0
        self.text, self.number, self.begin, self.length = self.text[keep], self.number[keep], self.begin[keep], self.length[keep]
        at = np.searchsorted(starts, wide)
        size = self.starts[at + 1] - wide
        value = data[wide].astype(U64)
        for i in range(1, 4):
            more = np.flatnonzero(size > i)
            value[more] |= data[wide[more] + i].astype(U64) << U64(8 * i)
        powers = _powers(len(starts) + 1)
        self.sums, self.back = [], [powers[1], powers[3]]
        for which in (0, 1):
            number = _ASCII[which][first_byte]
            number[at] = _number(value, which)
            number *= powers[2 * which][: len(number)]
            sums = np.zeros(len(number) + 1, U64)
            np.cumsum(_once(number), out=sums[1:])  # of numbers below 2**32, so there is room for 2**32 of them
            self.sums.append(_once(sums))

    def _range(self, which: int, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Polynomial of the characters lo to hi, divided by the ``at``-th power."""
        return _fold((self.sums[which][hi] + _PRIME + _PRIME - self.sums[which][lo]) * self.back[which][at])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self._range(0, lo, hi, lo) | self._range(1, lo, hi, lo) << U64(31)

    def without(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Hash of the characters lo to hi without the x-th."""
        a, b = (_fold(self._range(i, lo, lo + x, lo) + self._range(i, lo + x + 1, hi, lo + 1)) for i in (0, 1))
        return a | b << U64(31)

    def ids(self, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each line's digest."""
        begin, length = (self.begin, self.length) if own is None else (self.begin[own], self.length[own])
        raw = memoryview(self.data.tobytes())
        ends = zip(self.starts[begin].tolist(), self.starts[begin + length].tolist())
        both = np.frombuffer(b"".join([blake2b(raw[i:j], digest_size=16).digest() for i, j in ends]), np.int64)
        return both[::2], both[1::2]

    def block_keys(self, own: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, longer, block, key): what a line shares with any line that differs within the block.

        ``longer``: the line as the longer of a pair, cut as the shorter one is.
        """
        line, longer, block = (x.ravel() for x in np.meshgrid(own, np.arange(2), np.arange(blocks), indexing="ij"))
        n = self.length[line] - longer
        lo, hi = n * block // blocks, n * (block + 1) // blocks
        begin, end = self.begin[line], self.begin[line] + self.length[line]
        head = self.hash(begin, begin + lo)
        tail = self.hash(end - (n - hi), end)
        return line, longer, block, mix(head + mix(tail + U64(blocks)) + mix((n * blocks + block).astype(U64)))

    def variants(self, line: np.ndarray, longer: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``line``, kind, key) of the variants with a deletion in the block.

        Kinds: 0 a substitution's (a deletion and its place), 1 the longer line's, 2 the shorter line itself.
        """
        n = self.length[line] - longer
        lo, hi = n * block // blocks, n * (block + 1) // blocks + longer
        each = np.repeat(np.arange(len(line)), hi - lo)
        x = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        begin, end = self.begin[line], self.begin[line] + self.length[line]
        rest = self.without(begin[each], end[each], x)
        size = self.length[line][each].astype(U64)
        kind = longer[each]
        key = np.where(kind == 1, mix(rest + size - _ONE), mix(mix(rest + size) + mix(x.astype(U64) + U64(0xABCD))))
        whole = np.flatnonzero(longer == 0)
        own = mix(self.hash(begin[whole], end[whole]) + self.length[line][whole].astype(U64))
        return np.concatenate([each, whole]), np.concatenate([kind, np.full(len(whole), 2)]), np.concatenate([key, own])


def _tables(column: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    data, offsets = column_bytes(column)
    for lo, hi in row_slices(offsets, _PART):
        if offsets[hi] > offsets[lo]:
            yield lo, hi, Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _key_lists(lines: Lines, own: np.ndarray, blocks: int, least: int) -> pa.Array:
    """For each line its block keys, in the order of (longer, block); none for a line that is too short."""
    fit = lines.length[own] >= least - 1
    _, _, _, key = lines.block_keys(own[fit], blocks)
    offsets = np.concatenate([[0], np.cumsum(fit * 2 * blocks)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))


def lines_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, line_no, keys): every line with a visible character, with its keys of halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, _, lines in _tables(batch.column("text")):
                keys = _key_lists(lines, np.arange(len(lines.text)), _COARSE, least)
                yield _batch("h1 h2 doc_id line_no keys", *lines.ids(), ids[lo + lines.text], lines.number.astype(np.int32), keys)

    return _rows(docs).mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, line_no int, keys array<bigint>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shared(keys: DataFrame) -> DataFrame:
    """Rows (key, h1, ...) whose key lines with different digests have."""
    both = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    return keys.join(both, "key", "left_semi")


def near_pairs(docs: DataFrame, classes: DataFrame, least: int = LEAST) -> DataFrame:
    """(a1, a2, b1, b2): pairs of distinct lines within one edit, each line with those that may be its earliest."""
    some = _shared(classes.select("h1", F.explode("keys").alias("key"))).select("h1").distinct()
    few = classes.join(some, "h1", "left_semi").select("h1", "h2", "doc_id", "line_no")
    wanted = few.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1")).alias("wanted"))
    wanted = wanted.select("doc_id", F.col("wanted.line_no").alias("numbers"), F.col("wanted.h1").alias("a"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_ = batch.column("doc_id").to_numpy()
            bounds, numbers, a = batch.column("numbers").offsets.to_numpy(), *(batch.column(c).values.to_numpy() for c in ("numbers", "a"))
            for lo, hi, lines in _tables(batch.column("text")):
                have = lines.text.astype(np.int64) << 32 | lines.number
                want = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])) << 32 | numbers[bounds[lo] : bounds[hi]].astype(np.int64)
                own = np.flatnonzero(np.isin(have, want))
                h1, h2 = lines.ids(own)
                # rows that share an id have several lines at a place: the digest tells which is wanted
                mine = slice(int(bounds[lo]), int(bounds[hi]))
                same = np.isin(mix(have[own].view(U64)) + h1.view(U64), mix(want.view(U64)) + a[mine].view(U64))
                own, h1, h2 = own[same], h1[same], h2[same]
                i, j = lines.starts[lines.begin[own]], lines.starts[lines.begin[own] + lines.length[own]]
                texts = pa.array([lines.data[x:y].tobytes() for x, y in zip(i.tolist(), j.tolist())], pa.binary()).cast(pa.string())
                yield _batch("h1 h2 doc_id line_no line keys", h1, h2, docs_[lo + lines.text[own]], lines.number[own].astype(np.int32), texts, _key_lists(lines, own, _FINE, least))

    schema = "h1 bigint, h2 bigint, doc_id bigint, line_no int, line string, keys array<bigint>"
    # duplicates come from repeated rows only
    texts = written(_rows(docs).join(wanted, "doc_id").mapInArrow(fetch, schema).dropDuplicates(["h1", "h2"]), "line-texts")
    spots = _shared(texts.select("h1", "h2", F.posexplode("keys").alias("spot", "key")))
    spots = spots.groupBy("h1", "h2").agg(F.collect_set("spot").alias("spots"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, every = batch.column("spots").offsets.to_numpy(), batch.column("spots").values.to_numpy()
            carried = [batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "line_no")]
            for lo, _, lines in _tables(batch.column("line")):
                row = lo + lines.text
                count = np.diff(bounds)[row]
                line = np.repeat(np.arange(len(row)), count)
                spot = every[np.repeat(bounds[:-1][row] - (np.cumsum(count) - count), count) + np.arange(len(line))]
                for part in range(0, len(line), 1 << 12):
                    own, place = line[part : part + (1 << 12)], spot[part : part + (1 << 12)]
                    at, kind, key = lines.variants(own, place // _FINE, place % _FINE, _FINE)
                    at = row[own[at]]
                    # deletions in a run of one character are one variant
                    order = np.lexsort((key, kind, at))
                    at, kind, key = at[order], kind[order], key[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (at[1:] != at[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
                    yield _batch("key kind h1 h2 doc_id line_no", key[new].view(np.int64), kind[new].astype(np.int8), *(c[at[new]] for c in carried))

    variants = texts.drop("keys").join(spots, ["h1", "h2"]).mapInArrow(spread, "key bigint, kind tinyint, h1 bigint, h2 bigint, doc_id bigint, line_no int")
    me = F.struct("doc_id", "line_no", "h1", "h2")
    # classes that meet here differ by one character, so a group is no larger than a line times the alphabet
    group = Window.partitionBy("key", F.col("kind") == 0)
    # lines that differ at one place: each with the earliest; a shorter line: with each longer one
    met = variants.withColumn("other", F.when(F.col("kind") == 0, F.min(me).over(group)).when(F.col("kind") == 1, F.max(F.when(F.col("kind") == 2, me)).over(group)))
    pairs = met.where("other IS NOT NULL AND (other.h1 <> h1 OR other.h2 <> h2)")
    pairs = pairs.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("other.h1").alias("b1"), F.col("other.h2").alias("b2")).distinct()
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a_line"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b_line"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    long_enough = (F.length("a_line") >= least) & (F.length("b_line") >= least)
    return both.where(long_enough & (F.levenshtein("a_line", "b_line", 1) >= 0)).select("a1", "a2", "b1", "b2")


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of every line within one edit of an earlier line."""
    every = written(lines_of(docs, least), "lines")
    lines = every.drop("keys")
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    classes = every.groupBy("h1", "h2").agg(first, F.count("*").alias("n"), F.first("keys").alias("keys"))
    classes = written(classes.select("h1", "h2", "first.doc_id", "first.line_no", "n", "keys"), "line-classes")
    pairs = cut_lineage(near_pairs(docs, classes, least))
    classes = classes.select("h1", "h2", "n", F.struct("doc_id", "line_no").alias("first"))
    both = pairs.union(pairs.select("b1", "b2", "a1", "a2"))
    other = classes.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("there"))
    best = both.join(other, ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.min("there").alias("there"))
    kept = classes.join(best, ["h1", "h2"], "left").where("n > 1 OR there < first").select("h1", "h2", F.least("first", "there").alias("kept"))
    found = lines.join(kept, ["h1", "h2"]).where("struct(doc_id, line_no) > kept").distinct()
    return found.select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))


def drop_lines(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The documents without the lines of ``repeated``; all other columns and rows stay."""
    doc, lines = fresh(docs, "_line_doc"), fresh(docs, "_lines")
    gone = repeated.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(lines))
    joined = docs.join(gone, docs["doc_id"] == F.col(doc), "left")
    kept = F.filter(F.split(docs["text"], "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    return joined.withColumn("text", F.when(F.col(lines).isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))).drop(doc, lines)
