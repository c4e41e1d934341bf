"""SimHash near-dedup: 128-bit fingerprints, matched by May-Ozerov recursion.

A text's features are its distinct words and word pairs; bit i of the fingerprint is the majority of
bit i over the feature hashes.  Near pairs (Hamming distance at most ``distance``) are searched as in
May and Ozerov's nearest-neighbour algorithm: a list of fingerprints is filtered by the partial
weight, after a random shift, on a random strip of coordinates; each weight gives a sub-list, which is
filtered on the next strip, until lists are small; those are compared by brute force.  At each step of
the recursion the whole is repeated with fresh strips, so often that a pair at the full distance is
found with probability ``recall``.

The first step is an exchange: it makes lists of at most ``list_size`` fingerprints, and its
repetitions alone are rows on the network.  The second runs where the list is: its sub-lists, of some
``leaf`` fingerprints, are compared at once.  Levels and repetitions follow from the number of
fingerprints, nothing is capped.  A list that strips don't part has dense clusters; these are taken
out whole, around pivots, without loss (``peel``), and the rest goes on.

Rows on the network for each fingerprint, by the number of fingerprints: 16 (2.5e5), 81 (1e8), 178
(1e9).  With one step for all and strips of 3 coordinates it would be 45, 704 and 2,100.

A list reports, for each of its groups of near fingerprints, edges that connect it, so a group of n
costs n - 1 rows and not n^2 / 2.  Groups are the connected components of all edges.

Defined results: null texts and texts without a word have no fingerprint and are near nothing; equal
fingerprints are one node (any number of exact copies costs one); the smallest doc_id of a group is
kept; rows with a null doc_id are left alone; rows that share a doc_id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import PIECE, U64, column_bytes, cut_lineage, distinct, fresh, mix, owners, release, row_slices, without, word_table

BITS = 128
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


@dataclass(frozen=True)
class Settings:
    """``recall``: of pairs at the full distance; nearer ones are found more often.

    ``leaf``: planned size of lists that are compared by brute force; ``strip``: coordinates of a
    filter; ``list_size``: planned size of the largest lists that go over the network.
    """

    distance: int = 24
    recall: float = 0.95
    strip: int = 2
    leaf: int = 1024
    list_size: int = 100_000


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, number of features) for each text."""
    n = len(offsets) - 1
    words = word_table(data, offsets)
    text, h = owners(words.first), words.hashes
    same = text[1:] == text[:-1]
    pairs = mix(h[:-1] * U64(0x9DDFEA08EB382D69) + mix(h[1:] + U64(0x77)))[same]
    own = np.concatenate([text, text[1:][same]])
    key = distinct(own.astype(U64) << U64(48) | np.concatenate([h, pairs]) >> U64(16))
    own, key = (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1)
    count = np.bincount(own, minlength=n)
    halves = []
    for salt in (0x1234567, 0x89ABCDEF):
        value = mix(key + U64(salt))
        out = np.zeros(n, U64)
        for byte in range(8):
            part = own * 256 + ((value >> U64(8 * byte)) & U64(255)).astype(np.int64)
            ones = np.bincount(part, minlength=n * 256).reshape(n, 256) @ _BYTE_BITS
            bits = (2 * ones > count[:, None]).astype(U64) << np.arange(8, dtype=U64)
            out |= bits.sum(axis=1, dtype=U64) << U64(8 * byte)
        halves.append(out)
    return halves[0], halves[1], count


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, low, high) of every document with an id and at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for lo, hi in row_slices(offsets, PIECE):
                low, high, count = fingerprints_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                has = np.flatnonzero(count)
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(low[has].view(np.int64)), pa.array(high[has].view(np.int64))], names=["doc_id", "low", "high"])

    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, low bigint, high bigint")


def survival(settings: Settings) -> tuple[float, float]:
    """Probability that a pair at the full distance, and an unrelated one, agree in a strip's weight."""
    b = settings.strip

    def agree(p: float) -> float:
        return sum(math.comb(b, k) * p**k * (1 - p) ** (b - k) * math.comb(k, k // 2) / 2**k for k in range(0, b + 1, 2))

    return agree(settings.distance / BITS), agree(0.5)


def plan(n: int, size: int, recall: float, settings: Settings) -> tuple[int, int]:
    """(levels, repetitions) that part n fingerprints into lists of about ``size``."""
    near, far = survival(settings)
    if n <= size:
        return 0, 1
    levels = min(BITS // settings.strip, math.ceil(math.log(n / size) / math.log(1 / far)))
    return levels, math.ceil(math.log(1 - recall) / math.log(1 - near**levels))


def first_step(n: int, settings: Settings) -> tuple[int, int]:
    """Levels and repetitions of the exchange; some dozens of lists at least, to have work for all."""
    size = min(settings.list_size, max(settings.leaf, n // 32))
    return plan(n, size, math.sqrt(settings.recall), settings)


def strips(seed: tuple[int, ...], levels: int, settings: Settings) -> tuple[list[tuple[int, int]], int, int]:
    """Masks (low, high) of ``levels`` disjoint random strips, and the random shift.

    ``seed``: the repetition of each step down to this one.
    """
    rng = np.random.default_rng([0x5EED, len(seed), *seed])
    order = rng.permutation(BITS)
    masks = []
    for i in range(levels):
        bits = sum(1 << int(c) for c in order[i * settings.strip : (i + 1) * settings.strip])
        masks.append((bits & (1 << 64) - 1, bits >> 64))
    shift = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
    return masks, int(shift[0]), int(shift[1])


def paths(low: np.ndarray, high: np.ndarray, seed: tuple[int, ...], levels: int, settings: Settings) -> np.ndarray:
    """Hash of the sequence of partial weights: the list that a fingerprint ends in."""
    masks, s, t = strips(seed, levels, settings)
    a, b = low ^ U64(s), high ^ U64(t)
    code = np.full(len(low), sum(x * 0x9E3779B97F4A7C15 for x in seed) & (1 << 64) - 1, U64)
    for m, k in masks:
        weight = np.bitwise_count(a & U64(m)) + np.bitwise_count(b & U64(k))
        code = code * U64(0xD6E8FEB86659FD93) + weight
    return mix(code)


def near_pairs(low: np.ndarray, high: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within the distance."""
    left, right = [], []
    step = max(1, min(len(low), (1 << 21) // max(1, len(low))))
    for a in range(0, len(low), step):
        d = np.bitwise_count(low[a : a + step, None] ^ low[None, a:]) + np.bitwise_count(high[a : a + step, None] ^ high[None, a:])
        i, j = np.nonzero(d <= distance)
        keep = i < j
        left.append(i[keep] + a)
        right.append(j[keep] + a)
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's connected component."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def distances(low: np.ndarray, high: np.ndarray, i: int) -> np.ndarray:
    return np.bitwise_count(low ^ low[i]).astype(np.int64) + np.bitwise_count(high ^ high[i])


def peel(low: np.ndarray, high: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, rest): edges that settle the dense clusters of a list, and the indices that are left.

    All fingerprints within ``distance`` of a pivot are in its group.  Others can be near one of these
    only if they are within twice the distance; they are compared with all of them, and the ball is done.
    """
    rest = np.arange(len(low))
    left, right = [], []
    rng = np.random.default_rng(len(low))
    while len(rest) > settings.leaf:
        near: list[np.ndarray] = [distances(low[rest], high[rest], i) for i in rng.integers(0, len(rest), 8)]
        ball = max(near, key=lambda d: np.count_nonzero(d <= settings.distance))
        inside = ball <= settings.distance
        if 64 * np.count_nonzero(inside) < len(rest):
            break
        core, around = rest[inside], rest[~inside & (ball <= 2 * settings.distance)]
        left.append(core[1:])
        right.append(np.repeat(core[:1], len(core) - 1))
        step = max(1, (1 << 21) // len(core))
        for k in range(0, len(around), step):
            part = around[k : k + step]
            d = np.bitwise_count(low[part, None] ^ low[None, core]) + np.bitwise_count(high[part, None] ^ high[None, core])
            hit = d <= settings.distance
            some = hit.any(axis=1)
            left.append(part[some])
            right.append(core[hit.argmax(axis=1)[some]])
        rest = rest[~inside]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), rest


def solve(ids: np.ndarray, low: np.ndarray, high: np.ndarray, settings: Settings, seed: tuple[int, ...] = (0,)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between the ids of one list that connect its near fingerprints."""
    n = len(ids)
    if n < 2:
        return
    # a sub-list is compared at once up to four times its planned size; beyond, it is parted like any other
    if n <= settings.leaf * (1 if len(seed) == 1 else 4) or len(seed) > 8 and n <= 64 * settings.leaf:
        left, right = near_pairs(low, high, settings.distance)
        if len(left):
            label = roots(n, left, right)
            moved = np.flatnonzero(label != np.arange(n))
            yield ids[moved], ids[label[moved]]
        return
    left, right, rest = peel(low, high, settings)
    if len(left):
        yield ids[left], ids[right]
    ids, low, high = ids[rest], low[rest], high[rest]
    # what is found by several steps needs more of each
    recall = math.sqrt(settings.recall) if len(seed) == 1 else 0.99
    levels, repetitions = plan(len(ids), settings.leaf, recall, settings)
    for r in range(repetitions):
        own = (*seed, r)
        code = paths(low, high, own, levels, settings)
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        for part in np.split(order, cuts):
            yield from solve(ids[part], low[part], high[part], settings, own)


def near_edges(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edges (a, b), b < a, whose components are the groups of near fingerprints (id, low, high)."""
    levels, repetitions = first_step(nodes.count(), settings)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(c).to_numpy().view(U64) for c in ("low", "high"))
            for r in range(repetitions):
                code = paths(low, high, (r,), levels, settings)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *(batch.column(c) for c in ("id", "low", "high"))], names=["list", "id", "low", "high"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the list that the next batch may go on with

        def edges(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(table[0])) + 1
            found = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), table.shape[1]]):
                if hi - lo > 1:
                    found += solve(table[1, lo:hi], table[2, lo:hi].view(U64), table[3, lo:hi].view(U64), settings)
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in ("list", "id", "low", "high")])
            if not table.shape[1]:
                continue
            if held and held[0][0, 0] == table[0, -1]:
                held.append(table)
                continue
            cut = int(np.searchsorted(table[0], table[0, -1]))
            yield from edges(np.concatenate([*held, table[:, :cut]], axis=1))
            held = [table[:, cut:]]
        if held:
            yield from edges(np.concatenate(held, axis=1))

    lists = nodes.mapInArrow(spread, "list bigint, id bigint, low bigint, high bigint")
    # a number of partitions of its own: the work of a list is far more than its bytes tell
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lists = lists.repartition(parts, "list").sortWithinPartitions("list")
    return sorted_lists.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; roots aren't listed.

    Alternating large-star and small-star contraction (Kiveris et al., 2014).
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.distinct())


def near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that is near one with a smaller id, directly or in steps."""
    prints = cut_lineage(fingerprints(docs))
    nodes = prints.groupBy("low", "high").agg(F.min("doc_id").alias("id"))
    nodes = cut_lineage(nodes.select("id", "low", "high"))
    equal = prints.join(nodes, ["low", "high"]).where("doc_id > id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(near_edges(nodes, settings).union(equal))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group, and all that are in none, with all their columns."""
    near_id = fresh(docs, "_near_id")
    gone = near_copies(docs, settings).select(F.col("doc_id").alias(near_id))
    return without(docs, gone, docs["doc_id"] == F.col(near_id))
