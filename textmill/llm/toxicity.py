"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training is online and sequential, so it runs in one task over a bounded, documented sample of the
labelled rows (``Settings.train_rows``).  Per-coordinate learning rates and L1 leave a few thousand
non-zero weights of 2**20; these alone are broadcast.  Scoring is one narrow pass over all texts.

Defined results: a null text has a null score and isn't toxic; an empty text scores the bias alone;
labels that are null or whose document is missing or has no text are ignored and take no place in the
sample; of several labels for one document the largest counts, of several texts for one doc_id the
least is trained on; without any label of both kinds nothing is toxic (score 0).  Repeated rows are
scored alike, a text of any length is scored whole, other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import PIECE, U64, column_bytes, distinct, mix, owners, release, row_slices, word_table


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled sample; the rest are FTRL's and the decision's constants."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 4
    train_rows: int = 20_000
    threshold: float = 0.4


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every unigram, bigram and one-word skip-gram occurrence."""
    words = word_table(data, offsets)
    text, h = owners(words.first), words.hashes
    own, found = [text], [mix(h + U64(0x51))]
    for gap, salt in ((1, 0xA5), (2, 0xC3)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        pair = h[:-gap] * U64(0x9DDFEA08EB382D69) + mix(h[gap:] + U64(salt)) if len(text) > gap else h[:0]
        own.append(text[gap:][same] if len(text) > gap else text[:0])
        found.append(mix(pair)[same])
    return np.concatenate(own), (np.concatenate(found) >> U64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) with binary features."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings
        size = (1 << settings.bits) + 1  # the last is the bias, which has no L1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        w = (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.uint32), w[at].astype(np.float32), float(w[-1])


def fit(texts: list[np.ndarray], labels: list[int], settings: Settings) -> tuple[np.ndarray, np.ndarray, float] | None:
    """``texts`` holds the distinct buckets of each document. None: one class only."""
    if len(set(labels)) < 2:
        return None
    model, rng = Ftrl(settings), np.random.default_rng(7)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(labels)):
            model.learn(texts[i], labels[i])
    return model.compact()


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> bytes:
    """The compact model, fitted in one task; empty where there is nothing to fit."""
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    sample = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.train_rows)
    )
    # at most train_rows rows of 12 bytes: a bounded broadcast
    rows = texts.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(sample), "doc_id")
    # and at most train_rows texts in the one task, however often an id is repeated
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ids, texts, ys = [], [], []
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for lo, hi in row_slices(offsets):
                own, bucket = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], settings.bits)
                key = distinct(own << settings.bits | bucket)
                cut = np.searchsorted(key >> settings.bits, np.arange(hi - lo + 1))
                key &= (1 << settings.bits) - 1
                texts += [key[a:b].astype(np.uint32) for a, b in zip(cut, cut[1:])]
            ids += batch.column("doc_id").to_pylist()
            ys += batch.column("toxic").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        model = fit([texts[i] for i in order], [int(ys[i] > 0) for i in order], settings)
        if model is not None:
            np.savez(out := io.BytesIO(), at=model[0], w=model[1], bias=model[2])
            yield pa.RecordBatch.from_pydict({"model": pa.array([out.getvalue()], pa.binary())})

    made = rows.repartition(1).mapInArrow(gather, "model binary").collect()
    return bytes(made[0]["model"]) if made else b""


def scorer(docs: DataFrame, model: bytes, settings: Settings = Settings()):
    """Arrow UDF text -> probability, over a broadcast of the non-zero weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, object] = {}

    def loaded() -> tuple[np.ndarray, float]:
        if "w" not in held:
            release()
            saved = np.load(io.BytesIO(shared.value))
            w = np.zeros(1 << settings.bits, np.float32)
            w[saved["at"]] = saved["w"]
            held["w"], held["bias"] = w, float(saved["bias"])
        return held["w"], held["bias"]

    def score(text: pa.Array) -> pa.Array:
        if not shared.value:
            return pa.array(np.where(np.asarray(text.is_null()), np.nan, 0.0), from_pandas=True)
        w, bias = loaded()
        out = np.full(len(text), bias)
        data, offsets = column_bytes(text)
        for lo, hi in row_slices(offsets, PIECE):
            own, bucket = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], settings.bits)
            live = w[bucket] != 0
            key = distinct(own[live] << settings.bits | bucket[live])
            out[lo:hi] += np.bincount(key >> settings.bits, w[key & ((1 << settings.bits) - 1)], hi - lo)
        out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
        return pa.array(np.where(np.asarray(text.is_null()), np.nan, out), from_pandas=True)

    return F.arrow_udf(score, "double")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    score = scorer(docs, train(docs, labels, settings), settings)
    return docs.select("doc_id", score(F.lower("text")).alias("score")).select("doc_id", "score", _decide("score", settings).alias("toxic"))


def _decide(score: str, settings: Settings) -> Column:
    return F.coalesce(F.col(score) >= settings.threshold, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    score = scorer(docs, train(docs, labels, settings), settings)
    return docs.where(~F.coalesce(score(F.lower("text")) >= settings.threshold, F.lit(False)))
