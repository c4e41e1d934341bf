"""The inverted index as DataFrames.

postings   (term, doc_id, tf, dl)   dl is carried along, so ranking needs no join with document lengths
doc_stats  (doc_id, dl)             documents without a term are in it, with 0
vocab      (term, df, cf)
stats      (n, avgdl)               one row

All of them are lazy plans over the corpus until ``save_index`` or ``persist`` fixes them.  A record is
tokenised once and its terms are counted within the row, so postings are made without a shuffle.
An index is a snapshot: every change gives a new one with the next version.  A change of an index whose
postings are fixed tokenises the new records only; a corpus must not repeat ids (see ``unique``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import analyzer as analyzers
from textmill.functions import text
from textmill.operators import blocks


@dataclass(frozen=True)
class IndexConfig:
    """``fields``: what is indexed (None: all but the id); ``exclude`` wins over it."""

    name: str = "index"
    fields: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    analyzer: analyzers.Analyzer = analyzers.DEFAULT
    field_analyzers: Mapping[str, analyzers.Analyzer] = field(default_factory=dict)
    default_sort: tuple[str, bool] | None = None
    k1: float = 1.2
    b: float = 0.75


class Index:
    def __init__(
        self,
        corpus: DataFrame,
        config: IndexConfig = IndexConfig(),
        version: int = 1,
        postings: DataFrame | None = None,
        doc_stats: DataFrame | None = None,
        vocab: DataFrame | None = None,
        stats: DataFrame | None = None,
        ordered: bool = False,
    ) -> None:
        """``postings`` and the others: tables that are there already, else they are derived from the corpus.

        ``ordered``: the postings are files that are sorted by (term, doc_id) and disjoint.
        """
        if "doc_id" not in corpus.columns:
            raise ValueError("a corpus needs a doc_id column; see sources.ingest.with_ids")
        self.corpus, self.config, self.version = corpus, config, version
        self._postings, self._doc_stats, self._vocab, self._stats = postings, doc_stats, vocab, stats
        self._ordered = ordered

    @staticmethod
    def build(corpus: DataFrame, config: IndexConfig | None = None, **options) -> Index:
        return Index(corpus, replace(config or IndexConfig(), **options))

    # analysis

    @cached_property
    def fields(self) -> list[str]:
        """Indexed fields, in the corpus's order."""
        wanted = self.config.fields
        return [c for c in self.corpus.columns if c != "doc_id" and (wanted is None or c in wanted) and c not in self.config.exclude]

    def field_tokens(self, name: str) -> Column:
        kind = self.corpus.schema[name].dataType
        own = self.config.field_analyzers.get(name, self.config.analyzer)
        return F.coalesce(own.tokens(text.to_text(F.col(f"`{name}`"), kind)), F.array().cast("array<string>"))

    @cached_property
    def tokens(self) -> Column:
        """All terms of a record, with repetitions."""
        each = [self.field_tokens(f) for f in self.fields]
        return F.concat(*each) if each else F.array().cast("array<string>")

    def record_text(self) -> Column:
        return text.record_text(self.corpus.schema, self.fields)

    def plain_stop_words(self) -> tuple[str, ...] | None:
        """The stop words, if all fields are cut by the plain tokenizer without a stemmer and have the same ones."""
        own = [self.config.field_analyzers.get(f, self.config.analyzer) for f in self.fields]
        plain = own and all(a.tokenizer is text.tokenize and a.stemmer is None and set(a.stop_words) == set(own[0].stop_words) for a in own)
        return tuple(own[0].stop_words) if plain else None

    def plain_text(self) -> Column | None:
        """One text with the tokens of all fields, where ``plain_stop_words`` has what else there is to know."""
        if self.plain_stop_words() is None:
            return None
        return F.concat_ws(" ", *[text.to_text(F.col(f"`{f}`"), self.corpus.schema[f].dataType) for f in self.fields])

    # derived tables

    @cached_property
    def forward(self) -> DataFrame:
        """(doc_id, dl, counts): each record's length and its distinct terms with their frequencies."""
        listed = self.corpus.select("doc_id", self.tokens.alias("terms"))
        return listed.select("doc_id", F.size("terms").cast("bigint").alias("dl"), term_counts(F.col("terms")).alias("counts"))

    @cached_property
    def postings(self) -> DataFrame:
        return postings_of(self.forward) if self._postings is None else self._postings

    @cached_property
    def doc_stats(self) -> DataFrame:
        if self._doc_stats is not None:
            return self._doc_stats
        return self.corpus.select("doc_id", F.size(self.tokens).cast("bigint").alias("dl"))

    @property
    def has_vocab(self) -> bool:
        """Whether the vocabulary is a table of its own, so that it is cheaper to ask than the postings."""
        return self._vocab is not None

    @cached_property
    def vocab(self) -> DataFrame:
        return vocab_of(self.postings) if self._vocab is None else self._vocab

    @cached_property
    def stats(self) -> DataFrame:
        return stats_of(self.doc_stats) if self._stats is None else self._stats

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Index:
        """Keep the postings for many searches of one session; a lost executor's part is recomputed."""
        postings, doc_stats = self.postings.persist(level), self.doc_stats.persist(level)
        return Index(self.corpus, self.config, self.version, postings, doc_stats, vocab_of(postings).persist(level), stats_of(doc_stats).persist(level))

    def unpersist(self) -> None:
        for df in (self.postings, self.doc_stats, self.vocab, self.stats):
            df.unpersist()

    # changes; each gives a new snapshot

    def _changed(self, corpus: DataFrame, keep: Callable[[DataFrame], DataFrame], gone: DataFrame, new: DataFrame | None = None) -> Index:
        """``keep`` leaves out what goes from a table with doc_id; ``gone``: its records in the corpus; ``new``: records that come."""
        if self._postings is None or self._doc_stats is None:
            return Index(corpus, self.config, self.version + 1)
        postings, doc_stats, vocab = keep(self._postings), keep(self._doc_stats), None
        if new is not None:
            added = Index(new, self.config)
            postings, doc_stats = postings.unionByName(added.postings), doc_stats.unionByName(added.doc_stats)
        if self._vocab is not None:
            # what comes and goes is counted, not what stays
            less = blocks.vocab_in(blocks.blocks_of(Index(gone, self.config))).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
            counts = [self._vocab.select("term", "df", "cf"), less, *([blocks.vocab_in(blocks.blocks_of(added))] if new is not None else [])]
            vocab = reduce(DataFrame.unionByName, counts).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        return Index(corpus, self.config, self.version + 1, postings, doc_stats, vocab)

    def upsert(self, records: DataFrame) -> Index:
        """Add records; those whose id is there already replace it. Of repeated new ids the least record stays."""
        new = unique(records)
        ids = new.select("doc_id")

        def keep(df: DataFrame) -> DataFrame:
            return df.join(ids, "doc_id", "left_anti").select(*df.columns)

        # fields that the corpus lacks are null in its records, and the other way round
        return self._changed(keep(self.corpus).unionByName(new, allowMissingColumns=True), keep, self._records(records), new)

    def update(self, doc_id: int, record: DataFrame) -> Index:
        """Replace one document; an unknown id is an error."""
        self._must_have(doc_id)
        new = record.limit(1).withColumn("doc_id", F.lit(doc_id).cast("bigint"))

        def keep(df: DataFrame) -> DataFrame:
            return df.where(F.col("doc_id") != doc_id)

        return self._changed(keep(self.corpus).unionByName(new, allowMissingColumns=True), keep, self.document(doc_id), new)

    def delete(self, doc_id: int) -> Index:
        self._must_have(doc_id)

        def keep(df: DataFrame) -> DataFrame:
            return df.where(F.col("doc_id") != doc_id)

        return self._changed(keep(self.corpus), keep, self.document(doc_id))

    def delete_where(self, ids: DataFrame) -> Index:
        """Remove all documents of ``ids(doc_id)``."""

        def keep(df: DataFrame) -> DataFrame:
            return df.join(ids.select("doc_id"), "doc_id", "left_anti").select(*df.columns)

        return self._changed(keep(self.corpus), keep, self._records(ids))

    def _records(self, ids: DataFrame) -> DataFrame:
        """The records of ``ids(doc_id)``."""
        return self.corpus.join(ids.select("doc_id"), "doc_id", "left_semi").select(*self.corpus.columns)

    def _must_have(self, doc_id: int) -> None:
        if self.document(doc_id).isEmpty():
            raise KeyError(f"no document {doc_id}")

    def id_at(self, ordinal: int) -> int:
        """The id of the k-th document in id order, from 0."""
        found = self.corpus.select("doc_id").orderBy("doc_id").offset(ordinal).limit(1).collect() if ordinal >= 0 else []
        if not found:
            raise IndexError(f"no document at {ordinal}")
        return found[0][0]

    def update_at(self, ordinal: int, record: DataFrame) -> Index:
        return self.update(self.id_at(ordinal), record)

    def delete_at(self, ordinal: int) -> Index:
        return self.delete(self.id_at(ordinal))

    def optimize(self) -> Index:
        """Postings without repeated (term, doc_id), spread and sorted by them: of equal ones the first of a sorted range stays."""
        found = self.postings.where("term IS NOT NULL AND term <> ''")
        each = Window.partitionBy("term", "doc_id").orderBy("tf", "dl")
        placed = found.repartitionByRange(parts_for(found), "term", "doc_id").withColumn("_place", F.row_number().over(each))
        clean = placed.where("_place = 1").drop("_place").sortWithinPartitions("term", "doc_id")
        return Index(self.corpus, self.config, self.version + 1, clean, self.doc_stats)

    # single documents and reports

    def document(self, doc_id: int) -> DataFrame:
        return self.corpus.where(F.col("doc_id") == doc_id)

    def key_range(self, first: int, last: int) -> DataFrame:
        """Documents with first <= doc_id <= last."""
        return self.corpus.where(F.col("doc_id").between(first, last))

    def status(self) -> DataFrame:
        return self.stats.select(F.lit(self.config.name).alias("id"), F.col("n").alias("documents"), "avgdl")

    def health(self) -> DataFrame:
        """(status, documents, terms, issues): error without terms, warning without documents."""
        terms = self.vocab.agg(F.count("*").alias("terms"))
        both = self.stats.crossJoin(terms)
        issues = F.concat_ws("; ", F.when(F.col("n") == 0, "no documents"), F.when(F.col("terms") == 0, "no terms"))
        status = F.when(F.col("terms") == 0, "error").when(F.col("n") == 0, "warning").otherwise("healthy")
        return both.select(status.alias("status"), F.col("n").alias("documents"), "terms", issues.alias("issues"))

    def posting_sizes(self) -> DataFrame:
        """(term, postings, bytes): what delta and variable-length coding would make of each posting list.

        Runs of sorted postings are measured where they lie; only their ends are moved to be joined.
        """
        rows = self.postings
        if not self._ordered:
            rows = rows.repartitionByRange(parts_for(rows), "term", "doc_id").sortWithinPartitions("term", "doc_id")
        order = Window.partitionBy("term").orderBy("first", "last")
        step = F.col("first") - F.coalesce(F.lag("last").over(order), F.lit(0))
        joined = blocks.runs_of(rows, self._ordered).select("term", "postings", (varint_bytes(step) + F.col("rest")).alias("bytes"))
        return joined.groupBy("term").agg(F.sum("postings").alias("postings"), F.sum("bytes").alias("bytes"))


def term_counts(terms: Column) -> Column:
    """Array of (term, tf) of an array's distinct elements: runs of the sorted array."""

    def let(value: Column, then: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), then)[0]

    def runs(found: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
        return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(found, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(found)) - i).cast("bigint").alias("tf"))))

    return F.when(F.size(terms) > 0, let(F.sort_array(terms), runs))


def postings_of(forward: DataFrame) -> DataFrame:
    # an outer explode: the optimizer infers from an inner one a filter that counts the terms once more
    each = forward.select("doc_id", "dl", F.explode_outer("counts").alias("c")).where("c IS NOT NULL")
    return each.select("c.term", "doc_id", "c.tf", "dl")


#: Bytes of stored postings in one partition that is sorted or summed up: some 1.5 million rows.
SORTED = 8 << 20


def parts_for(df: DataFrame, most: int = 10_000) -> int:
    """Partitions to sort a table in: as the session has it, more where the files under it are large."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, min(most, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SORTED))


def vocab_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stats_of(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def unique(records: DataFrame) -> DataFrame:
    """One record for each doc_id: the least by its fields in order, so the same on every computation."""
    rest = [c for c in records.columns if c != "doc_id"]
    keys = [F.to_json(F.struct(f"`{c}`")) if isinstance(records.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f"`{c}`") for c in rest]
    order = Window.partitionBy("doc_id").orderBy(*(keys or ["doc_id"]))
    place = "_place"
    while place in records.columns:
        place += "_"
    return records.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def varint_bytes(value: Column) -> Column:
    """Bytes of a number at seven bits each; numbers below 1 take one byte."""
    out = F.lit(1).cast("bigint")
    for n in range(1, 9):
        out = out + F.when(value >= 1 << 7 * n, 1).otherwise(0)
    return out
