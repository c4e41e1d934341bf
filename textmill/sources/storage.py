"""The folder that all executors share, and index snapshots in it as Parquet."""

from __future__ import annotations

import tempfile
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from textmill.operators.index import Index, IndexConfig


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode, where one machine is all there is."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textmill-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


class PostingStore(Protocol):
    """Where postings are read from: an ``Index``, or anything else with these tables."""

    @property
    def postings(self) -> DataFrame: ...

    @property
    def vocab(self) -> DataFrame: ...


class DocStore(Protocol):
    """Where records are read from."""

    def document(self, doc_id: int) -> DataFrame: ...

    def key_range(self, first: int, last: int) -> DataFrame: ...


class IndexWriter(Protocol):
    """What changes an index; every change gives a new snapshot."""

    def upsert(self, records: DataFrame) -> Index: ...

    def delete(self, doc_id: int) -> Index: ...

    def delete_where(self, ids: DataFrame) -> Index: ...


def save_index(index: Index, path: str) -> int:
    """Write a snapshot as a new version, and return its number.

    The row in ``meta`` is written last, so a version is visible only when it is whole, and readers of
    older versions are never disturbed.  Records are tokenised once, into blocks (``operators.blocks``) that are
    staged; postings, lengths and vocabulary are made from them.  Postings are range-partitioned by
    (term, doc_id): a frequent term is spread over several files, and a search reads only the row groups
    whose range has the term.  The corpus is laid out by doc_id, so a page of records is read from a few
    row groups.  Vocabulary and statistics are stored with them.
    """
    from textmill.operators import blocks
    from textmill.operators.index import Index, stats_of, vocab_of

    spark = index.corpus.sparkSession
    version = index.version
    at = f"{path}/v{version}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.by_id(index.corpus, parts).write.mode("overwrite").parquet(f"{at}/corpus")
    if index._postings is None:
        # read again from the spread corpus, however few splits its source has; its files are disjoint in their
        # ids, so blocks are too, and lists sorted by (term, first) are postings sorted by (term, doc_id)
        blocks.blocks_of(Index(spark.read.parquet(f"{at}/corpus"), index.config), by_file=True).write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(f"{at}/staged")
        staged = spark.read.parquet(f"{at}/staged")
        lists = staged.where("term IS NOT NULL").select("term", "first", "ids", "tfs", "dls")
        postings = blocks.postings_in(lists.repartitionByRange(parts, "term", "first").sortWithinPartitions("term", "first"))
        doc_stats = blocks.doc_stats_in(staged)
    else:
        postings = index.postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term", "doc_id")
        doc_stats = index.doc_stats
    postings.write.mode("overwrite").parquet(f"{at}/postings")
    doc_stats.write.mode("overwrite").parquet(f"{at}/doc_stats")
    vocab = blocks.vocab_in(staged) if index._postings is None else vocab_of(spark.read.parquet(f"{at}/postings"))
    vocab.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/vocab")
    stats_of(spark.read.parquet(f"{at}/doc_stats")).write.mode("overwrite").parquet(f"{at}/stats")
    _remove(spark, f"{at}/staged")
    meta = spark.read.parquet(f"{at}/stats").select(F.lit(index.config.name).alias("id"), F.lit(version).cast("bigint").alias("version"), F.col("n").alias("total_docs"), F.col("avgdl").alias("avg_doc_length"), F.current_timestamp().alias("timestamp"))
    meta.coalesce(1).write.mode("append").parquet(f"{path}/meta")
    return version


def _remove(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all snapshots."""
    return spark.read.parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, config: IndexConfig, version: int | None = None) -> Index:
    """The newest snapshot, or a given one, with all that was stored of it."""
    from textmill.operators.index import Index

    if version is None:
        version = versions(spark, path).agg(F.max("version")).first()[0]
    at = f"{path}/v{version}"
    corpus, *tables = (spark.read.parquet(f"{at}/{name}") for name in ("corpus", "postings", "doc_stats", "vocab", "stats"))
    return Index(corpus, config, version, *tables, ordered=True)
