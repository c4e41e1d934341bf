"""Indexes stored by way of blocks, against the lazy plans that say the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textmill import catalog
from textmill.functions.analyzer import Analyzer
from textmill.operators import blocks, rank
from textmill.operators.index import Index
from textmill.sources import storage


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    drawn = random.Random(5)
    words = [*(f"w{i}" for i in range(40)), "The", "AND", "straße", "İx", "K", "a_b", "_", "9", "日本", "x y", "tab\tq", "nul\x00z"]
    texts = [" ".join(drawn.choices(words, k=drawn.choice((0, 1, 3, 30, 300)))) for _ in range(300)]
    texts[3:6] = [None, "", " the and "]
    made = [(drawn.choice((-1, 1)) * i * 7, t, i / 4, [t or "none"]) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id bigint, text string, n double, listed array<string>")


ANALYZERS = {"plain": Analyzer(), "no stop words": Analyzer(stop_words=()), "stemmed": Analyzer.make(stem=True), "own": Analyzer.make(tokenizer=lambda c: F.split(c, "w"))}


@pytest.mark.parametrize("kind", ANALYZERS)
@pytest.mark.parametrize("fields", [("text",), ("text", "n", "listed"), ()])
def test_stored_is_what_the_plans_give(spark, corpus, tmp_path, kind, fields):
    made = Index.build(corpus, fields=fields, analyzer=ANALYZERS[kind])
    storage.save_index(made, str(tmp_path))
    stored = storage.load_index(spark, str(tmp_path), made.config)
    for name in ("postings", "doc_stats", "vocab", "stats"):
        assert getattr(stored, name).dtypes == getattr(made, name).dtypes
        assert rows(getattr(stored, name)) == rows(getattr(made, name)), name
    assert rows(stored.corpus) == rows(corpus)


def test_blocks_of_any_size(corpus):
    made = Index.build(corpus, fields=("text",))
    for size, row in ((1, 1), (500, 3), (1 << 30, 1 << 20)):
        found = blocks.blocks_of(made, size, row)
        assert rows(blocks.postings_in(found)) == rows(made.postings)
        assert rows(blocks.doc_stats_in(found)) == rows(made.doc_stats)
        assert rows(blocks.vocab_in(found)) == rows(made.vocab)


def test_stored_files_are_sorted_and_disjoint(spark, corpus, tmp_path):
    storage.save_index(Index.build(corpus, fields=("text",)), str(tmp_path))
    for table, key in (("corpus", ["doc_id"]), ("postings", ["term", "doc_id"])):
        found = spark.read.parquet(f"{tmp_path}/v1/{table}").select(F.input_file_name().alias("file"), *key).collect()
        files = {}
        for file, *at in found:
            files.setdefault(file, []).append(at)
        spans = sorted(files.values())
        assert len(spans) > 1 and [x for s in spans for x in s] == sorted(x for s in spans for x in s)


def test_no_text_is_read_to_lay_out_the_corpus(spark, corpus, tmp_path):
    """Ranges were decided from whole records, and every posting was sorted as a row of its own."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    once = corpus.withColumn("text", F.udf(count)("text"))
    blocks.by_id(once, 4).write.format("noop").mode("overwrite").save()
    assert seen.value == corpus.count()
    made = blocks.blocks_of(Index.build(corpus.coalesce(1), fields=("text",)))
    assert 3 * made.count() < Index.build(corpus, fields=("text",)).postings.count()


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    made = Index.build(corpus, fields=("text",))
    path = str(tmp_path_factory.mktemp("stored"))
    storage.save_index(made, path)
    return storage.load_index(spark, path, made.config)


def size(n):
    return max(1, -(-max(n, 1).bit_length() // 7))


def test_sizes_are_measured_where_postings_lie(corpus, stored):
    """all postings went over the network to be sorted for a window."""
    lists = {}
    for term, doc_id, tf in stored.postings.select("term", "doc_id", "tf").orderBy("term", "doc_id").collect():
        count, total, last = lists.get(term, (0, 0, 0))
        lists[term] = count + 1, total + size(doc_id - last) + size(tf), doc_id
    want = sorted(((t, n, b) for t, (n, b, _) in lists.items()), key=repr)
    lazy = Index.build(corpus, fields=("text",))
    union = Index(stored.corpus, stored.config, 1, stored.postings.where("doc_id % 2 = 0").union(stored.postings.where("doc_id % 2 <> 0")), stored.doc_stats)
    for index in (stored, lazy, union):
        assert rows(index.posting_sizes(), "term", "postings", "bytes") == want
    plan = stored.posting_sizes()._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan[plan.index("Window") :]


def test_a_change_counts_what_comes_and_goes(spark, corpus, stored):
    """the vocabulary was counted anew from all postings that stay."""
    lazy = Index.build(corpus, fields=("text",))
    new = corpus.where("doc_id < 700").withColumn("text", F.concat("text", F.lit(" only here")))
    more = new.unionByName(new.withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.lit("only there")}))
    for change in (lambda i: i.upsert(more), lambda i: i.delete_at(12), lambda i: i.delete_where(more), lambda i: i.update_at(5, new.limit(1).select("text"))):
        changed = change(stored)
        assert rows(changed.vocab) == rows(change(lazy).vocab)
        assert changed.vocab.dtypes == stored.vocab.dtypes
        assert not [f for f in changed.vocab.inputFiles() if "/postings/" in f]


def test_a_document_is_scored_in_one_place(spark, corpus, stored):
    """a sum for each query and document went over the network."""
    asked = spark.createDataFrame([(q, f"w{(q * k) % 45}") for q in range(12) for k in range(5)] + [(99, None)], "qid long, term string")
    found, lazy = rank.batch_topk(stored, asked), rank.batch_topk(Index.build(corpus, fields=("text",)), asked)
    near = [F.round("score", 6).alias("score")]
    assert rows(found.select("qid", "rank", "doc_id", *near)) == rows(lazy.select("qid", "rank", "doc_id", *near))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(qid#" in plan
    assert "hashpartitioning(a.qid" not in plan and not re.search(r"hashpartitioning\([^)]*qid[^)]*, doc_id", plan)


def test_repeated_postings_go_without_a_table_of_all(stored):
    """every task held a hash table of all the postings it read."""
    doubled = Index(stored.corpus, stored.config, 1, stored.postings.union(stored.postings), stored.doc_stats).optimize()
    assert rows(doubled.postings) == rows(stored.postings)
    assert "Aggregate" not in doubled.postings._jdf.queryExecution().optimizedPlan().toString()


def test_a_streamed_file_is_a_split_of_the_table(spark, tmp_path):
    """a copy of the table was two files, whatever its size, and each was written by one task."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("en").alias("lang"))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    splits = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(splits)
    try:
        spark.conf.set(splits, "100k")
        found = catalog.stream_upsert(spark, str(tmp_path))
    finally:
        spark.conf.set(splits, before)
    assert rows(found) == rows(docs)
    assert len({f.split("batch=")[1].split("/")[0] for f in found.inputFiles()}) > 8
