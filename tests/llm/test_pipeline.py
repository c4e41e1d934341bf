"""The corpus pipeline against a brute-force composition of its stages, and the query registry."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from textmill.llm import bpe, registry
from textmill.llm.common import checkpoint_dir

from .test_dedup import brute_copies, brute_groups, prose
from .test_text import brute_leaks

TOXIC = ["grobian", "schuft", "lump", "wicht"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, rows, labels = random.Random(21), [], []
    items = [(k, prose(rng, 40)) for k in range(5)]
    toxic = set()

    def add(text):
        rows.append((len(rows), text))
        return len(rows) - 1

    for i in range(500):
        words = prose(rng, rng.randrange(20, 60)).split()
        if i % 6 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        at = add(" ".join(words))
        toxic |= {at} if i % 6 == 0 else set()
        labels.append((at, 1, int(i % 6 == 0)))
        if i % 6 and i % 25 == 1:
            add(rows[at][1])
        if i % 6 and i % 25 == 3:
            near = list(words)
            near[3] = "changed"
            add(" ".join(near))
        if i % 6 and i % 40 == 7:
            add(prose(rng, 20) + " " + rng.choice(items)[1].upper() + " " + prose(rng, 5))
    add(None)
    add("")
    at = tmp_path_factory.mktemp("sf")
    n = len(rows)
    tables = {
        "documents": {"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows]), "lang": pa.array(["en"] * n), "source": pa.array(["s"] * n), "n_chars": pa.array([len(t or "") for _, t in rows])},
        "labels": {"doc_id": pa.array([x[0] for x in labels]), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())},
        "benchmark": {"item_id": pa.array([i for i, _ in items]), "text": pa.array([t for _, t in items])},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), at / f"{name}.parquet")
    return str(at), rows, items, toxic


def test_pipeline(spark, folder):
    sf_dir, rows, items, toxic = folder
    kept = [(i, t) for i, t in rows if i not in toxic]
    gone = {i for i, _ in brute_copies(kept)}
    kept = [r for r in kept if r[0] not in gone]
    near = set(brute_groups(kept, 24))
    kept = [r for r in kept if r[0] not in near]
    leaks = {d for d, _, _ in brute_leaks(kept, items)}
    kept = [r for r in kept if r[0] not in leaks]
    assert gone and near and leaks
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in kept}
    table = bpe.read_ranks(bpe.VOCABULARY)
    for i, text in kept:
        assert (got[i].tokens is None) == (text is None)
        assert text is None or b"".join(table[t] for t in got[i].tokens).decode() == text


def test_stages_keep_the_columns(spark, folder):
    sf_dir, *_ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_of_odd_rows(spark, folder, tmp_path):
    """Nulls in any column, repeated rows, ties, a very long text, columns with the operators' own names; no labels."""
    rng = random.Random(5)
    own, long = prose(rng, 30), prose(rng, 60_000)
    rows = [(1, own), (1, own), (2, own), (None, own), (None, None), (3, None), (3, None), (4, ""), (5, ""), (6, long), (7, long + " x"), (None, "no id here")]
    names = ("digest", "_gone_digest", "again", "list", "low", "key", "toxic", "Tokens")
    table = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": pa.array([None] * len(rows), pa.string())}
    pq.write_table(pa.table(table | {n: pa.array(range(len(rows))) for n in names}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([None, 1], pa.int64()), "toxic": pa.array([1, None], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([None], pa.int64()), "text": pa.array([None], pa.string())}), tmp_path / "benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    vocabulary = bpe.read_ranks(bpe.VOCABULARY)
    texts = [(r.doc_id, None if r.tokens is None else b"".join(vocabulary[t] for t in r.tokens).decode()) for r in got]
    assert sorted(texts, key=str) == sorted([(1, own), (None, None), (3, None), (3, None), (4, ""), (6, long), (None, "no id here")], key=str)
    for name in ("documents", "labels", "benchmark"):
        whole = pq.read_table(tmp_path / f"{name}.parquet")
        pq.write_table(whole.slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_shared_folder(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
