"""Columns of a table that are named as an operator's own."""

import pytest

from textmill.llm import bpe, decontaminate, exact_dedup, license_scan, line_dedup, simhash, suffix_dedup, toxicity

CLASHING = ["_gone_digest", "_gone_id", "_again", "_near_id", "_leaked_id", "_line_doc", "_lines", "digest", "seed", "list", "low", "high", "id", "score", "toxic", "item_id", "passage", "tokens", "ids", "h1", "key", "first", "a", "b", "kept_doc_id"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "same words here\nMIT License"), (2, "same words here\nMIT License"), (3, "other words"), (4, None), (None, "lone")]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *[None if k % 2 else "v" for k in range(len(CLASHING))]) for r in rows], schema)


def test_clashing_names(spark, docs):
    labels = spark.createDataFrame([(1, 0, "x"), (3, 1, None)], "doc_id bigint, toxic int, text string")
    benchmark = spark.createDataFrame([(1, "lone", 7)], "item_id bigint, text string, doc_id bigint")
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    for kept in (toxicity.drop_toxic(docs, labels), exact_dedup.drop_copies(docs), simhash.drop_near_copies(docs), decontaminate.drop_contaminated(docs, benchmark)):
        assert kept.columns == docs.columns
        kept.collect()
    assert ids(exact_dedup.drop_copies(docs)) == [1, 3, 4, None]
    assert ids(simhash.drop_near_copies(docs)) == [1, 3, 4, None]
    assert ids(decontaminate.drop_contaminated(docs, benchmark)) == [1, 2, 3, 4]
    found = line_dedup.repeated_lines(docs)
    assert sorted(map(tuple, found.collect())) == [(2, 0, 1, 0), (2, 1, 1, 1)]
    without = line_dedup.drop_lines(docs, found)
    assert without.columns == docs.columns and without.where("doc_id = 2").first().text == ""
    assert suffix_dedup.repeated_spans(docs).count() == 0
    assert license_scan.scan(docs).count() == 2
    assert bpe.encode(docs).count() == 5
    assert toxicity.toxicity(docs, labels).columns == ["doc_id", "score", "toxic"]
