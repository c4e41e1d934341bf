"""The engine on a small corpus, against the figures of a brute-force model."""

import math
import re

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from textmill.functions.analyzer import STOP_WORDS
from textmill.operators import features, filters, rank
from textmill.operators.filters import Condition
from textmill.operators.index import Index
from textmill.operators.query import Bool, Custom, Field, Filter, Fuzzy, Not, Phrase, Range, Sql, Term, Wildcard
from textmill.plans.engine import Engine, LruCache, Request
from textmill.plans.parser import Builder, Parser
from textmill.sources import ingest, storage
from textmill.streaming.ingest import OperationLog

DOCS = [
    {"id": 1, "title": "Machine learning", "body": "Machines learn from data; learning is fun", "kind": "AI", "rating": 4.5, "date": "2024-01-15"},
    {"id": 2, "title": "Go programming", "body": "Programming in Go, with\nchannels", "kind": "Programming", "rating": 5.0, "date": "2024-02-01"},
    {"id": 3, "title": "Databases", "body": "Learning to store data in tables", "kind": "DB", "rating": 3.25, "date": None},
    {"id": 4, "title": "Café programming", "body": "", "kind": "Programming", "rating": None, "date": "x"},
    {"id": 5, "title": None, "body": None, "kind": None, "rating": 1.0},
]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(ingest.from_records(spark, DOCS, "id"), fields=("title", "body", "kind"))


def terms(record):
    joined = [t for f in ("title", "body", "kind") for t in re.findall("[a-z0-9_]+", (record[f] or "").lower())]
    return [t for t in joined if t not in STOP_WORDS]


def ids(df):
    return sorted(r[0] for r in df.collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_build(index):
    want = {(t, d["id"]): terms(d).count(t) for d in DOCS for t in terms(d)}
    assert {(r.term, r.doc_id): r.tf for r in index.postings.collect()} == want
    assert {r.doc_id: r.dl for r in index.doc_stats.collect()} == {d["id"]: len(terms(d)) for d in DOCS}
    row = index.stats.first()
    assert row.n == 5 and row.avgdl == pytest.approx(sum(len(terms(d)) for d in DOCS) / 5)
    assert index.health().first().status == "healthy"


def test_queries(index):
    assert ids(Term("Learning").ids(index)) == [1, 3]
    assert ids(Term("machine learning").ids(index)) == []
    for word, k in (("programing", 1), ("lern", 2), ("dta", 1)):
        want = sorted(d["id"] for d in DOCS if any(distance(word, t) <= k for t in terms(d)))
        assert ids(Term(word, True, k).ids(index)) == ids(Fuzzy(word, k).ids(index)) == want
    assert ids(Phrase("machine learning").ids(index)) == [1]
    assert ids(Phrase("learning to store").ids(index)) == []  # a stop word is never indexed
    assert ids(Phrase("lerning dta", True, 1).ids(index)) == [1, 3]
    assert ids(Phrase("...").ids(index)) == []
    assert ids(Field("kind", "Programming").ids(index)) == [2, 4]
    assert ids(Field("rating", "5").ids(index)) == [2]
    assert ids(Field("nothing", "5").ids(index)) == []
    assert ids(Wildcard("Data*", "title").ids(index)) == [3]
    assert ids(Wildcard("*in Go*", "body").ids(index)) == []  # the dot doesn't match a line feed
    assert ids(Wildcard("Machine?learning", "title").ids(index)) == [1]
    assert ids(Wildcard("dat*").ids(index)) == [1, 3]
    assert ids(Range("rating", 3.25, 5).ids(index)) == [1, 2, 3]
    assert ids(Range("date", 0, 1e9).ids(index)) == []
    assert ids(Fuzzy("lern", 2, "body").ids(index)) == [1]
    assert ids(Sql("rating > 4", Term("programming")).ids(index)) == [2]
    with pytest.raises(Exception):
        Sql("rating >").ids(index).collect()
    assert ids(Custom(lambda i: i.corpus.where("doc_id < 3")).ids(index)) == [1, 2]


def test_algebra(index):
    a, b = Term("learning"), Term("data")
    assert ids(Bool((a, b)).ids(index)) == ids(Bool((b, a)).ids(index)) == [1, 3]
    assert ids(Bool((a, Term("programming")), "or").ids(index)) == [1, 2, 3, 4]
    assert ids(Not(a).ids(index)) == [2, 4, 5]
    assert sorted(ids(a.ids(index)) + ids(Not(a).ids(index))) == [1, 2, 3, 4, 5]
    assert ids(Bool((a, Not(Field("kind", "AI")))).ids(index)) == [3]
    assert ids(Not(Field("kind", "AI")).ids(index)) == [2, 3, 4, 5]


def test_filters(spark, index):
    def of(*conditions, **more):
        return ids(Filter(tuple(conditions), **more).ids(index))

    assert of(Condition("kind", "eq", "AI")) == [1]
    assert of(Condition("kind", "ne", "AI")) == [2, 3, 4]
    assert of(Condition("kind", "in", ["AI", "DB"])) == [1, 3]
    assert of(Condition("kind", "contains", "gram"), Condition("rating", "gte", 5)) == [2]
    assert of(Condition("kind", "eq", "AI"), Condition("rating", "lt", 2), how="or") == [1, 5]
    assert of(Condition("kind", "eq", "AI", reverse=True)) == [2, 3, 4]
    wanted = spark.createDataFrame([("DB",), ("AI",)], "k string")
    assert of(Condition("kind", "in", keys=wanted)) == [1, 3]
    with pytest.raises(ValueError):
        Condition("kind", "like", "x").column()
    shown = index.corpus.where(filters.ui_filter(index.corpus.schema, "all", "contains", "CAFÉ"))
    assert ids(shown.select("doc_id")) == [4]


def test_bm25(index):
    n, avg = 5, sum(len(terms(d)) for d in DOCS) / 5

    def score(words, d):
        total = 0.0
        for w in words:
            df = sum(w in terms(x) for x in DOCS)
            tf = terms(d).count(w)
            if tf:
                total += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms(d)) / avg))
        return total

    for words in (["learning"], ["learning", "data", "learning"], ["nothing"]):
        got = {r.doc_id: r.score for r in rank.bm25(index, words, index.corpus).collect()}
        assert got == pytest.approx({d["id"]: score(words, d) for d in DOCS})
    assert {r.score for r in rank.search(index, Term("lerning", True, 1)).collect()} == {0.0}


@pytest.mark.parametrize(("total", "page", "size", "want"), [(25, 1, 10, (1, 10, 3)), (25, 9, 10, (3, 10, 3)), (25, 0, 0, (1, 10, 3)), (0, 4, 10, (1, 10, 0))])
def test_page_bounds(total, page, size, want):
    assert rank.page_bounds(total, page, size) == want


def test_parser():
    p = Parser()
    assert p.parse("learning") == Term("learning", True, 1)
    assert p.parse("machine learning") == Phrase("machine learning", True, 1)
    assert p.parse('"machine learning"') == Phrase("machine learning")
    assert p.parse("kind:AI") == Field("kind", "AI")
    assert p.parse("ab*") == Wildcard("ab*")
    assert p.parse("a1 AND NOT b1") == Bool((Term("a1", True, 1), Not(Term("b1", True, 1))))
    assert p.parse("a1 and b1 or c1").how == "or"
    assert isinstance(p.parse("NOT a1"), Phrase)  # a leading operator is a word
    assert isinstance(Parser(strict=False).parse('"a b" or c1'), Bool)
    for bad in ("", "  ", ":x", "x:"):
        with pytest.raises(ValueError):
            p.parse(bad)
    p.add_synonym("car", ["auto"])
    assert isinstance(p.parse("car"), Phrase)
    assert Builder().build() is None
    assert Builder().term("a").any().term("b").build() == Bool((Term("a", True, 1), Term("b", True, 1)), "or")


def test_changes(spark, index):
    new = ingest.from_records(spark, [{"title": "Machine", "body": "new words"}])
    changed = index.update(3, new)
    assert changed.version == 2 and ids(Term("words").ids(changed)) == [3] and ids(Term("store").ids(changed)) == []
    assert index.stats.first().n == changed.stats.first().n == 5
    back = index.upsert(ingest.from_records(spark, [{"id": 9, "title": "nine"}], "id").drop("id")).delete(9)
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    with pytest.raises(KeyError):
        index.delete(77)
    assert ids(index.delete_at(1).corpus.select("doc_id")) == [1, 3, 4, 5]
    with pytest.raises(IndexError):
        index.delete_at(5)


def test_store(spark, index, tmp_path):
    path = str(tmp_path / "index")
    storage.save_index(index, path)
    storage.save_index(index.delete(2), path)
    old, new = storage.load_index(spark, path, index.config, 1), storage.load_index(spark, path, index.config)
    assert sorted(map(tuple, old.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    assert new.version == 2 and ids(Term("programming").ids(new)) == [4]
    assert storage.versions(spark, path).count() == 2


def test_features(spark, index):
    got = {r.term: r.cf for r in features.suggest(index, "Pro").collect()}
    assert got == {"programming": 5}
    asked = spark.createDataFrame([("lerning",), ("data",), ("zzzzzz",)], "token string")
    assert {r.token: r.corrected for r in features.autocorrect(index, asked).collect()} == {"lerning": "learning", "data": "data", "zzzzzz": "zzzzzz"}
    marked = features.highlight(index.document(1), ["learning"]).first().highlights
    assert marked == {"title": "Machine <mark>learning</mark>", "body": "Machines learn from data; <mark>learning</mark> is fun"}
    bits, hashes = features.bloom_size(1000, 0.01)
    words = spark.createDataFrame([("machine",), ("learning",)], "w string")
    made = features.bloom_build(words, "w", bits, hashes)
    asked = spark.createDataFrame([("machine",), ("learning",), ("other",), ("more",)], "w string")
    assert {r.element: r.maybe for r in features.bloom_contains(made, asked, "w", bits, hashes).collect()} == {"machine": True, "learning": True, "other": False, "more": False}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 7, "t": "x"}, {"id": 8, "t": null}]')
    assert ingest.row_count(spark, str(tmp_path / "a.json")) == 2
    assert ids(ingest.as_corpus(spark, str(tmp_path / "a.json"), "id").select("doc_id")) == [7, 8]
    assert ids(ingest.as_corpus(spark, '[{"id": 1}, 5, {"id": 2}]', "id").select("doc_id")) == [1, 2]
    assert ingest.as_corpus(spark, ["one", "two"]).columns == ["content", "doc_id"]
    first = ids(ingest.as_corpus(spark, ["one", "two"]).select("doc_id"))
    assert first == ids(ingest.as_corpus(spark, {"data": ["one", "two"]}).select("doc_id"))
    with pytest.raises(TypeError):
        ingest.adapt(3.5)
    assert ingest.from_records(spark, []).count() == 0


def test_empty_corpus(spark):
    index = Index.build(spark.createDataFrame([], "doc_id bigint, text string"))
    assert index.health().first().status == "error"
    assert rank.search(index, Term("x")).count() == 0
    assert rank.paginate(rank.search(index, Term("x")), [F.desc("score")]).total_pages == 0


def test_engine(spark):
    engine = Engine(spark)
    engine.create("docs", DOCS, "id", fields=("title", "body", "kind"))
    found = engine.search("docs", Request("learning", search_type="exact"))
    assert found.total == 2 and [r.doc_id for r in found.items.collect()] in ([1, 3], [3, 1])
    assert engine.search("docs", Request("learning", sort_field="rating", sort_order="desc", search_type="exact")).items.first().doc_id == 1
    assert engine.search("docs", Request("machine learning", fast=True)).items.first().score == 1.0
    assert engine.search_with_highlights("docs", Request("programming", size=1)).total_pages == 2
    with pytest.raises(ValueError):
        engine.search("docs", Request())
    engine.replace("docs", engine.get("docs").delete(1))
    assert engine.search("docs", Request("learning", search_type="exact")).total == 1
    assert engine.query_log().count() == 5
    assert engine.metrics().first().queries == 5
    one, other = Condition("a", "eq", 1), Condition("b", "eq", 2)
    assert Request("x", (one, other)).checksum() == Request("x", (other, one)).checksum()
    engine.drop("docs")
    assert engine.names() == []


def test_cache():
    now = [0.0]
    cache = LruCache(2, ttl=10, clock=lambda: now[0])
    cache.put("a", 1)
    cache.put("b", 2)
    assert cache.get("a") == 1
    cache.put("c", 3)
    assert cache.get("b") is None and cache.get("a") == 1
    now[0] = 11
    assert cache.get("a") is None and cache.hit_rate() == 0.5


def test_operation_log(spark, tmp_path):
    log = OperationLog(spark, str(tmp_path / "log"), "doc_id bigint, t string")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, t string")
    log.append(first, 0)
    log.append(first, 0)  # a repeated batch
    ops = [("update", 1, 1, "x"), ("delete", 2, 1, None), ("delete", 3, 1, None), ("index", 3, 2, "again")]
    log.append(spark.createDataFrame(ops, "op string, doc_id bigint, seq bigint, t string"), 1)
    want = [(1, "x"), (3, "again")]
    assert sorted(map(tuple, log.snapshot().collect())) == want
    assert sorted(map(tuple, log.compact(str(tmp_path / "small")).snapshot().collect())) == want


def test_changes_tokenise_only_what_is_new(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta{i}") for i in range(20)], "doc_id bigint, text string")
    made = Index.build(docs, fields=("text",))
    storage.save_index(made, str(tmp_path))
    stored = storage.load_index(spark, str(tmp_path), made.config)
    new = spark.createDataFrame([(3, "gamma"), (99, "gamma delta"), (99, "zeta")], "doc_id bigint, text string")
    for changed, plain in (
        (stored.upsert(new), made.upsert(new)),
        (stored.delete(5), made.delete(5)),
        (stored.delete_where(new), made.delete_where(new)),
        (stored.update(7, new.limit(1).select("text")), made.update(7, new.limit(1).select("text"))),
    ):
        for name in ("postings", "doc_stats", "vocab", "stats"):
            columns = sorted(getattr(plain, name).columns)
            assert sorted(getattr(changed, name).select(columns).collect()) == sorted(getattr(plain, name).select(columns).collect())
    tree = stored.delete(5).postings._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in tree
    assert stored.upsert(new).document(99).collect()[0].text == "gamma delta"


def test_search_with_key_tables_and_kept_pages(spark):
    engine = Engine(spark)
    engine.create("d", [{"id": i, "text": f"alpha {'x' * (i % 3)}", "n": i} for i in range(30)], "id")
    keys = spark.createDataFrame([(3,), (4,), (8,)], "doc_id bigint")
    request = Request("alpha", (Condition("doc_id", "in", keys=keys),), sort_field="n", sort_order="desc", size=2)
    found = engine.search("d", request)
    assert [r.doc_id for r in found.items.collect()] == [8, 4] and (found.total, found.total_pages, found.next_page) == (3, 2, 2)
    before = engine.cache.hits
    again = engine.search("d", request)
    assert engine.cache.hits == before + 1 and [r.doc_id for r in again.items.collect()] == [8, 4]
    other = Request("alpha", (Condition("doc_id", "in", keys=keys.limit(1)),), sort_field="n")
    assert other.checksum() != request.checksum()
    engine.replace("d", engine.get("d").delete(8))
    assert [r.doc_id for r in engine.search("d", request).items.collect()] == [4, 3]
    assert len(engine.log) == 3 and engine.log.maxlen and {r["index"]: r.queries for r in engine.metrics().collect()} == {"d": 3}


def test_created_index_replaces_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id bigint, text string")
    index = Engine(spark).create("d", docs)
    assert sorted(r.text for r in index.corpus.collect()) == ["a", "c"]
    assert {r.term: r.df for r in index.vocab.collect()} == {"c": 1}  # a is a stop word


def test_late_operations(spark, tmp_path):
    log = OperationLog(spark, str(tmp_path / "log"), "doc_id bigint, text string")
    schema = "op string, seq bigint, doc_id bigint, text string"
    log.append(spark.createDataFrame([("index", 5, 1, "new"), ("delete", 9, 2, None)], schema), 0)
    log.append(spark.createDataFrame([("index", 3, 1, "late"), ("index", 8, 2, "late"), ("index", 1, 3, "only")], schema), 1)
    assert sorted(map(tuple, log.snapshot().collect())) == [(1, "new"), (3, "only")]


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    log = OperationLog(spark, str(tmp_path / "log"), "doc_id bigint, text string")
    for k, text in enumerate(("one", "two", "three")):
        spark.createDataFrame([(k, text), (100, text)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / f"source{k}"))
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / f"source{k}"))
        log.start(stream, str(tmp_path / f"checkpoint{min(k, 1)}{k}")).awaitTermination()
    assert sorted(map(tuple, log.snapshot().collect())) == [(0, "one"), (1, "two"), (2, "three"), (100, "three")]
    base = log._base(str(tmp_path / "checkpoint11"))
    assert base == 1 and log._base(str(tmp_path / "checkpoint12")) == 2


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(i, f"text {i}") for i in range(100)]
    try:
        spark.createDataFrame(rows, "id bigint, body string").write.format("jdbc").option("url", url).option("dbtable", "docs").option("driver", driver).save()
    except Py4JJavaError as e:
        pytest.skip(f"no database driver: {e.java_exception}")
    query = "SELECT \"id\", \"body\" FROM docs WHERE \"id\" < 90"
    plain = ingest.from_jdbc(spark, url, query, "id", driver=driver)
    parts = ingest.from_jdbc(spark, url, query, "id", partition_column='"id"', partitions=4, driver=driver)
    for df in (plain, parts, ingest.as_corpus(spark, {"database": {"url": url, "query": query, "driver": driver}}, "id")):
        assert sorted((r.doc_id, r.body) for r in df.collect()) == rows[:90]
    assert parts.rdd.getNumPartitions() == 4


def test_row_count(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert ingest.row_count(spark, str(tmp_path / "a.json")) == 3
    assert ingest.row_count(spark, str(tmp_path / "b.json"), lines=True) == 2


@pytest.mark.parametrize("limit", [10_000, 0])
def test_autocorrect_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(features, "MAX_ASKED", limit)
    words = ["kitten", "sitting", "mitten", "abc", "zebra", "été"]
    index = Index.build(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"))
    asked = spark.createDataFrame([(t,) for t in ["kiten", "zebra", "sittin", "nothing_like", "abd", "ab", "", "kitten"]], "token string")
    got = {r.token: r.corrected for r in features.autocorrect(index, asked).collect()}
    assert got == {"kiten": "kitten", "zebra": "zebra", "sittin": "sitting", "nothing_like": "nothing_like", "abd": "abc", "ab": "abc", "": "t", "kitten": "kitten"}
