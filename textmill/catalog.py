"""Queries of the search engine by name, and DuckDB SQL that says the same.

Searches run on an index of ``documents.text`` that is built once for each application and folder,
and read from the shared folder, as a search engine's would be.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text
from textmill.functions.analyzer import DEFAULT, STOP_WORDS, Analyzer
from textmill.operators import features, filters, rank
from textmill.operators.filters import Condition
from textmill.operators.index import Index
from textmill.operators.query import Bool, Field, Filter, Fuzzy, Not, Phrase, Query, Range, Sql, Term, Wildcard, token_union
from textmill.plans.engine import Engine, Request
from textmill.plans.parser import Builder, Parser
from textmill.sources import ingest, storage
from textmill.streaming.ingest import DELETE, INDEX, UPDATE, OperationLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lazy(spark: SparkSession, sf_dir: str, analyzer: Analyzer = DEFAULT) -> Index:
    return Index.build(_table(spark, sf_dir, "documents"), name="documents", fields=("text",), analyzer=analyzer)


_built: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of a folder's documents; built at the first call of an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        made = _lazy(spark, sf_dir)
        path = f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}"
        storage.save_index(made, path)
        _built[key] = storage.load_index(spark, path, made.config)
    return _built[key]


def _keyed(spark: SparkSession, sf_dir: str, table: str, key: str) -> Index:
    """An index over any table, for queries on its fields."""
    return Index.build(ingest.with_ids(_table(spark, sf_dir, table), key), name=table)


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def _top(hits: DataFrame, n: int = 10) -> DataFrame:
    """The first n by rounded score, so that both engines break ties alike."""
    return rank.ranked(_scored(hits), [F.desc("score"), F.asc("doc_id")], n)


# SQL pieces

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tok(c: str) -> str:
    return f"regexp_extract_all(translate({c}, {_AZ}), '[a-z0-9_]+')"


_P = f"""toks AS (SELECT doc_id, unnest({_tok("text")}) AS term FROM documents),
postings AS (SELECT term, doc_id, count(*) AS tf FROM toks WHERE term NOT IN ({_STOP}) GROUP BY ALL),
lens AS (SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS dl FROM documents d LEFT JOIN postings USING (doc_id) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"""


def _with(select: str, more: str = "") -> str:
    return f"WITH {_P}{',' + more if more else ''} {select}"


def _weights(words: dict[str, int]) -> str:
    """CTE scored(doc_id, score) of a bag of words."""
    rows = ", ".join(f"('{w}', {n})" for w, n in words.items())
    return f"""
wanted(term, qtf) AS (VALUES {rows}),
scored AS (
  SELECT doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM postings JOIN wanted USING (term) JOIN vocab USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY doc_id)"""


def _has(*words: str) -> str:
    return " INTERSECT ".join(f"SELECT doc_id FROM postings WHERE term = '{w}'" for w in words)


def _near(word: str, k: int) -> str:
    return f"SELECT DISTINCT doc_id FROM postings WHERE levenshtein(term, '{word}') <= {k}"


def _all_near(words: list[str], k: int) -> str:
    return " INTERSECT ".join(_near(w, k) for w in words)


_STEM = """CASE WHEN length(w) <= 3 THEN w
  WHEN suffix(w, 'ying') AND length(w) >= 6 THEN w[:-5]
  WHEN suffix(w, 'ing') AND length(w) >= 5 THEN
    CASE WHEN length(w) > 5 AND w[-4:-4] = w[-5:-5] AND w[-4:-4] NOT IN ('l', 's', 'z') THEN w[:-5] ELSE w[:-4] END
  WHEN suffix(w, 'ly') AND length(w) >= 5 THEN w[:-3]
  WHEN suffix(w, 'ed') THEN w[:-3]
  WHEN suffix(w, 'ies') THEN w[:-4] || 'y'
  WHEN suffix(w, 's') THEN w[:-2] ELSE w END"""
_STEM_FAST = """CASE WHEN length(w) <= 3 THEN w
  WHEN suffix(w, 'ing') THEN CASE WHEN length(w) <= 4 THEN w
    WHEN length(w) > 5 AND w[-4:-4] = w[-5:-5] AND w[-4:-4] NOT IN ('l', 's', 'z') THEN w[:-5] ELSE w[:-4] END
  WHEN suffix(w, 'ly') OR suffix(w, 'ed') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w END
  WHEN suffix(w, 'ies') THEN CASE WHEN length(w) > 4 THEN w[:-4] || 'y' ELSE w END
  WHEN suffix(w, 's') AND w[-2:-2] <> 's' THEN w[:-2] ELSE w END"""
_NUM = "regexp_replace(regexp_replace(cast(cast({c} AS decimal(38,10)) AS varchar), '0+$', ''), '[.]$', '')"


def _counted(tokens: Column, name: str = "term") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


# analysis


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.tokenize("text"))(_table(spark, sf_dir, "documents"))


@query(r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS term FROM documents) GROUP BY term")
def tokenize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.tokenize_unicode("text"))(_table(spark, sf_dir, "documents"))


@query(rf"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, {_AZ}), '[\p{{L}}\p{{Nd}}]+')) AS term FROM documents) GROUP BY term")
def tokenize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.tokenize_legacy("text"))(_table(spark, sf_dir, "documents"))


@query(f"SELECT stem, count(*) AS n FROM (SELECT {_STEM} AS stem FROM (SELECT unnest({_tok('text')}) AS w FROM documents)) GROUP BY stem")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.tokenize_stemmed("text"), "stem")(_table(spark, sf_dir, "documents"))


@query(f"SELECT stem, count(*) AS n FROM (SELECT {_STEM_FAST} AS stem FROM (SELECT unnest({_tok('text')}) AS w FROM documents)) GROUP BY stem")
def stem_fast_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.tokenize_fast("text"), "stem")(_table(spark, sf_dir, "documents"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS term FROM documents) WHERE term NOT IN ({_STOP}) GROUP BY term")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(DEFAULT.tokens(F.col("text")))(_table(spark, sf_dir, "documents"))


@query(f"SELECT l_orderkey, l_linenumber, {_NUM.format(c='l_discount')} AS discount, {_NUM.format(c='l_quantity')} AS quantity FROM lineitem")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.num_to_text("l_discount").alias("discount"), text.num_to_text("l_quantity").alias("quantity"))


@query(f"""SELECT p_partkey, concat_ws(' ', p_brand, p_name, cast(p_partkey AS varchar), {_NUM.format(c="p_retailprice")}, cast(p_size AS varchar), p_type) AS record FROM part""")
def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", text.record_text(part.schema, part.columns).alias("record"))


# the index


@query(_with("SELECT term, doc_id, tf, dl FROM postings JOIN lens USING (doc_id)"))
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).postings


@query(f"SELECT stem AS term, doc_id, count(*) AS tf FROM (SELECT doc_id, {_STEM_FAST} AS stem FROM (SELECT doc_id, unnest({_tok('text')}) AS w FROM documents)) GROUP BY ALL")
def postings_fast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir, Analyzer.fast()).postings.drop("dl")


@query(_with("SELECT doc_id, dl FROM lens"))
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).doc_stats


@query(_with("SELECT n, round(avgdl, 6) AS avgdl FROM stats"))
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(_with("SELECT term, df, cf FROM vocab"))
def vocab_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).vocab


@query(f"""WITH t AS (SELECT p_partkey AS doc_id, unnest({_tok("p_name")} || {_tok("p_type")}) AS term FROM part)
SELECT term, doc_id, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL""")
def field_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = ingest.with_ids(_table(spark, sf_dir, "part"), "p_partkey")
    return Index.build(corpus, fields=("p_name", "p_type", "p_brand"), exclude=("p_brand",)).postings.drop("dl")


@query(f"""WITH t AS (SELECT p_partkey AS doc_id, unnest({_tok("p_brand")}) AS term FROM part UNION ALL
  SELECT doc_id, {_STEM} FROM (SELECT p_partkey AS doc_id, unnest({_tok("p_name")}) AS w FROM part))
SELECT term, doc_id, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL""")
def field_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = ingest.with_ids(_table(spark, sf_dir, "part"), "p_partkey")
    return Index.build(corpus, fields=("p_name", "p_brand"), field_analyzers={"p_name": Analyzer.make(stem=True)}).postings.drop("dl")


_VARINT = "(1 + " + " + ".join(f"(({{v}}) >= {1 << 7 * n})::INT" for n in range(1, 9)) + ")"


@query(
    _with(
        f"SELECT term, count(*) AS postings, sum({_VARINT.format(v='step')} + {_VARINT.format(v='tf')})::BIGINT AS bytes FROM "
        "(SELECT term, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS step FROM postings) GROUP BY term"
    )
)
def delta_varint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).posting_sizes()


@query(_with("SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY term"))
def optimize_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    doubled = Index(index.corpus, index.config, 1, index.postings.union(index.postings), index.doc_stats)
    return doubled.optimize().vocab


@query(_with("SELECT term, df, cf FROM vocab"))
def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _lazy(spark, sf_dir)
    path = f"{storage.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    storage.save_index(made, path)
    return storage.load_index(spark, path, made.config).vocab


@query(_with("SELECT CASE WHEN (SELECT count(*) FROM vocab) = 0 THEN 'error' WHEN n = 0 THEN 'warning' ELSE 'healthy' END AS status, n AS documents, (SELECT count(*) FROM vocab) AS terms, '' AS issues FROM stats"))
def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).health()


@query(_with("SELECT 'documents' AS id, n AS documents, round(avgdl, 6) AS avgdl FROM stats"))
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).status().withColumn("avgdl", F.round("avgdl", 6))


# changes

_CHANGED = "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY term"


def _over(documents: str, select: str) -> str:
    """SQL over changed documents."""
    return f"WITH changed AS ({documents}), {_P.replace('FROM documents', 'FROM changed')} {select}"


@query(_over("SELECT doc_id, CASE WHEN doc_id = 7 THEN 'thtion replaced thtion' ELSE text END AS text FROM documents", _CHANGED))
def update_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).update(7, spark.createDataFrame([("thtion replaced thtion",)], "text string")).vocab


@query(_over("SELECT doc_id, text FROM documents WHERE doc_id <> 7", _CHANGED))
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).delete(7).vocab


@query(_over("SELECT doc_id, text FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) WHERE k <> 12", _CHANGED))
def ordinal_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).delete_at(12).vocab


@query(_over("SELECT doc_id, CASE WHEN k = 5 THEN 'ertion by place' ELSE text END AS text FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)", _CHANGED))
def ordinal_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).update_at(5, spark.createDataFrame([("ertion by place",)], "text string")).vocab


@query(_over("SELECT doc_id, text || ' upserted' AS text FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, text FROM documents WHERE lang <> 'fr' UNION ALL SELECT -1 - doc_id, text FROM documents WHERE lang = 'fr'", _CHANGED))
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    french = docs.where("lang = 'fr'")
    new = french.withColumn("text", F.concat("text", F.lit(" upserted"))).union(french.withColumn("doc_id", -1 - F.col("doc_id")))
    return index_of(spark, sf_dir).upsert(new).vocab


# streaming


def _log(spark: SparkSession, docs: DataFrame) -> tuple[OperationLog, str]:
    base = f"{storage.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    return OperationLog(spark, f"{base}/operations", docs.schema), base


@query("SELECT doc_id, text, lang FROM documents")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive file by file, all of them twice; the log amounts to the table."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    log, base = _log(spark, docs)
    files = max(2, docs.rdd.getNumPartitions())  # a split of the table each: what a task reads doesn't grow with the table
    for copy in (1, 2):  # in small row groups, so that a file of its own is read by many tasks
        docs.repartition(files).write.option("parquet.block.size", 8 << 20).parquet(f"{base}/source/a={copy}")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/source")
    log.start(stream.select("doc_id", "text", "lang"), f"{base}/checkpoint").awaitTermination()
    return log.snapshot()


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'changed' ELSE text END AS text, lang FROM documents WHERE lang <> 'de'")
def cdc_last_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all, update the French, delete the German documents; the last operation of an id decides."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    log, _ = _log(spark, docs)
    first = docs.select(F.lit(INDEX).alias("op"), F.lit(1).cast("bigint").alias("seq"), "*")
    french = docs.where("lang = 'fr'").select(F.lit(UPDATE).alias("op"), F.lit(2).cast("bigint").alias("seq"), "doc_id", F.lit("changed").alias("text"), "lang")
    german = docs.where("lang = 'de'").select(F.lit(DELETE).alias("op"), F.lit(2).cast("bigint").alias("seq"), "*")
    # the decisive operations come in the first batch, the older ones late
    log.append(french.union(german), 0)
    log.append(first, 1)
    return log.snapshot()


# sources


@query("SELECT doc_id, text, lang FROM documents")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = f"{storage.shared_dir(spark)}/json-{uuid.uuid4().hex}"
    docs.write.json(path)
    return ingest.from_json(spark, path, "doc_id", "doc_id bigint, text string, lang string", lines=True)


@query("SELECT count(*) AS n FROM documents")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{storage.shared_dir(spark)}/json-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    return spark.createDataFrame([(ingest.row_count(spark, path, lines=True),)], "n bigint")


@query("SELECT doc_id, text FROM documents WHERE doc_id BETWEEN 10 AND 150")
def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).key_range(10, 150).select("doc_id", "text")


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id = 42")
def point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).document(42).select("doc_id", "text", "lang")


@query("SELECT doc_id, source FROM documents WHERE lower(source) LIKE '%src1%' ORDER BY doc_id LIMIT 20 OFFSET 20")
def doc_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return features.listing(docs, 2, 20, filters.ui_filter(docs.schema, "source", "contains", "SRC1")).select("doc_id", "source")


@query("SELECT doc_id, text FROM documents")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).corpus.select("doc_id", "text")


# queries


def _ids(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.ids(index_of(spark, sf_dir))


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


_PHRASE = "eriner thanea"
_LIKE = f"contains(translate(text, {_AZ}), '{_PHRASE}')"

_register("term_exact", _ids(Term("Thtion")), _with(_has("thtion")))
_register("term_fuzzy_k1", _ids(Term("thtoin", True, 1)), _with(_near("thtoin", 1)))
_register("term_fuzzy_k2", _ids(Term("anedion", True, 2)), _with(_near("anedion", 2)))
_register("fuzzy_index", _ids(Fuzzy("erton", 1)), _with(_near("erton", 1)))
_register("phrase_exact", _ids(Phrase("Eriner Thanea")), _with(f"SELECT doc_id FROM documents WHERE {_LIKE} AND doc_id IN ({_has(*_PHRASE.split())})"))
_register("phrase_fuzzy", _ids(Phrase("thtoin erton", True, 1)), _with(_all_near(["thtoin", "erton"], 1)))
_register("bool_and", _ids(Bool((Term("thtion"), Term("ertion"), Term("thanea")))), _with(_has("thtion", "ertion", "thanea")))
_register("bool_or", _ids(Bool((Term("thtion"), Term("ertion")), "or")), _with("SELECT DISTINCT doc_id FROM postings WHERE term IN ('thtion', 'ertion')"))
_register("bool_not", _ids(Not(Term("thtion"))), _with(f"SELECT doc_id FROM documents WHERE doc_id NOT IN ({_has('thtion')})"))
_register("bool_mixed", _ids(Bool((Term("thtion"), Not(Term("ertion")), Field("lang", "en"), Range("n_chars", 100, 5000)))), _with(f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 5000 AND doc_id IN ({_has('thtion')}) AND doc_id NOT IN ({_has('ertion')})"))
_register("wildcard_terms", _ids(Wildcard("tht*n")), _with(r"SELECT DISTINCT doc_id FROM postings WHERE regexp_full_match(term, 'tht.*n')"))
_register("fuzzy_field", _ids(Fuzzy("thtoin", 2, "text")), f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_tok('text')}) AS t FROM documents) WHERE levenshtein(t, 'thtoin') <= 2")
_register("field_eq", _ids(Field("lang", "fr")), "SELECT doc_id FROM documents WHERE lang = 'fr'")
_register("range_numeric", _ids(Range("n_chars", 500, 1500)), "SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 1500")
_register("sql_predicate", _ids(Sql("n_chars > 1000 AND lang IN ('en', 'de')", Term("thtion"))), _with(f"SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang IN ('en', 'de') AND doc_id IN ({_has('thtion')})"))
_register("filter_plus_term", _ids(Filter((Condition("lang", "eq", "en"), Condition("n_chars", "lt", 2000)), inner=Term("ertion"))), _with(f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars < 2000 AND doc_id IN ({_has('ertion')})"))
_register("parse_quoted", _ids(Parser().parse('"eriner thanea" ertion')), _with(f"SELECT doc_id FROM documents WHERE {_LIKE} AND doc_id IN ({_has(*_PHRASE.split())}) AND doc_id IN ({_near('ertion', 1)})"))
_register("parse_boolean", _ids(Parser().parse("thtion AND NOT ertion")), _with(f"{_near('thtion', 1)} EXCEPT {_near('ertion', 1)}"))
_register("parse_or", _ids(Parser().parse("thtion OR lang:fr")), _with(f"{_near('thtion', 1)} UNION SELECT doc_id FROM documents WHERE lang = 'fr'"))
_register("parse_field", _ids(Parser().parse("source:src3")), "SELECT doc_id FROM documents WHERE source = 'src3'")
_register("parse_plain", _ids(Parser().parse("thtion ertion")), _with(_all_near(["thtion", "ertion"], 1)))
_register("builder_combo", _ids(Builder().term("thtion").range("n_chars", 0, 3000).field("lang", "en").build()), _with(f"SELECT doc_id FROM documents WHERE n_chars BETWEEN 0 AND 3000 AND lang = 'en' AND doc_id IN ({_near('thtion', 1)})"))
_register("token_union", lambda spark, sf_dir: token_union(index_of(spark, sf_dir), ["thtion", "ertion", "thtion"]), _with("SELECT doc_id FROM postings WHERE term IN ('thtion', 'ertion') UNION ALL SELECT doc_id FROM postings WHERE term = 'thtion'"))
_register("request_search", lambda spark, sf_dir: Request("thtoin", (Condition("lang", "eq", "en"),), fuzzy_threshold=1).plan().ids(index_of(spark, sf_dir)), _with(f"SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IN ({_near('thtoin', 1)})"))


@query(_with(f"SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND doc_id IN ({_near('thtoin', 1)}) ORDER BY n_chars DESC, doc_id LIMIT 5 OFFSET 5"))
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a whole request: fuzzy query, condition, sort, fetched records."""
    engine = Engine(spark, {"documents": index_of(spark, sf_dir)})
    request = Request("thtoin", (Condition("lang", "eq", "en"),), fuzzy_threshold=1, sort_field="n_chars", sort_order="desc", page=2, size=5)
    return engine.search("documents", request).items.select("doc_id", "lang", "n_chars")


def _on(table: str, key: str, q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.ids(_keyed(spark, sf_dir, table, key))


_register("wildcard_star", _on("part", "p_partkey", Wildcard("s*ring", "p_name")), "SELECT p_partkey AS doc_id FROM part WHERE regexp_full_match(p_name, 's.*ring')")
_register("wildcard_prefix", _on("part", "p_partkey", Wildcard("small*", "p_name")), "SELECT p_partkey AS doc_id FROM part WHERE p_name LIKE 'small%'")
_register("wildcard_qmark", _on("customer", "c_custkey", Wildcard("Customer#0000000?5", "c_name")), "SELECT c_custkey AS doc_id FROM customer WHERE regexp_full_match(c_name, 'Customer#0000000.5')")
_register("field_eq_number", _on("part", "p_partkey", Field("p_size", "15")), "SELECT p_partkey AS doc_id FROM part WHERE p_size = 15")
QUERIES["range_numeric_string"] = lambda spark, sf_dir: Range("k", 10, 50).ids(
    Index.build(_table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.get_json_object("props", "$.k").alias("k")))
)
ORACLE_SQL["range_numeric_string"] = "SELECT event_id AS doc_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS double) BETWEEN 10 AND 50"
_register("phrase_record", _on("part", "p_partkey", Phrase("red plate")), "SELECT p_partkey AS doc_id FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_name, cast(p_partkey AS varchar), cast(p_size AS varchar), p_type)), 'red plate')")

_FILTERS: dict[str, tuple[str, str, str, object, str]] = {
    "eq": ("part", "p_partkey", "p_brand", "Brand#4", "p_brand = 'Brand#4'"),
    "ne": ("orders", "o_orderkey", "o_orderstatus", "F", "o_orderstatus <> 'F'"),
    "in": ("part", "p_partkey", "p_size", [1, 2, 3], "p_size IN (1, 2, 3)"),
    "nin": ("part", "p_partkey", "p_type", ["PROMO", "LARGE"], "p_type NOT IN ('PROMO', 'LARGE')"),
    "contains": ("part", "p_partkey", "p_name", "ring", "contains(p_name, 'ring')"),
    "ncontains": ("part", "p_partkey", "p_name", "ring", "NOT contains(p_name, 'ring')"),
    "gt": ("orders", "o_orderkey", "o_totalprice", 250000.0, "o_totalprice > 250000"),
    "gte": ("part", "p_partkey", "p_size", 40, "p_size >= 40"),
    "lt": ("orders", "o_orderkey", "o_totalprice", 50000.0, "o_totalprice < 50000"),
    "lte": ("part", "p_partkey", "p_size", 10, "p_size <= 10"),
}
for _name, (_t, _k, _f, _v, _sql) in _FILTERS.items():
    _register(f"filter_{_name}", _on(_t, _k, Filter((Condition(_f, _name, _v),))), f"SELECT {_k} AS doc_id FROM {_t} WHERE {_sql}")
_BOTH = (Condition("p_size", "gt", 25), Condition("p_brand", "eq", "Brand#4"))
_register("filter_all", _on("part", "p_partkey", Filter(_BOTH)), "SELECT p_partkey AS doc_id FROM part WHERE p_size > 25 AND p_brand = 'Brand#4'")
_register("filter_any", _on("part", "p_partkey", Filter(_BOTH, "or")), "SELECT p_partkey AS doc_id FROM part WHERE p_size > 25 OR p_brand = 'Brand#4'")
_register("filter_reverse", _on("part", "p_partkey", Filter(_BOTH, "or", reverse=True)), "SELECT p_partkey AS doc_id FROM part WHERE NOT (p_size > 25 OR p_brand = 'Brand#4')")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    engine = Engine(spark, {"orders": _keyed(spark, sf_dir, "orders", "o_orderkey")})
    return engine.hits("orders", Request(conditions=(Condition("o_custkey", "in", keys=keys),))).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def ui_filter_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.where(filters.ui_filter(part.schema, "all", "contains", "RED")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE suffix(lower(c_name), '7') AND lower(c_mktsegment) <> 'building'")
def ui_filter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    both = filters.ui_filter(customer.schema, "c_name", "ends_with", "7") & filters.ui_filter(customer.schema, "c_mktsegment", "not_equals", "Building")
    return customer.where(both).select("c_custkey")


@query(
    _with(
        "SELECT token, coalesce(c, token) AS corrected FROM asked LEFT JOIN best USING (token)",
        f"""
asked AS (SELECT DISTINCT unnest({_tok("text")}) AS token FROM benchmark),
best AS (
  SELECT token, min_by(term, (d, term)) AS c FROM (
    SELECT token, term, levenshtein(token, term) AS d FROM asked, vocab
    WHERE token NOT IN (SELECT term FROM vocab) AND abs(length(token) - length(term)) <= 2)
  WHERE d <= 2 GROUP BY token)""",
    )
)
def autocorrect(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "benchmark").select(F.explode(text.tokenize("text")).alias("token"))
    return features.autocorrect(index_of(spark, sf_dir), asked)


# ranking

_SCORED = "SELECT doc_id, round(score, 6) AS score FROM scored"
_TEN = "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM scored) QUALIFY rank <= 10"


@query(_with(_SCORED, _weights({"thtion": 1})))
def bm25_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(rank.search(index_of(spark, sf_dir), Term("thtion")))


@query(_with(_TEN, _weights({"thtion": 1, "ertion": 1})))
def bm25_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for two words, either of which may occur."""
    return _top(rank.search(index_of(spark, sf_dir), Bool((Term("thtion"), Term("ertion")), "or")))


@query(_with(_SCORED, _weights({"thtion": 2, "ertion": 1})))
def bm25_repeated_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(rank.bm25(index_of(spark, sf_dir), ["thtion", "ertion", "thtion"]))


@query(_with(f"SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM ({_near('thtoin', 1)}) LEFT JOIN scored USING (doc_id)", _weights({"thtoin": 1})))
def bm25_fuzzy_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a misspelt word score 0: the typed term alone is ranked by."""
    return _scored(rank.search(index_of(spark, sf_dir), Term("thtoin", True, 1)))


@query(_with("SELECT doc_id, tf::DOUBLE AS score FROM postings WHERE term = 'thtion'"))
def tf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.conjunctive(index_of(spark, sf_dir), "thtion")


@query(_with(f"SELECT doc_id, 1.0::DOUBLE AS score FROM ({_has('thtion', 'ertion')})"))
def conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.conjunctive(index_of(spark, sf_dir), "thtion ertion")


def _sorted(spark: SparkSession, sf_dir: str, descending: bool) -> DataFrame:
    index = index_of(spark, sf_dir)
    found = rank.fetch(index, _scored(rank.search(index, Term("thtion"))))
    return rank.ranked(found, rank.ordering(index, "n_chars", descending), 25).select("doc_id", "n_chars", "score", "rank")


def _sort_sql(order: str) -> str:
    return _with(f"SELECT doc_id, n_chars, round(score, 6) AS score, row_number() OVER (ORDER BY n_chars {order} NULLS LAST, round(score, 6) DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) QUALIFY rank <= 25", _weights({"thtion": 1}))


@query(_sort_sql("ASC"))
def sort_field_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir, False)


@query(_sort_sql("DESC"))
def sort_field_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, sf_dir, True)


def _page(number: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = _scored(rank.search(index_of(spark, sf_dir), Term("thtion")))
        page = rank.paginate(hits, [F.desc("score"), F.asc("doc_id")], number, 10)
        return page.results.withColumns({"page": F.lit(page.page).cast("bigint"), "pages": F.lit(page.total_pages).cast("bigint"), "total": F.lit(page.total).cast("bigint")})

    return run


def _page_sql(number: str) -> str:
    ranked = "SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r, count(*) OVER () AS total FROM scored"
    return _with(f"SELECT doc_id, score, {number}::BIGINT AS page, ((total + 9) // 10)::BIGINT AS pages, total FROM ({ranked}) WHERE (r - 1) // 10 + 1 = {number}", _weights({"thtion": 1}))


_register("page_1", _page(1), _page_sql("1"))
_register("page_2", _page(2), _page_sql("2"))
_register("page_clamped", _page(1_000_000), _page_sql("((total + 9) // 10)"))


@query(_with("SELECT doc_id, text, lang, rank FROM documents JOIN (" + _TEN + ") USING (doc_id)", _weights({"thtion": 1, "ertion": 1})))
def fetch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fetch(index_of(spark, sf_dir), bm25_multi(spark, sf_dir)).select("doc_id", "text", "lang", "rank")


@query(_with(f"SELECT doc_id, regexp_replace(text, '(thtion|ertion)', '<mark>\\1</mark>', 'gi') AS marked FROM documents WHERE doc_id IN ({_has('thtion', 'ertion')})"))
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    records = rank.fetch(index, rank.conjunctive(index, "thtion ertion")).select("doc_id", "text")
    return features.highlight(records, ["thtion", "ertion"]).select("doc_id", F.col("highlights")["text"].alias("marked"))


@query(_with("SELECT term, cf FROM vocab WHERE prefix(term, 'tht') ORDER BY cf DESC, term LIMIT 10"))
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.suggest(index_of(spark, sf_dir), "THT", 10)


@query("SELECT event_type AS query, count(*) AS times FROM events GROUP BY event_type ORDER BY times DESC, query LIMIT 3")
def popular_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.popular_queries(_table(spark, sf_dir, "events").select(F.col("event_type").alias("query")), 3)


@query("SELECT count(value) AS queries, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS avg_ms FROM events")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latency_stats(_table(spark, sf_dir, "events"), "value").withColumn("avg_ms", F.round("avg_ms", 6))


@query("SELECT round(avg(value), 6) AS avg_ms, count(*) AS queries FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000)")
def last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = features.last_entries(_table(spark, sf_dir, "events"), "event_id", 1000)
    return features.latency_stats(recent, "value").select(F.round("avg_ms", 6).alias("avg_ms"), "queries")


@query("SELECT count(*) AS total, sum((event_type = 'view')::INT)::BIGINT AS hits, round(sum((event_type = 'view')::INT) / count(*), 6) AS rate FROM events")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hit_rate(_table(spark, sf_dir, "events"), F.col("event_type") == "view").withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda m, x: (m + x) / 2), 6) AS mean FROM events GROUP BY user_id")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.running_mean(_table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("mean", F.round("mean", 6))


@query(
    _with(
        "SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
        f"""
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_tok("text")}) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
scored AS (
  SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM postings JOIN asked USING (term) JOIN vocab USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY ALL)""",
    )
)
def batch_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item, in one job."""
    asked = rank.batch_terms(_table(spark, sf_dir, "benchmark"), "item_id", "text", DEFAULT.tokens)
    return rank.batch_topk(index_of(spark, sf_dir), asked).withColumn("score", F.round("score", 6))


@query(_with(_TEN, _weights({"thtion": 1, "ertion": 1})))
def shard_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard's best ten, merged; scores use the statistics of the whole."""
    hits = _scored(rank.search(index_of(spark, sf_dir), Bool((Term("thtion"), Term("ertion")), "or")))
    return rank.merge_shards([hits.where(F.pmod("doc_id", F.lit(4)) == i) for i in range(4)], 10)


@query("SELECT n, cast(floor(-1.44 * n * log2(p)) AS BIGINT) AS bits, greatest(1, cast(round(0.693 * floor(-1.44 * n * log2(p)) / n) AS BIGINT)) AS hashes FROM (VALUES (1000::BIGINT, 0.01::DOUBLE), (100, 0.5), (50000, 0.001)) AS t(n, p)")
def bloom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, *features.bloom_size(n, p)) for n, p in ((1000, 0.01), (100, 0.5), (50000, 0.001))]
    return spark.createDataFrame(rows, "n bigint, bits bigint, hashes bigint")


@query(_with("SELECT count(*) AS terms, 0::BIGINT AS missed FROM vocab"))
def bloom_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = index_of(spark, sf_dir).vocab.select("term")
    bits, hashes = features.bloom_size(100_000, 0.01)
    made = features.bloom_build(vocab, "term", bits, hashes)
    found = features.bloom_contains(made, vocab, "term", bits, hashes)
    return found.agg(F.count("*").alias("terms"), F.sum(F.when(F.col("maybe"), 0).otherwise(1)).cast("bigint").alias("missed"))


# set operations, as the engine's own joins use them


@query(_with(f"({_has('thtion')} UNION {_has('ertion')}) EXCEPT (SELECT doc_id FROM documents WHERE lang = 'en')"))
def union_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    both = Bool((Term("thtion"), Term("ertion")), "or").ids(index)
    return both.join(Field("lang", "en").ids(index), "doc_id", "left_anti")


@query("SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3")
def per_group_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("doc_id"), F.col("p_retailprice").alias("score"))
    best = features.per_query_top(part, "p_brand", 3)
    return best.withColumnsRenamed({"doc_id": "p_partkey", "score": "p_retailprice"})
