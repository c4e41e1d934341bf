"""From records in any form to a corpus: a DataFrame with a ``doc_id BIGINT`` and the records' fields."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textmill.operators.index import unique

#: Turns one input record into a mapping, or gives None to pass it on.
Adapter = Callable[[Any], dict | None]
_adapters: list[Adapter] = []


def register_adapter(adapter: Adapter) -> None:
    """Adapters are asked in the order of registration, after the built-in ones."""
    _adapters.append(adapter)


def adapt(record: Any, default_field: str = "content") -> dict:
    """One record as a mapping: mappings, dataclasses, rows, texts, then registered adapters."""
    if isinstance(record, dict):
        return {str(k): v for k, v in record.items()}
    if isinstance(record, Row):
        return record.asDict(recursive=True)
    if is_dataclass(record) and not isinstance(record, type):
        return asdict(record)
    if isinstance(record, bytes):
        return {default_field: record.decode("utf-8", "replace")}
    if isinstance(record, str):
        return {default_field: record}
    for adapter in _adapters:
        found = adapter(record)
        if found is not None:
            return found
    raise TypeError(f"no adapter for a record of type {type(record).__name__}")


def with_ids(df: DataFrame, id_col: str | None = None, id_expr: Column | None = None) -> DataFrame:
    """Add ``doc_id``: from ``id_col`` where it parses as an integer, else ``id_expr``, else a stable hash.

    The hash is of the whole record, so it is the same however often and wherever it is computed.
    """
    generated = id_expr if id_expr is not None else F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    if id_col is None:
        return df if "doc_id" in df.columns and id_expr is None else df.withColumn("doc_id", generated.cast("bigint"))
    return df.withColumn("doc_id", F.coalesce(F.col(f"`{id_col}`").try_cast("bigint"), generated.cast("bigint")))


def from_records(spark: SparkSession, records: Iterable[Any], id_col: str | None = None, default_field: str = "content", schema: Any = None) -> DataFrame:
    """Records in the driver's memory; keys may differ from record to record."""
    rows = [adapt(r, default_field) for r in records]
    if not rows:
        return with_ids(spark.createDataFrame([], schema or f"{default_field} string"), id_col)
    if schema is not None:
        return with_ids(spark.createDataFrame(rows, schema), id_col)
    lines = [json.dumps(r, default=str, ensure_ascii=False) for r in rows]
    found = spark.createDataFrame([(x,) for x in lines], "line string")
    fields = spark.range(1).select(F.schema_of_json(F.lit(_widest(rows)))).first()[0]
    return with_ids(found.select(F.from_json("line", fields).alias("r")).select("r.*"), id_col)


def _widest(rows: list[dict]) -> str:
    """One JSON record with every key that any record has."""
    seen: dict[str, Any] = {}
    for row in rows:
        for k, v in row.items():
            if v is not None and (k not in seen or isinstance(seen[k], int) and isinstance(v, float)):
                seen[k] = v
    return json.dumps(seen, default=str, ensure_ascii=False)


def from_json(spark: SparkSession, path: str, id_col: str | None = None, schema: Any = None, lines: bool = False) -> DataFrame:
    """Files with a JSON array each, or (``lines``) an object in each line; records that don't parse are dropped.

    An array is read by one task for each file; lines are split like any text, so large data should have them.
    """
    reader = spark.read.option("multiLine", not lines).option("mode", "DROPMALFORMED")
    return with_ids((reader.schema(schema) if schema is not None else reader).json(path), id_col)


def from_json_text(spark: SparkSession, text: str, id_col: str | None = None) -> DataFrame:
    """An inline JSON array, or one object; elements that aren't objects are dropped."""
    found = json.loads(text)
    return from_records(spark, [r for r in (found if isinstance(found, list) else [found]) if isinstance(r, dict)], id_col)


def from_parquet(spark: SparkSession, path: str, id_col: str | None = None) -> DataFrame:
    return with_ids(spark.read.parquet(path), id_col)


def from_jdbc(spark: SparkSession, url: str, query: str, id_col: str | None = None, partition_column: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """The result of a database's query; the database's driver must be on Spark's class path.

    With ``partition_column`` (a number, date or timestamp) the result is read over ``partitions``
    connections, by ranges between the column's least and greatest value, which are asked for first.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return with_ids(reader.option("query", query).load(), id_col)
    least, most = reader.option("query", f"SELECT MIN({partition_column}) AS a, MAX({partition_column}) AS b FROM ({query}) q").load().first()
    reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", f"({query}) q")
    if least is not None:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", str(least)).option("upperBound", str(most)).option("numPartitions", partitions)
    return with_ids(reader.load(), id_col)


def row_count(spark: SparkSession, path: str, lines: bool = False) -> int:
    """Records of files with a JSON array each, or (``lines``) an object in each line."""
    return spark.read.option("multiLine", not lines).json(path).count()


def replaced(corpus: DataFrame) -> DataFrame:
    """A corpus without repeated ids: the least record of each stays. Only records of repeated ids are moved."""
    repeated = corpus.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return corpus
    return corpus.join(repeated, "doc_id", "left_anti").select(*corpus.columns).unionByName(unique(corpus.join(repeated, "doc_id", "left_semi").select(*corpus.columns)))


def as_corpus(spark: SparkSession, source: Any, id_col: str | None = None) -> DataFrame:
    """Dispatch on the source: DataFrame, JSON text, path, mapping with ``path``, ``data`` or ``database``, records."""
    if isinstance(source, DataFrame):
        return with_ids(source, id_col)
    if isinstance(source, bytes):
        source = source.decode()
    if isinstance(source, str):
        if source.lstrip()[:1] in ("[", "{"):
            return from_json_text(spark, source, id_col)
        return from_parquet(spark, source, id_col) if source.rstrip("/").endswith(".parquet") else from_json(spark, source, id_col)
    if isinstance(source, dict):
        if "database" in source:
            return from_jdbc(spark, id_col=id_col, **source["database"])
        if "path" in source:
            return as_corpus(spark, source["path"], id_col)
        return from_records(spark, source["data"], id_col)
    if hasattr(source, "to_dict") and hasattr(source, "columns"):  # a pandas frame
        return with_ids(spark.createDataFrame(source), id_col)
    return from_records(spark, source, id_col)
