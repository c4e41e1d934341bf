"""Micro-batch ingestion: an append-only log of operations, and the snapshot that it amounts to.

Every batch is a folder of its own, written anew if the batch is repeated, so delivery is exactly once.
A batch costs its own size and never a rewrite of the corpus; ``compact`` folds the log when it suits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

INDEX, UPDATE, DELETE = "index", "update", "delete"


class OperationLog:
    """Operations (op, doc_id, seq, record columns) under ``path``; of an id the one of the largest seq decides.

    Where seqs are equal (or missing, which is 0) the later batch decides.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.spark, self.path = spark, path
        self.record = spark.createDataFrame([], schema).schema
        parts = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.record.fields if f.name != "doc_id")
        self.schema = f"op string, seq bigint, doc_id bigint{', ' + parts if parts else ''}, batch bigint"

    def append(self, operations: DataFrame, batch: int) -> None:
        """Write one batch; missing ``op`` means index, missing ``seq`` the order of nothing (ties go by content)."""
        if "op" not in operations.columns:
            operations = operations.withColumn("op", F.lit(INDEX))
        if "seq" not in operations.columns:
            operations = operations.withColumn("seq", F.lit(0).cast("bigint"))
        names = ["op", "seq", "doc_id", *[f.name for f in self.record.fields if f.name != "doc_id"]]
        operations.select(*names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def operations(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)

    def snapshot(self) -> DataFrame:
        """The corpus: the last operation of each id, if it isn't a delete."""
        rest = [f.name for f in self.record.fields if f.name != "doc_id"]
        last = Window.partitionBy("doc_id").orderBy(F.desc("seq"), F.desc("batch"), F.desc("op"), *[F.desc(c) for c in rest])
        ranked = self.operations().withColumn("place", F.row_number().over(last))
        return ranked.where((F.col("place") == 1) & (F.col("op") != DELETE)).select(*[f.name for f in self.record.fields])

    def compact(self, path: str) -> OperationLog:
        """The same corpus as a log of one batch, in another folder."""
        made = OperationLog(self.spark, path, self.record)
        made.append(self.snapshot(), 0)
        return made

    def _base(self, checkpoint: str) -> int:
        """The number of a checkpoint's first batch: set when it is first used, and kept beside the log."""
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(hadoop)
        name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:24]
        known = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bases")
        if files.exists(known):
            for status in files.listStatus(known):
                own, _, base = status.getPath().getName().partition("-")
                if own == name:
                    return int(base)
        numbers = [status.getPath().getName() for status in files.listStatus(root)] if files.exists(root) else []
        base = 1 + max((int(n.removeprefix("batch=")) for n in numbers if n.startswith("batch=")), default=-1)
        files.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bases/{name}-{base}"), True).close()
        return base

    def start(self, stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
        """Append each micro-batch of a stream; ``then`` is called after it with the batch and its number.

        A stream with a new checkpoint goes on behind the batches that are there; with the same one it
        writes a repeated batch in its old place.
        """
        base = self._base(checkpoint)

        def write(batch: DataFrame, number: int) -> None:
            self.append(batch, base + number)
            if then is not None:
                then(batch, number)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
