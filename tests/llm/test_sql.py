"""The operators' queries against their SQL, on the smallest tables and on texts made for it."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tests.llm.test_text import APACHE, BSD3, EACH, GPL, MIT_FULL
from textmill.llm import license_scan, registry

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


def test_licenses_against_sql(documents):
    """All expressions alone and side by side, in one sentence and in several."""
    texts = [t for _, t in EACH] + [APACHE, BSD3, MIT_FULL, GPL.format(v=3), GPL.format(v=2), None, ""]
    texts += [f"{a} {b}" for (_, a), (_, b) in zip(EACH, EACH[1:])] + [f"{a}. {b} and {a}" for (_, a), (_, b) in zip(EACH, EACH[7:])]
    texts += ["GPL, lgpl version 3 or any later", "creative commons attribution creative commons attribution-sharealike", "copyright c copyright 2020 copyright"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, MIT_FULL)]
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    got = license_scan.scan(documents(rows))
    want = duck.execute(license_scan.oracle_sql())
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in want.description], want.fetchall())
