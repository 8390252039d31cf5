"""Every registered query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from paperloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted(str(tuple(value(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_as_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    wanted = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _rows(got.columns, got.collect()) == _rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", ["similar_ratio", "rouge_l", "train_split", "summarize_documents"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
