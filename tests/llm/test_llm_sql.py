import duckdb
import pytest
from conftest import DATA

from spanloom.llm import queries

TABLES = ("documents", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    sf = f"{DATA}/sf0.001"
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = c.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})")
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(rel.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_returns_a_row_per_query_row(spark, name):
    got = queries.queries()[name](spark, f"{DATA}/sf0.001")
    key = got.columns[0]
    n = got.select(key).distinct().count()
    assert n == (10 if name.startswith("op10_") else 200)
