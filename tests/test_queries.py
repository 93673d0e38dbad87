import os

import duckdb
import pytest
from conftest import DATA

from spanloom.plans.oracles import ORACLES
from spanloom.plans.queries import QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    assert got and got == plain(duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150 and set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_the_rest_does_not_need_the_training_data_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in n) and n and not any(m.startswith('spanloom.llm.') for m in sys.modules if m != 'spanloom.llm')"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
