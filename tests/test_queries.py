"""Every query against its SQL, rows and types, on the smallest tables."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "int32", "bigint": "int64", "string": "string", "double": "double", "date": "date32[day]", "boolean": "bool"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


def _entry():
    import __spark_entry__

    return __spark_entry__


def _names(with_sql: bool):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    e = _entry()
    return [n for n in e.queries() if (n in e.oracle_sql()) == with_sql and n in e.plans.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.map(lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", _names(True))
def test_query_is_its_sql(spark, duck, name):
    e = _entry()
    df = e.queries()[name](spark, str(DATA))
    con = duck.execute(e.oracle_sql()[name])
    want = con.to_arrow_table()
    assert {c: TYPES[t] for c, t in df.dtypes} == {f.name: str(f.type) for f in want.schema}
    pd.testing.assert_frame_equal(_plain(df.toPandas()), _plain(want.to_pandas()))


@pytest.mark.parametrize("name", _names(False))
def test_query_without_sql_runs(spark, name):
    assert _entry().queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert _entry().entry(spark).count() > 0


def test_rest_works_without_the_training_data_part():
    """Nothing outside it imports it."""
    root = Path(__file__).resolve().parents[1]
    for f in (root / "millrace").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
    assert importlib.util.find_spec("millrace.plans.queries")
