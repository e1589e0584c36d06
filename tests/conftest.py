import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import get_session

    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('checkpoint')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def rows_of(duck, sql):
    """Column names in order, and the rows, sorted, as text."""
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(names)
    return order, sorted(tuple(str(r[names.index(c)]) for c in order) for r in got.fetchall())


def rows_of_spark(df):
    order = sorted(df.columns)
    return order, sorted(tuple(str(r[c]) for c in order) for r in df.collect())
