import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (str(ROOT), os.environ.get("PYTHONPATH", ""))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexloom.session import local_session

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    # Small tables: one job a query instead of one a stage.
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from lexloom.session import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{SF}/{name}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame and a statement give the same names and rows."""

    def check(df, sql):
        columns = sorted(df.columns)
        got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        assert got == want

    return check
