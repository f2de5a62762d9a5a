import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quern.session import local_session

DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "6g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Compare a query with its SQL on the smallest tables, whatever the order of rows."""
    con = duckdb.connect()
    for name in sorted(os.listdir(small)):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{small}/{name}'")

    def check(query, sql):
        df = query(spark, small)
        columns = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        expected = con.sql(sql)
        at = list(expected.columns)
        assert sorted(at) == columns
        assert got == sorted(tuple(_plain(r[at.index(c)]) for c in columns) for r in expected.fetchall())

    return check
