"""Every query with an SQL twin against DuckDB on the smallest tables; the others must run."""

import math
import os

import duckdb
import pytest

from tidemark.queries import QUERIES, SQL

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in SQL:
        assert columns
        return
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()])
    assert got == want


def test_every_part_is_explained(spark):
    n = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert QUERIES["m23_factor_shapley"](spark, DATA).groupBy("p_partkey").count().filter("count = 3").count() == n
    assert {r["n"] for r in QUERIES["m26_two_backgrounds"](spark, DATA).collect()} == {n}
    assert sum(r["n"] for r in QUERIES["w08_top_factor"](spark, DATA).collect()) == n
