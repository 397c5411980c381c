"""Every query that has SQL gives the rows of its SQL on the same tables."""

import math

import duckdb
import pytest

from reelbase.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", float(f"{v:.10g}"))
    return v if v is None or isinstance(v, (bool, int, str)) else ("f", float(v))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    kinds = {x[0]: str(x[1]) for x in found.description}
    assert cols == sorted(names)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == {c: k if not k.startswith("DECIMAL") else "DOUBLE" for c, k in kinds.items()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
