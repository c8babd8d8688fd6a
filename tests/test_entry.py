import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(k for k in entry.oracle_sql() if k.split("_")[0] not in {f"p{n}" for n in (1, 2, 3, 4, 5, 7, 8, 9)})


def norm(v):
    if isinstance(v, float):
        return f"{v:.5g}"
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, list) else str(v)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, small, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    r = duck(small).execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
