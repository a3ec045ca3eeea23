"""Every query with an SQL twin gives the twin's rows on the small tables."""

import math
import os

import duckdb
import pytest

from fluvial.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(names)
    return sorted((tuple(str(plain(r[names.index(c)])) for c in order) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    number = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
    assert rows_of(df.columns, number(map(tuple, df.collect()))) == rows_of(columns, number(result.fetchall()))


@pytest.mark.parametrize("name", ["j13_difference", "j14_clip", "m12_relax", "r16_snap_points", "r11_dry_run"])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
