"""Every registered query that SQL expresses gives DuckDB's rows; the training-data operators have tests of their own."""

import math

import duckdb
import pytest

from corpuslane import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal",):
        return round(float(v), 6)
    return str(v).removesuffix(" 00:00:00")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(str([cell(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLE_SQL:
        found = oracle.execute(catalog.ORACLE_SQL[name])
        assert got == rows([d[0] for d in found.description], found.fetchall())
