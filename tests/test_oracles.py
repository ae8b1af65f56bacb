"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cotejo.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(v[k]) for k in order) for v in values)


#: A trained model has no SQL.
NO_SQL = {"learned_style"}


def test_every_query_has_sql():
    assert set(registry.QUERIES) - NO_SQL == set(registry.ORACLES)


def test_learned_style(spark, duck):
    scores = {r.doc_id: r.probabilidad for r in registry.QUERIES["learned_style"](spark, SF).collect()}
    truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    right = sum((scores[k] >= 0.5) == (y == 1) for k, y in truth.items())
    assert len(scores) == duck.execute("SELECT count(*) FROM documents").fetchone()[0] and right > 0.8 * len(truth)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, cursor.fetchall())
