"""Registered queries of the network analytics against their SQL, on the smallest tables.

Each run takes a third of them, in turn by the day; TRANSLOOM_QUERIES=all takes all.
"""

import datetime
import os

import duckdb
import pytest

import transloom.plans.queries  # noqa: F401
from transloom.plans import pipelines, registry

FOLDER = "/root/testdata/sf0.001"
#: A third of the queries, another one every day; TRANSLOOM_QUERIES=all runs every one.
TURN = datetime.date.today().toordinal() % 3
NAMES = sorted(registry.ORACLES)
if os.environ.get("TRANSLOOM_QUERIES") != "all":
    NAMES = NAMES[TURN::3]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def text(rows, columns):
    cell = lambda x: "null" if x is None or x != x else f"{round(x, 5) + 0.0:.5f}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name, monkeypatch):
    # an hour of these tables has fewer trips than a snapshot needs; ask for one on both sides
    monkeypatch.setattr(pipelines, "MIN_ROWS", 1)
    df = registry.QUERIES[name](spark, FOLDER)
    relation = tables.sql(registry.ORACLES[name].replace("HAVING count(*) >= 10", "HAVING count(*) >= 1"))
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    assert text([r.asDict() for r in df.collect()], columns) == text([dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()], columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
