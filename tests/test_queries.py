"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from terrachron.plans.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return [columns[k] for k in order], sorted(tuple(show(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(SQL[name])
    assert got == rows([c[0] for c in found.description], found.fetchall())


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_user_metadata_of_every_changeset(spark):
    from terrachron.osm import add_user_metadata

    found = {r.changeset % 2 for r in QUERIES["user_metadata"](spark, SF).select("changeset").distinct().collect()}
    assert found == {0, 1}
    geoms = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "changeset long, id long")
    sets = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (9, 9, "c")], "id long, uid long, user string")
    assert sorted(map(tuple, add_user_metadata(geoms, sets).select("id", "uid", "user").collect())) == [(10, 7, "a"), (11, 8, "b")]


def test_tags_reduce_of_every_event(spark, db):
    got = QUERIES["tags_reduce"](spark, SF)
    assert got.count() == db.execute("SELECT count(DISTINCT user_id) FROM events").fetchone()[0]
    assert got.where("tags LIKE '%0;1;2%'").count() > 0
