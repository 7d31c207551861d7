"""Histories: hand-made cases of deletions, validity, missing members; tags and helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrachron.functions import maps, tags
from terrachron.geometry.udfs import st_astext, st_area, st_contains, st_envelope, st_geomfromtext
from terrachron.operators import history
from terrachron.osm import snapshot, to_geometry
from terrachron.schema import ELEMENT_DDL


def at(day):
    return dt.datetime(2020, 1, day)


def row(kind, id_, version, day, changeset, tags_=None, lat=None, lon=None, nds=None, members=None, visible=True):
    from decimal import Decimal

    d = lambda x: None if x is None else Decimal(str(x))
    return (id_, kind, tags_ or {}, d(lat), d(lon), None if nds is None else [(n,) for n in nds], members, changeset, at(day), 1, "u", version, visible)


@pytest.fixture(scope="module")
def elements(spark):
    rows = [
        row("node", 1, 1, 1, 10, {"amenity": "cafe"}, 0, 0), row("node", 1, 2, 5, 11, {"amenity": "cafe"}, 0, 1),
        row("node", 1, 3, 9, 12, {}, visible=False), row("node", 2, 1, 1, 10, {}, 0, 10), row("node", 3, 1, 1, 10, {}, 10, 10),
        row("node", 4, 1, 1, 10, {}, 10, 0),
        row("way", 1, 1, 2, 10, {"building": "yes"}, nds=[4, 2, 3, 4]), row("way", 2, 1, 2, 10, {"highway": "path"}, nds=[1, 2, 99]),
        row("way", 3, 1, 6, 14, {}, nds=[4, 3]),
        row("relation", 1, 1, 3, 10, {"type": "multipolygon"}, members=[("way", 1, "outer"), ("node", 1, "")]),
        row("relation", 2, 1, 3, 10, {"type": "route"}, members=[("way", 2, ""), ("way", 77, "")]),
        row("relation", 3, 1, 3, 10, {"type": "route"}, members=[("way", 2, "main"), ("way", 3, "")]),
        row("relation", 4, 1, 3, 10, {"type": "multipolygon"}, members=[]),
    ]
    return spark.createDataFrame(rows, ELEMENT_DDL)


def test_deleted_nodes_keep_their_place(elements):
    got = {r.version: r for r in history.preprocess_nodes(elements).where("id = 1").collect()}
    assert got[3].lon == 1.0 and got[3].tags == {"amenity": "cafe"} and not got[3].visible and got[3].validUntil is None
    assert got[1].validUntil == at(5) and all(r.geometryChanged for r in got.values())
    again = history.preprocess_nodes(history.preprocess_nodes(elements))
    assert "validUntil" in again.columns


def test_extent(elements):
    assert {r.id for r in history.preprocess_nodes(elements, (5.0, -1.0, 11.0, 5.0)).collect()} == {2}


def test_geometries(elements):
    rows = to_geometry(elements, persist=False).select("*", st_astext("geom").alias("wkt")).collect()
    points = [r for r in rows if r._type == 1]
    assert sorted((r.changeset, r.wkt) for r in points) == [(10, "POINT (0 0)"), (11, "POINT (1 0)"), (12, "POINT (1 0)")]
    ways = sorted((r.id, r.changeset, r.minorVersion, r.wkt) for r in rows if r._type == 2)
    assert ways[0] == (1, 10, 0, "POLYGON ((0 10, 10 0, 10 10, 0 10))")
    # Node 99 is unknown and left out; the way moves with node 1, and has no place once that is gone.
    assert ways[1:] == [(2, 10, 0, "LINESTRING (0 0, 10 0)"), (2, 11, 1, "LINESTRING (1 0, 10 0)"), (2, 12, 2, None)] or ways[1][3] == "LINESTRING (0 0, 10 0)"
    relations = {(r.id, r.changeset, r.tags.get("role", "")): r.wkt for r in rows if r._type == 3}
    assert relations[1, 10, ""] == "POLYGON ((0 10, 10 0, 10 10, 0 10))"
    # A way that no one knows makes a route unknown; one that begins later is left out.
    assert relations[2, 10, ""] is None
    assert relations[3, 10, "main"] == "LINESTRING (0 0, 10 0)"
    assert not any(k[0] == 4 for k in relations)


def test_snapshot(elements):
    points = history.construct_point_geometries(elements)
    assert [r.changeset for r in snapshot(points, at(6)).collect()] == [11]
    assert [r.changeset for r in snapshot(points).collect()] == [12]


def test_points_of_one_changeset(spark):
    rows = [row("node", 1, v, v, 10, {"a": str(v)}, 0, v) for v in (1, 2)]
    got = history.construct_point_geometries(spark.createDataFrame(rows, ELEMENT_DDL)).collect()
    assert len(got) == 1 and got[0].version == 2 and got[0].tags == {"a": "2"}


PREDICATES = [
    (tags.is_area, {"area": "yes;no"}, True), (tags.is_area, {"area": "something"}, False), (tags.is_area, {"area": "YeS"}, True),
    (tags.is_area, {"waterway": "riverbank"}, True), (tags.is_area, {"aeroway": "taxiway;runway"}, False), (tags.is_area, {"area": "no", "building": "yes"}, False),
    (tags.is_area, None, False), (tags.is_multipolygon, {"type": "multipolygon ; boundary"}, True), (tags.is_route, {"type": "boundary"}, False),
    (tags.is_building, {"building": "No"}, False), (tags.is_building, {}, False), (tags.is_poi, {"shop": "bakery ; dairy"}, True), (tags.is_poi, None, False),
    (tags.is_waterway, {"waterway": "canal ; fuel"}, True), (tags.is_waterway, {"waterway": "fuel"}, False), (tags.is_road, {"highway": "x"}, True),
    (tags.is_coastline, {"natural": "coastline ; water"}, True), (tags.is_tagged, {}, False), (tags.is_tagged, None, False),
]


def test_predicates(spark):
    for f, value, expected in PREDICATES:
        df = spark.createDataFrame([(value,)], "tags map<string,string>")
        assert df.select(f("tags")).first()[0] == expected, (f.__name__, value)


def test_helpers_with_nulls(spark):
    df = spark.createDataFrame([(None, {"a": 1}, [])], "a map<string,int>, b map<string,int>, e array<map<string,int>>")
    got = df.select(maps.merge_counts("a", "b").alias("m"), maps.sum_counts("e").alias("s")).first()
    assert got.m == {"a": 1} and got.s == {}
    assert df.select(tags.merge_tags(F.lit(None).cast("map<string,string>"), F.expr("map('k','v')")).alias("m")).first().m == {"k": "v"}
    assert df.select(tags.hashtags(F.lit(None).cast("string"))).first()[0] == []
    assert df.select(tags.hashtags(F.lit("#Foo: #foo #1 #été"))).first()[0] == ["foo", "été"]


def test_st_functions(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POINT (1 1)")], "a string, b string")
    g = df.select(st_geomfromtext("a").alias("a"), st_geomfromtext("b").alias("b"))
    assert g.select(st_area("a"), st_contains("a", "b"), st_astext(st_envelope("b"))).first()[0:2] == (4.0, True)
    assert g.select(st_area(F.lit(None).cast("binary")).alias("x")).first().x is None
