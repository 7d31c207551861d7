"""Geometry kernel: codecs, validity, unions, assembly, clipping, with random differential checks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrachron.geometry import assemble, geojson, planar, wkb
from terrachron.geometry.wkb import LINE, MULTILINE, MULTIPOLYGON, POINT, POLYGON, from_wkb, from_wkt, to_wkb, to_wkt

TEXTS = [
    "POINT (1 2.5)", "POINT EMPTY", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))",
    "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "MULTIPOLYGON EMPTY",
    "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))",
]


def square(x, y, s):
    return np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]], float)


@pytest.mark.parametrize("text", TEXTS)
def test_codecs_round_trip(text):
    g = from_wkt(text)
    assert to_wkb(from_wkb(to_wkb(g))) == to_wkb(g)
    assert to_wkb(from_wkt(to_wkt(g))) == to_wkb(g)
    assert to_wkb(geojson.from_geojson(geojson.to_geojson(g))) == to_wkb(g)


def test_big_endian_and_z():
    import struct

    raw = struct.pack(">BI", 0, 1001) + struct.pack(">ddd", 1, 2, 3)
    assert from_wkb(raw) == (POINT, (1.0, 2.0))


def test_validity():
    assert planar.is_valid((POLYGON, [square(0, 0, 1)]))
    bow = np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], float)
    assert not planar.is_valid((POLYGON, [bow]))
    assert not planar.is_valid((LINE, np.zeros((3, 2))))
    assert not planar.is_valid((POLYGON, [square(0, 0, 1), square(5, 5, 1)]))
    assert planar.is_valid((POLYGON, [square(0, 0, 3), square(1, 1, 1)]))


def test_union_of_rings():
    area = lambda rings: sum(planar.area(p) for p in planar.union_rings(rings))
    assert area([square(0, 0, 2), square(1, 1, 2)]) == pytest.approx(7)
    assert area([square(0, 0, 2), square(2, 0, 2)]) == pytest.approx(8)
    assert len(planar.union_rings([square(0, 0, 1), square(5, 5, 1)])) == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5)), min_size=1, max_size=6, unique=True))
def test_union_area_by_cells(boxes):
    cells = {(i, j) for x, y, s in boxes for i in range(x, x + s) for j in range(y, y + s)}
    got = planar.union_rings([square(*b) for b in boxes])
    assert sum(map(planar.area, got)) == pytest.approx(len(cells))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.floats(-1, 1), st.floats(-1, 1), st.floats(0.1, 2))
def test_clip_area_by_sampling(seed, x, y, s):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 12))
    a = np.sort(rng.random(n)) * 2 * np.pi
    c = np.stack([np.cos(a), np.sin(a)], axis=1) * (0.5 + rng.random(n))[:, None]
    ring = np.concatenate([c, c[:1]])
    g = (POLYGON, [ring])
    box = (x, y, x + s, y + s)
    if not planar.is_valid(g) or not planar.meets_box(g, box):
        return
    got = planar.clip(g, box)
    p = rng.random((4000, 2)) * s + (x, y)
    share = planar.inside_ring(p, ring).mean() * s * s
    assert planar.area(got) == pytest.approx(share, abs=0.06 * s * s)


def test_clip_lines_and_touch():
    g = (LINE, np.array([[-1, 0.5], [2, 0.5], [2, 2], [0.5, 2], [0.5, -1]], float))
    got = planar.clip(g, (0, 0, 1, 1))
    assert got[0] == MULTILINE and planar.length(got) == pytest.approx(2)
    assert planar.clip((LINE, np.array([[5, 5], [6, 6]], float)), (0, 0, 1, 1))[0] == LINE
    touch = planar.clip((POLYGON, [square(1, 0, 1)]), (0, 0, 1, 1))
    assert touch[0] == MULTIPOLYGON and wkb.is_empty(touch)


def test_way_rules():
    assert assemble.way(np.array([[1.0, 2.0]]), False) == (POINT, (1.0, 2.0))
    assert assemble.way(np.array([[1.0, np.nan], [2, 2]]), False) is None
    assert assemble.way(square(0, 0, 1), True)[0] == POLYGON
    assert assemble.way(square(0, 0, 1), False)[0] == LINE
    assert assemble.way(np.array([[1.0, 1], [1, 1]]), False) is None


def split(ring, cuts, turn):
    at = [0, *cuts, len(ring) - 1]
    return [(LINE, ring[a : b + 1][::-1] if t else ring[a : b + 1]) for (a, b), t in zip(zip(at, at[1:]), turn)]


def test_multipolygon_from_parts():
    parts = split(square(0, 0, 4), [1, 3], [True, False, True]) + [(LINE, square(1, 1, 1))]
    g = assemble.multipolygon([2] * 4, ["outer", "", "outer", "inner"], parts[::-1])
    assert g[0] == POLYGON and planar.area(g) == pytest.approx(15)
    assert assemble.multipolygon([2], ["outer"], [None]) is None
    assert assemble.multipolygon([2], ["outer"], [(LINE, np.array([[0.0, 0], [1, 1]]))]) is None
    assert assemble.multipolygon([], [], []) is None
    apart = assemble.multipolygon([2, 2], ["", ""], [(LINE, square(0, 0, 1)), (LINE, square(5, 0, 1))])
    assert apart[0] == MULTIPOLYGON and planar.area(apart) == pytest.approx(2)
    island = assemble.multipolygon([2] * 3, [""] * 3, [(LINE, square(0, 0, 9)), (LINE, square(1, 1, 5)), (LINE, square(2, 2, 1))])
    # An island within a hole unites with the outer ring around both.
    assert planar.area(island) == pytest.approx(81 - 25)


def test_routes():
    a, b, c = (np.array(x, float) for x in ([[0, 0], [1, 0]], [[2, 0], [1, 0]], [[5, 5], [6, 6]]))
    got = dict(assemble.routes([2, 2, 2], ["", "", "stop"], [(LINE, a), (LINE, b), (LINE, c)]))
    assert got[""][0] == LINE and len(got[""][1]) == 3 and got["stop"][0] == LINE
    broken = dict(assemble.routes([2, 2], ["", ""], [(LINE, a), (LINE, c)]))
    assert broken[""][0] == MULTILINE
    assert assemble.routes([2], [""], [None]) is None


def test_jts_agrees(spark):
    """Areas, validity and unions against the library that Spark ships, on random rings."""
    jts = spark.sparkContext._jvm.org.locationtech.jts
    reader = jts.io.WKTReader()
    rng = np.random.default_rng(3)
    for _ in range(30):
        polygons = []
        for _ in range(2):
            n = int(rng.integers(3, 9))
            a = np.sort(rng.random(n)) * 2 * np.pi
            c = np.stack([np.cos(a), np.sin(a)], axis=1) * (0.5 + rng.random(n))[:, None] + rng.random(2)
            polygons.append((POLYGON, [np.concatenate([c, c[:1]])]))
        theirs = [reader.read(to_wkt(p)) for p in polygons]
        for p, t in zip(polygons, theirs):
            assert planar.is_valid(p) == t.isValid()
        if all(t.isValid() for t in theirs):
            got = sum(map(planar.area, planar.union_rings([p[1][0] for p in polygons])))
            assert got == pytest.approx(theirs[0].union(theirs[1]).getArea(), rel=1e-6)
            assert planar.intersects(*polygons) == theirs[0].intersects(theirs[1])
            mine, c = planar.centroid(polygons[0]), theirs[0].getCentroid()
            assert mine == pytest.approx((c.getX(), c.getY()), rel=1e-6)


def test_simplify_and_mercator():
    c = np.stack([np.linspace(0, 10, 50), np.sin(np.linspace(0, 10, 50)) * 0.01], axis=1)
    got = planar.simplify((LINE, c), 0.1)
    assert len(got[1]) == 2 and (got[1][0] == c[0]).all()
    assert planar.from_mercator(planar.to_mercator(np.array([[12.5, -33.0]]))) == pytest.approx(np.array([[12.5, -33.0]]))


def test_tolerant_geojson():
    text = '{"features": [{"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0,0]]]}, "id": 7}, {"type": "x"}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}'
    got = geojson.read_collection(text)
    assert [(g, i) for g, _, i in got] == [(None, "7"), ((POINT, (1.0, 2.0)), None)]
    out = geojson.write_collection(got)
    assert out["bbox"] == [1.0, 2.0, 1.0, 2.0] and out["features"][0]["geometry"]["type"] == "MultiPoint"


def test_countries_by_broadcast_and_by_tiles(spark):
    import random

    from terrachron.geometry.udfs import st_geomfromtext
    from terrachron.operators.geocode import geocode, read_countries

    rng = random.Random(3)
    shape = lambda x, y, r: f'[[{x - r}, {y - r}], [{x + r}, {y - r}], [{x}, {y + r}], [{x - r}, {y - r}]]'
    features = [f'{{"type": "Feature", "properties": {{"ADM0_A3": "C{k}"}}, "geometry": {{"type": "Polygon", "coordinates": [{shape(rng.uniform(-150, 150), rng.uniform(-60, 60), rng.uniform(1, 25))}]}}}}' for k in range(25)]
    countries = read_countries('{"type": "FeatureCollection", "features": [' + ", ".join(features) + "]}")
    texts = [f"POINT ({rng.uniform(-170, 170)} {rng.uniform(-80, 80)})" for _ in range(60)]
    texts += [f"LINESTRING ({rng.uniform(-170, 170)} 0, {rng.uniform(-170, 170)} {rng.uniform(-80, 80)})" for _ in range(20)] + [None, "POINT EMPTY", texts[0], texts[0]]
    df = spark.createDataFrame([(k, t, {"a": "b"}) for k, t in enumerate(texts)], "n long, t string, countries0 map<string,string>").withColumn("geom", st_geomfromtext("t"))
    one, two = (sorted((r.n, r.countries) for r in geocode(df, countries, max_bytes=size).collect()) for size in (1 << 20, 0))
    assert one == two and len(one) == len(texts) and sum(bool(c) for _, c in one) > 20 and geocode(df, countries, max_bytes=0).columns == [*df.columns, "countries"]

