"""Tiles: keys, encoding read back, the pyramid and its files."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.geometry.udfs import st_makepoint
from terrachron.geometry.wkb import LINE, POLYGON, to_wkb
from terrachron.tiles import export, grid, mvt
from terrachron.tiles.pipeline import LayerNamesInColumn, Options, Output, Pipeline, SingleLayer, make_tiles


def test_keys():
    level = grid.zoomed(2)
    w = grid.HALF / 2
    line = to_wkb((LINE, np.array([[-1.5 * w, 0.5 * w], [0.5 * w, 0.5 * w]])))
    assert grid.keys_of(line, level) == [(0, 1), (1, 1), (2, 1)]
    assert grid.keys_of(None, level) == [] and grid.keys_of(to_wkb((LINE, [])), level) == []
    assert level.box(0, 0) == pytest.approx((-grid.HALF, w, -w, grid.HALF))


def test_mvt_round_trip():
    ring = np.array([[1, 1], [9, 1], [9, 9], [1, 9], [1, 1]], float)
    hole = np.array([[3, 3], [4, 3], [4, 4], [3, 4], [3, 3]], float)
    features = [((POLYGON, [ring, hole]), {"a": "x", "n": 3, "f": 1.5, "b": True, "m": -2, "z": None}), ((LINE, np.array([[0.0, 0], [10, 10]])), {})]
    got = mvt.read(mvt.tile({"l": features}, (0, 0, 10, 10), 100))["l"]
    assert got["extent"] == 100 and [f["type"] for f in got["features"]] == [2, 3]
    poly = got["features"][1]
    assert poly["attributes"] == {"a": "x", "n": 3, "f": 1.5, "b": True, "m": -2}
    assert set(poly["paths"][0]) == {(10, 90), (90, 90), (90, 10), (10, 10)} and len(poly["paths"]) == 2


def test_areas_are_ordered():
    box = lambda s: (POLYGON, [np.array([[0, 0], [s, 0], [s, s], [0, s], [0, 0]], float)])
    got = mvt.read(mvt.tile({"l": [(box(1), {"s": 1}), (box(5), {"s": 5})]}, (0, 0, 10, 10), 100, order_areas=True))
    assert [f["attributes"]["s"] for f in got["l"]["features"]] == [5, 1]


def test_pyramid_and_files(spark, tmp_path):
    class P(Output):
        layers = LayerNamesInColumn("layer")
        attributes = ("id",)
        base_uri = f"file://{tmp_path}"

        def reduce(self, df, level, key_column):
            return df.where(F.col("id") >= 0)

    rows = [(k, float(k), "even" if k % 2 == 0 else "odd") for k in range(-1, 10)]
    df = spark.createDataFrame(rows, "id long, x double, layer string").withColumn("geom", st_makepoint("x", F.lit(10.0)))
    list(make_tiles(df, P(), Options.create(4, 2, use_caching=True)))
    n = 0
    for z in (4, 3, 2):
        files = [os.path.join(a, f) for a, _, fs in os.walk(tmp_path / str(z)) for f in fs]
        got = [mvt.read(open(f, "rb").read()) for f in files]
        total = sum(len(v["features"]) for t in got for v in t.values())
        assert total == 10 and all(f.endswith(".mvt") for f in files)
        n += total
    assert n == 30


def test_checks(spark):
    df = spark.createDataFrame([("a",)], "geom string")
    with pytest.raises(ValueError):
        list(make_tiles(df, Pipeline(), Options.for_zoom(1)))
    level = grid.zoomed(1)
    with pytest.raises(ValueError):
        list(make_tiles(df.select(F.lit(b"").alias("geom")), Pipeline(), Options((level, level))))
    assert [x.zoom for x in Options.for_all_zooms_from(2).levels] == [2, 1, 0]
    assert SingleLayer("a") == SingleLayer("a")


def test_object_store():
    put = export.object_of("/a/b/", 3, 1, 2, b"tile")
    assert put["Key"] == "a/b/3/1/2.mvt" and gzip.decompress(put["Body"]) == b"tile" and "ACL" not in put
    assert export.object_of("", 3, 1, 2, b"", public=True)["ACL"] == "public-read"


def test_tiles_on_another_file_system(spark, tmp_path):
    from terrachron.tiles.export import save_tiles

    where = str(tmp_path)

    def opened(uri):
        from pyarrow import fs

        assert uri == "hdfs://name/tiles"
        return fs.SubTreeFileSystem(where, fs.LocalFileSystem()), "tiles"

    tiles = spark.createDataFrame([(3, 1, 2, b"a"), (3, 1, 4, b"b"), (3, 7, 0, b"c")], "zoom int, col int, row int, mvt binary")
    for _ in range(2):  # writing again replaces
        save_tiles(tiles, "hdfs://name/tiles", opened=opened)
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"tiles/3/1/2.mvt": b"a", "tiles/3/1/4.mvt": b"b", "tiles/3/7/0.mvt": b"c"}


def test_mixed_geometries_get_their_tiles():
    from terrachron.geometry.wkb import POINT, from_wkt, to_wkb
    from terrachron.tiles import grid

    level = grid.zoomed(5)
    raw = [to_wkb(from_wkt(t)) for t in ("POINT (1e6 2e6)", "LINESTRING (0 0, 5e6 3e6)", "POINT (-3e7 3e7)", "MULTIPOINT (0 0, 4e6 4e6)")]
    raw += [None, to_wkb((POINT, None)), to_wkb((POINT, (5.0, float("nan"))))][:2]
    got = [[(k["col"], k["row"]) for k in keys] for keys in grid._batch_keys(raw, level).to_pylist()]
    assert got == [grid.keys_of(g, level) for g in raw]


def test_level_tiles_are_simplified(spark):
    """A line with a spike lower than a cell: the tile's feature has two points, as the pyramid's."""
    from terrachron.geometry.wkb import from_wkt
    from terrachron.tiles.pipeline import SimplifyToCell, level_tiles

    level = grid.zoomed(3)
    e = level.cell_size / 3
    rows = [(bytearray(to_wkb(from_wkt(f"LINESTRING (10 10, 1e6 {10 + e}, 2e6 10)"))),)]
    df = spark.createDataFrame(rows, "geom binary").withColumn("_keys", grid.key_to(level)("geom"))
    (tile,) = level_tiles(df, SimplifyToCell(), level, "_keys", Options((level,), tile_extent=1 << 30)).collect()
    read = mvt.read(tile.mvt)["features"]
    assert [len(p) for p in read["features"][0]["paths"]] == [2] and mvt.counts(tile.mvt) == {"features": 1}


def test_points_in_batches_meet_what_one_by_one_they_do():
    from terrachron.geometry.planar import intersects, reproject
    from terrachron.geometry.udfs import _reprojected
    from terrachron.geometry.wkb import POINT, all_coords, from_wkt
    from terrachron.operators.geocode import _of_points

    shapes = [from_wkt("POLYGON ((0 0, 6 0, 0 6, 0 0))"), from_wkt("POLYGON ((1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 5 3, 5 5, 3 5, 3 3))")]
    ends = [all_coords(g) for g in shapes]
    cache = {"codes": ["b", "a"], "shapes": shapes, "lo": np.array([e.min(0) for e in ends]), "hi": np.array([e.max(0) for e in ends])}
    points = [(POINT, (x / 2, y / 2)) for x in range(-1, 20) for y in range(-1, 20)]
    raw = [to_wkb(p) for p in points] + [None, to_wkb((LINE, np.array([[0.0, 0], [1, 1]])))]
    found = _of_points(raw, cache)
    assert [found.get(k) for k in range(len(raw))] == [sorted(c for c, g in zip("ba", shapes) if intersects(p, g)) for p in points] + [None, None]
    n = len(raw)
    alone = [None if b is None else to_wkb(reproject(g, "EPSG:4326", "EPSG:3857")) for b, g in zip(raw, [*points, None, (LINE, np.array([[0.0, 0], [1, 1]]))])]
    got = _reprojected(raw, ["EPSG:4326"] * n, ["EPSG:3857"] * n)
    assert [np.frombuffer(b[5:21], "<f8").tolist() for b in got[: n - 2]] == [pytest.approx(np.frombuffer(b[5:21], "<f8").tolist(), rel=1e-14, abs=1e-9) for b in alone[: n - 2]]
    assert got[n - 2 :] == alone[n - 2 :]
