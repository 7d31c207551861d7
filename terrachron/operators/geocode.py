"""Countries of geometries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..geometry.geojson import read_collection
from ..geometry.planar import inside_ring, intersects, on_ring
from ..geometry.udfs import st_intersects
from ..geometry.wkb import MULTIPOLYGON, POLYGON, Geometry, all_coords, coords, from_wkb, is_empty, to_wkb
from ..tiles.grid import key_to, zoomed

MAX_BYTES = 256 << 20


def read_countries(text: str | bytes, code: str = "ADM0_A3") -> list[tuple[str, Geometry]]:
    """(code, multipolygon) of the features of a GeoJSON collection; those without polygon or code are left out."""
    out = []
    for g, properties, _ in read_collection(text):
        if g is not None and properties.get(code) is not None and g[0] in (POLYGON, MULTIPOLYGON):
            out.append((str(properties[code]), g if g[0] == MULTIPOLYGON else (MULTIPOLYGON, [g])))
    return out


def _by_tiles(geoms: DataFrame, countries: list[tuple[str, Geometry]], geometry_column: str, zoom: int = 6) -> DataFrame:
    """The same by a join on tiles of longitudes and latitudes, then the exact test: no task holds all polygons.

    A geometry and a polygon that meet do so in some tile. All columns ride along, so that
    rows need no key of their own.
    """
    key = key_to(zoomed(zoom, "EPSG:4326"))
    parts = [(c, bytearray(to_wkb(p))) for c, g in countries for p in g[1]]
    shapes = geoms.sparkSession.createDataFrame(parts, "code string, shape binary")
    shapes = shapes.select("code", "shape", F.explode(key("shape")).alias("k")).select("code", "shape", F.col("k.col").alias("c"), F.col("k.row").alias("r"))
    rows = geoms.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("all"), F.col(geometry_column).alias("g"))
    keyed = rows.select("n", "all", "g", F.explode_outer(key("g")).alias("k")).select("n", "all", "g", F.col("k.col").alias("c"), F.col("k.row").alias("r"))
    met = keyed.join(shapes, ["c", "r"], "left")
    code = F.when(st_intersects(F.when(F.col("shape").isNotNull(), F.col("g")), "shape"), F.col("code"))
    found = met.groupBy("n").agg(F.first("all").alias("all"), F.sort_array(F.collect_set(code)).alias("countries"))
    return found.select("all.*", "countries")


#: Pairs of points and edges that are tested at a time.
PAIRS = 1 << 18


def _of_points(raw: list[bytes | None], shapes: dict) -> dict[int, list[str]]:
    """Sorted codes of the plain points among geometries: each polygon is tested for all points in its box at once."""
    rows = [k for k, b in enumerate(raw) if b is not None and len(b) == 21 and b[:5] == b"\x01\x01\0\0\0"]
    xy = np.frombuffer(b"".join([raw[k][5:] for k in rows]), "<f8").reshape(-1, 2)
    good = ~np.isnan(xy).any(axis=1)
    rows, xy = np.array(rows, int)[good].tolist(), xy[good]
    found: list[set[str]] = [set() for _ in rows]
    for code, (_, body), lo, hi in zip(shapes["codes"], shapes["shapes"], shapes["lo"], shapes["hi"]):
        near = np.flatnonzero(((xy >= lo) & (xy <= hi)).all(axis=1))
        rings = [coords(r) for r in body]
        step = max(1, PAIRS // sum(map(len, rings)))
        for at in range(0, len(near), step):
            part = near[at : at + step]
            p = xy[part]
            meets = np.any([on_ring(p, r) for r in rings], axis=0) | (np.sum([inside_ring(p, r) for r in rings], axis=0) % 2 == 1)
            for k in part[meets].tolist():
                found[k].add(code)
    return {k: sorted(f) for k, f in zip(rows, found)}


def geocode(geoms: DataFrame, countries: list[tuple[str, Geometry]], geometry_column: str = "geom", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds ``countries``: sorted codes of all countries that a geometry meets; empty for null or empty geometries.

    The country polygons are broadcast while their WKB takes at most ``max_bytes``, and boxes
    exclude most of them before the exact test; beyond, geometries and polygons meet in a
    join on tiles.
    """
    packed = [(c, to_wkb(g)) for c, g in countries]
    if sum(len(w) for _, w in packed) > max_bytes:
        return _by_tiles(geoms, countries, geometry_column)
    shared = geoms.sparkSession.sparkContext.broadcast(packed)
    cache: dict = {}

    @F.pandas_udf("array<string>")
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "codes" not in cache:
            # Each polygon is a candidate of its own: boxes of parts are tighter than a country's.
            single = [(c, p) for c, w in shared.value for p in from_wkb(w)[1]]
            cache["codes"] = [c for c, _ in single]
            cache["shapes"] = [p for _, p in single]
            ends = [all_coords(p) for _, p in single]
            cache["lo"] = np.array([e.min(0) for e in ends]).reshape(-1, 2)
            cache["hi"] = np.array([e.max(0) for e in ends]).reshape(-1, 2)
        for batch in batches:
            out = []
            raw = [None if b is None else bytes(b) for b in batch]
            quick = _of_points(raw, cache)
            for k, wkb in enumerate(raw):
                if k in quick:
                    out.append(quick[k])
                    continue
                g = from_wkb(wkb)
                if g is None or is_empty(g):
                    out.append([])
                    continue
                c = all_coords(g)
                near = np.flatnonzero((cache["lo"] <= c.max(0)).all(axis=1) & (cache["hi"] >= c.min(0)).all(axis=1))
                found: set[str] = set()
                for k in near.tolist():
                    if cache["codes"][k] not in found and intersects(g, cache["shapes"][k]):
                        found.add(cache["codes"][k])
                out.append(sorted(found))
            yield pd.Series(out, dtype=object)

    return geoms.withColumn("countries", lookup(F.col(geometry_column)))


def regions_by_changeset(geocoded: DataFrame) -> DataFrame:
    """changeset, countries: all countries that a changeset touched."""
    rows = geocoded.select("changeset", F.explode("countries").alias("country")).where(F.col("country").isNotNull())
    return rows.groupBy("changeset").agg(F.sort_array(F.collect_set("country")).alias("countries"))
