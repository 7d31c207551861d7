"""Tile levels and the tiles that geometries cover."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..geometry.planar import RADIUS, meets_box
from ..geometry.wkb import POINT, all_coords, from_wkb, is_empty, parts

HALF = math.pi * RADIUS
WORLD = {"EPSG:3857": (-HALF, -HALF, HALF, HALF), "EPSG:4326": (-180.0, -90.0, 180.0, 90.0)}
KEYS = "array<struct<col:int,row:int>>"


@dataclass(frozen=True)
class TileLevel:
    """A square layout of tiles over an extent (xmin, ymin, xmax, ymax); row 0 is the top."""

    zoom: int
    extent: tuple[float, float, float, float]
    cols: int
    rows: int
    tile_px: int = 4096

    @property
    def cell_size(self) -> float:
        return (self.extent[2] - self.extent[0]) / (self.cols * self.tile_px)

    def box(self, col: int, row: int) -> tuple[float, float, float, float]:
        x0, y0, x1, y1 = self.extent
        w, h = (x1 - x0) / self.cols, (y1 - y0) / self.rows
        return x0 + col * w, y1 - (row + 1) * h, x0 + (col + 1) * w, y1 - row * h


def zoomed(zoom: int, crs: str = "EPSG:3857", tile_px: int = 4096) -> TileLevel:
    """The level of 2**zoom by 2**zoom tiles."""
    return TileLevel(zoom, WORLD[crs], 1 << zoom, 1 << zoom, tile_px)


def keys_of(wkb: bytes | None, level: TileLevel) -> list[tuple[int, int]]:
    """Tiles that a geometry meets; none for a null or empty one.

    A point lies in one tile (the one right of and below a border). A line or polygon lies
    in every tile whose closed box it meets.
    """
    g = from_wkb(wkb)
    if g is None or is_empty(g):
        return []
    x0, y0, x1, y1 = level.extent
    c = all_coords(g)
    at = np.stack([(c[:, 0] - x0) / (x1 - x0) * level.cols, (y1 - c[:, 1]) / (y1 - y0) * level.rows], axis=1)
    at = np.clip(np.floor(at), 0, (level.cols - 1, level.rows - 1)).astype(int)
    out: set[tuple[int, int]] = set()
    n = 0
    for p in parts(g):
        m = len(all_coords(p))
        a, n = at[n : n + m], n + m
        (c0, r0), (c1, r1) = a.min(0).tolist(), a.max(0).tolist()
        if p[0] == POINT or (c0, r0) == (c1, r1):
            out.add((c0, r0))
            continue
        out |= {(i, j) for i in range(c0, c1 + 1) for j in range(r0, r1 + 1) if (i, j) not in out and meets_box(p, level.box(i, j))}
    return sorted(out)


_POINT_HEAD = b"\x01\x01\0\0\0"


def _batch_keys(raw: list[bytes | None], level: TileLevel) -> pa.Array:
    """Tiles of each geometry; plain points, each in one tile, are placed for the whole batch at once."""
    flat = np.fromiter((b is not None and b[:5] == _POINT_HEAD for b in raw), bool, len(raw))
    rows = np.flatnonzero(flat)
    xy = np.frombuffer(b"".join([raw[k][5:21] for k in rows.tolist()]), "<f8").reshape(-1, 2)
    placed = ~np.isnan(xy).all(axis=1)
    rows, xy = rows[placed], xy[placed]
    x0, y0, x1, y1 = level.extent
    with np.errstate(invalid="ignore"):
        at = np.stack([(xy[:, 0] - x0) / (x1 - x0) * level.cols, (y1 - xy[:, 1]) / (y1 - y0) * level.rows], axis=1)
        at = np.clip(np.floor(at), 0, (level.cols - 1, level.rows - 1)).astype(np.int64)
    others = {k: keys_of(raw[k], level) for k in np.flatnonzero(~flat).tolist() if raw[k] is not None}
    n = np.zeros(len(raw) + 1, np.int64)
    n[rows + 1] = 1
    for k, keys in others.items():
        n[k + 1] = len(keys)
    first = np.cumsum(n)
    out = np.zeros((int(first[-1]), 2), np.int64)
    out[first[rows]] = at
    for k, keys in others.items():
        if keys:
            out[first[k] : first[k] + len(keys)] = keys
    cols = [pa.array(out[:, k].astype(np.int32)) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(cols, names=["col", "row"]))


def key_to(level: TileLevel):
    """A UDF from WKB to the tiles that it meets."""

    @F.arrow_udf(KEYS)
    def run(wkb: pa.Array) -> pa.Array:
        return _batch_keys(wkb.to_pylist(), level)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


def point_key(x: Column, y: Column, level: TileLevel) -> Column:
    """The tile of a point, by built-in expressions."""
    x0, y0, x1, y1 = level.extent

    def bounded(v: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v))).cast("int")

    col = bounded((x - x0) / (x1 - x0) * level.cols, level.cols)
    row = bounded((F.lit(y1) - y) / (y1 - y0) * level.rows, level.rows)
    return F.struct(col.alias("col"), row.alias("row"))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def parent_keys(keys: Column, levels: int = 1) -> Column:
    """Distinct tiles that hold the tiles, so many levels up."""
    return F.array_distinct(
        F.transform(keys, lambda k: F.struct(F.shiftright(k["col"], levels).alias("col"), F.shiftright(k["row"], levels).alias("row")))
    )
