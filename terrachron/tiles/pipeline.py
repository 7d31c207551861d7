"""Any geometry DataFrame as a pyramid of vector tiles: reduce, simplify, select, clip, pack."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..geometry import planar
from ..geometry.wkb import Geometry, from_wkb, to_wkb
from . import export, mvt
from .grid import TileLevel, key_to, parent_keys, zoomed


@dataclass(frozen=True)
class SingleLayer:
    """All features in one layer."""

    name: str


@dataclass(frozen=True)
class LayerNamesInColumn:
    """The layer of each feature is in a string column."""

    name: str


@dataclass(frozen=True)
class Options:
    """Levels (any order, zooms all different) and how tiles are made.

    ``tile_extent`` None makes a tile's grid as wide as the level has columns; a number, such
    as 4096, sets it. ``use_caching`` keeps each level on disk for those above it.
    """

    levels: tuple[TileLevel, ...]
    source_crs: str = "EPSG:4326"
    target_crs: str = "EPSG:3857"
    use_caching: bool = False
    order_areas: bool = False
    tile_extent: int | None = None

    @classmethod
    def create(cls, max_zoom: int, min_zoom: int | None = None, tile_px: int = 4096, target_crs: str = "EPSG:3857", **more) -> Options:
        """Levels from ``max_zoom`` down to ``min_zoom`` (``max_zoom`` if None, else within 0..max_zoom)."""
        low = max_zoom if min_zoom is None else max(0, min(min_zoom, max_zoom))
        levels = tuple(zoomed(z, target_crs, tile_px) for z in range(max_zoom, low - 1, -1))
        return cls(levels, target_crs=target_crs, **more)

    @classmethod
    def for_zoom(cls, zoom: int) -> Options:
        return cls.create(zoom)

    @classmethod
    def for_zoom_range(cls, min_zoom: int, max_zoom: int) -> Options:
        return cls.create(max_zoom, min_zoom)

    @classmethod
    def for_all_zooms_from(cls, zoom: int) -> Options:
        return cls.create(zoom, 0)

    @classmethod
    def for_all_zooms_with_source(cls, zoom: int, source_crs: str) -> Options:
        return cls.create(zoom, 0, source_crs=source_crs)


class Pipeline:
    """What to override for one's own tiles; every hook has a default.

    ``attributes`` names the columns that features carry.
    """

    geometry_column: str = "geom"
    layers: SingleLayer | LayerNamesInColumn = SingleLayer("features")
    attributes: Sequence[str] = ()

    def reduce(self, df: DataFrame, level: TileLevel, key_column: str) -> DataFrame:
        """Thin or aggregate the data before a level is made; the levels above see the result."""
        return df

    def simplify(self, g: Geometry, level: TileLevel) -> Geometry:
        return g

    def select(self, df: DataFrame, zoom: int, key_column: str) -> DataFrame:
        """Rows and columns of this level only."""
        return df

    def clip(self, g: Geometry, box: tuple[float, float, float, float], level: TileLevel) -> Geometry:
        return g

    def pack(self, row: dict, zoom: int) -> dict:
        """Attributes of a feature, from its ``attributes`` columns."""
        return row

    def finalize(self, tiles: DataFrame, zoom: int) -> None:
        """Called once a level with its tiles (zoom, col, row, mvt)."""


class Output(Pipeline):
    """A pipeline that writes its tiles below ``base_uri``."""

    base_uri: str = ""

    def finalize(self, tiles: DataFrame, zoom: int) -> None:
        export.save_tiles(tiles, self.base_uri)


class SimplifyToCell(Pipeline):
    """A pipeline that simplifies to the size of a cell and clips to tiles."""

    def simplify(self, g: Geometry, level: TileLevel) -> Geometry:
        return planar.simplify(g, level.cell_size)

    def clip(self, g: Geometry, box: tuple[float, float, float, float], level: TileLevel) -> Geometry:
        return planar.clip(g, box)


def _overrides(p: Pipeline, hook: str) -> bool:
    return getattr(type(p), hook) is not getattr(Pipeline, hook)


def _simplified(p: Pipeline, level: TileLevel, geom: str) -> Column:
    if not _overrides(p, "simplify"):
        return F.col(geom)

    @F.pandas_udf(BinaryType())
    def run(wkb: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else to_wkb(p.simplify(from_wkb(g), level)) for g in wkb], dtype=object)

    return run(geom)


def level_tiles(df: DataFrame, p: Pipeline, level: TileLevel, key_column: str, options: Options) -> DataFrame:
    """zoom, col, row, mvt of the tiles of keyed rows, simplified, selected, clipped and packed."""
    return _tiles_of(df.withColumn(p.geometry_column, _simplified(p, level, p.geometry_column)), p, level, key_column, options)


def _tiles_of(df: DataFrame, p: Pipeline, level: TileLevel, key_column: str, options: Options) -> DataFrame:
    """Tiles of keyed rows whose geometries are simplified.

    Geometries are clipped and encoded where they are, a row a tile and feature, so that a
    tile with very many features takes no longer than others there; what meets in the
    shuffle on the tile is encoded bytes, which its task only has to number and join. A tile
    whose own bytes outgrow a task must be thinned by ``reduce`` or ``select``.
    """
    chosen = p.select(df, level.zoom, key_column)
    geom, attributes = p.geometry_column, list(p.attributes)
    layer: Column = F.lit(p.layers.name)
    if isinstance(p.layers, LayerNamesInColumn):
        if not isinstance(chosen.schema[p.layers.name].dataType, StringType):
            raise ValueError(f"layer column {p.layers.name} must be a string")
        layer = F.col(p.layers.name)
    extent = options.tile_extent or level.cols
    rows = chosen.select(
        F.explode(key_column).alias("k"), layer.alias("layer"), F.col(geom).alias("geom"), F.struct(*attributes, F.lit(0).alias("_")).alias("attributes")
    ).select("k.col", "k.row", "layer", "geom", "attributes")
    zoom, order_areas = level.zoom, options.order_areas

    plain = not _overrides(p, "clip")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(3).to_pylist()
            tile = [b.column(k).to_pylist() for k in (0, 1)]
            cols: list[list] = [[] for _ in _FEATURE]
            quick: dict[int, bytes] = {}
            known: dict[tuple[int, int], tuple] = {}
            box_of = lambda k: known.get(k) or known.setdefault(k, level.box(*k))
            if plain:  # points need no clipping: the batch is encoded at once
                rows = [k for k, g in enumerate(raw) if g is not None and len(g) == 21 and g[:5] == b"\x01\x01\0\0\0"]
                xy = np.frombuffer(b"".join(raw[k][5:] for k in rows), "<f8").reshape(-1, 2)
                boxes = np.array([box_of((tile[0][k], tile[1][k])) for k in rows], float).reshape(-1, 4)
                good = np.isfinite(xy).all(axis=1)
                quick = dict(zip(np.array(rows, int)[good].tolist(), mvt.point_shapes(xy[good], boxes[good], extent)))
            for k, (col, row, name, g, more) in enumerate(zip(*tile, b.column(2).to_pylist(), raw, b.column(4).to_pylist())):
                if g is None or name is None:
                    continue
                more.pop("_")
                if k in quick:
                    made = [(0, 0.0, quick[k])]
                else:
                    box = box_of((col, row))
                    made = mvt.shapes(p.clip(from_wkb(g), box, level), box, extent, order_areas)
                pairs = [{"k": x, "v": v} for x, v in mvt.tags(p.pack(more, zoom))] if made else []
                for order, size, shape in made:
                    for c, v in zip(cols, (col, row, name, order, size, shape, pairs)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FEATURE.values())], names=list(_FEATURE))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = (f for b in batches for f in zip(*(c.to_pylist() for c in b.columns)))
        done: list[tuple[int, int, bytes]] = []
        held = 0
        for (col, row), tile in itertools.groupby(features, lambda f: f[:2]):
            layers = []
            for name, group in itertools.groupby(tile, lambda f: f[2]):
                layer = mvt.LayerWriter(name, extent)
                for f in group:
                    layer.add(f[5], ((x["k"], x["v"]) for x in f[6]))
                layers.append(layer.done())
            done.append((col, row, mvt.joined(layers)))
            held += len(done[-1][2])
            if len(done) == 1000 or held > 4 << 20:
                yield _packed(zoom, done)
                done, held = [], 0
        if done:
            yield _packed(zoom, done)

    schema = "col int, row int, layer string, kind int, area double, shape binary, tags array<struct<k:string,v:binary>>"
    # Tiles and their layers follow each other in their task, features by kind and falling area: only encoded bytes are held.
    met = rows.mapInArrow(encode, schema).repartition("col", "row").sortWithinPartitions("col", "row", "layer", "kind", F.desc("area"))
    return met.mapInArrow(join, "zoom int, col int, row int, mvt binary")


def _packed(zoom: int, tiles: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols, rows, made = zip(*tiles)
    return pa.record_batch([pa.array([zoom] * len(tiles), pa.int32()), pa.array(cols, pa.int32()), pa.array(rows, pa.int32()), pa.array(made, pa.binary())], names=["zoom", "col", "row", "mvt"])


_FEATURE = {
    "col": pa.int32(), "row": pa.int32(), "layer": pa.string(), "kind": pa.int32(), "area": pa.float64(), "shape": pa.binary(),
    "tags": pa.list_(pa.struct([("k", pa.string()), ("v", pa.binary())])),
}


def make_tiles(df: DataFrame, pipeline: Pipeline, options: Options) -> Iterator[DataFrame]:
    """Tiles of each level, from the highest zoom down, after ``finalize`` was called with them.

    Geometries are keyed at the highest zoom; each further level halves the keys as often as
    zooms differ.
    """
    levels = sorted(options.levels, key=lambda x: -x.zoom)
    if not levels or len({x.zoom for x in levels}) < len(levels):
        raise ValueError("levels must have different zooms")
    if any(x.cols != x.rows for x in levels):
        raise ValueError("levels must be square")
    geom = pipeline.geometry_column
    if geom not in df.columns or not isinstance(df.schema[geom].dataType, BinaryType):
        raise ValueError(f"{geom} must be a column of WKB")
    if options.source_crs != options.target_crs:
        from ..geometry.udfs import st_reproject

        df = df.withColumn(geom, st_reproject(geom, F.lit(options.source_crs), F.lit(options.target_crs)))
    key = "_keys"
    while key in df.columns:
        key = "_" + key
    working, last = df.withColumn(key, key_to(levels[0])(geom)), levels[0].zoom
    kept: list[DataFrame] = []
    try:
        for level in levels:
            if level.zoom < last:
                working = working.withColumn(key, parent_keys(F.col(key), last - level.zoom))
                last = level.zoom
            working = pipeline.reduce(working, level, key)
            if options.use_caching:
                working = working.persist(StorageLevel.DISK_ONLY)
                kept.append(working)
            working = working.withColumn(geom, _simplified(pipeline, level, geom))
            tiles = _tiles_of(working, pipeline, level, key, options)
            pipeline.finalize(tiles, level.zoom)
            yield tiles
    finally:
        for x in kept:
            x.unpersist()
