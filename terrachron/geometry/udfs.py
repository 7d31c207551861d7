"""Arrow UDFs over WKB columns, and geometry functions by name."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructType

from . import assemble, planar
from .geojson import to_geojson
from .wkb import COLLECTION, LINE, NAMES, POINT, all_coords, coords, from_wkb, from_wkt, is_empty, to_wkb, to_wkt


def _on_geometry(f: Callable, returns: DataType) -> Callable[..., Column]:
    """A vectorised UDF of a WKB column (null stays null) and further columns."""

    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        out = [None if g is None else f(from_wkb(g), *rest) for g, *rest in zip(*cols)]
        return pd.Series(out, dtype=object) if not isinstance(returns, (DoubleType,)) else pd.Series(out, dtype="float64")

    return lambda *cols: run(*[F.col(c) if isinstance(c, str) else c for c in cols])


@F.pandas_udf(BinaryType())
def _make_point(x: pd.Series, y: pd.Series) -> pd.Series:
    raw = np.empty(len(x), dtype=[("o", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")])
    raw["o"], raw["t"], raw["x"], raw["y"] = 1, POINT, x.to_numpy(float), y.to_numpy(float)
    step, data = raw.dtype.itemsize, raw.tobytes()
    return pd.Series([data[k * step : (k + 1) * step] for k in range(len(x))], dtype=object)


def st_makepoint(x: Column | str, y: Column | str) -> Column:
    """WKB of a point; null where an ordinate is null (NaN is not null)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(x.isNotNull() & y.isNotNull(), _make_point(x, y))


def way_wkb(xy: np.ndarray, n: np.ndarray, areas: np.ndarray) -> list[bytes | None]:
    """WKB of ways of n[k] vertices each; lines, which most of them are, are judged for the whole batch at once."""
    ends = np.cumsum(n)
    at = ends - n
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(at, len(xy))])
    row = np.repeat(np.arange(len(n)), n)
    unknown, endless = count(np.isnan(xy).any(axis=1)) > 0, count(~np.isfinite(xy).all(axis=1)) > 0
    moves = count((xy != xy[at[row]]).any(axis=1)) > 0
    some = n > 0
    closed = np.zeros(len(n), bool)
    closed[some] = (xy[at[some]] == xy[ends[some] - 1]).all(axis=1)
    ring = areas & (n >= 4) & closed
    line = (n > 1) & ~ring
    data, out = xy.tobytes(), []
    for k, (a, m, is_line, good) in enumerate(zip(at.tolist(), n.tolist(), line.tolist(), (~unknown & ~endless & moves).tolist())):
        if is_line:
            out.append(_LINE_HEAD + m.to_bytes(4, "little") + data[16 * a : 16 * (a + m)] if good else None)
        else:
            out.append(to_wkb(assemble.way(xy[a : a + m], bool(ring[k]))))
    return out


def _ways(lons: pa.Array, lats: pa.Array, areas: pa.Array) -> pa.Array:
    n = pa.compute.list_value_length(lons).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    xy = np.stack([c.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False) for c in (lons, lats)], axis=1).astype("<f8")
    return pa.array(way_wkb(xy, n, areas.fill_null(False).to_numpy(zero_copy_only=False)), pa.binary())


_LINE_HEAD = b"\x01\x02\0\0\0"


@F.arrow_udf(BinaryType())
def build_way(lons: pa.Array, lats: pa.Array, is_area: pa.Array) -> pa.Array:
    """WKB of a way from its vertices' ordinates in order (null: NaN) and whether its tags describe an area."""
    return _ways(lons, lats, is_area)


def _members(m) -> tuple[list[int], list[str], list]:
    return [x["type"] for x in m], [x["role"] for x in m], [from_wkb(x["geom"]) for x in m]


@F.pandas_udf(BinaryType())
def build_multipolygon(members: pd.Series) -> pd.Series:
    """WKB of a multipolygon relation from its members (structs pos, type, role, geom in order)."""
    return pd.Series([to_wkb(assemble.multipolygon(*_members(m))) for m in members], dtype=object)


@F.pandas_udf(ArrayType(StructType().add("role", StringType()).add("geom", BinaryType())))
def build_routes(members: pd.Series) -> pd.Series:
    """Roles and WKB of a route's lines; one null geometry if it can't be built."""
    out = []
    for m in members:
        got = assemble.routes(*_members(m))
        out.append([{"role": "", "geom": None}] if got is None else [{"role": r, "geom": to_wkb(g)} for r, g in got])
    return pd.Series(out, dtype=object)


st_area = _on_geometry(planar.area, DoubleType())
st_isvalid = _on_geometry(planar.is_valid, BooleanType())
st_isempty = _on_geometry(is_empty, BooleanType())


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _code(g: Column, at: int) -> Column:
    """A byte of WKB below 128, by built-in expressions."""
    return F.ascii(F.substring(g, at, 1).cast("string"))


def _kind(g: Column) -> Column:
    """The kind of a geometry by its header alone, of either byte order."""
    return (F.when(_code(g, 1) == 1, _code(g, 2)).otherwise(_code(g, 5))).cast("int")


def _is_flat(g: Column, kind: int) -> Column:
    """Whether WKB is little-endian, two-dimensional and of a kind: then its parts are at known places."""
    return F.substring(g, 1, 5) == F.lit(bytes([1, kind, 0, 0, 0]))


def st_geometrytype(c: Column | str) -> Column:
    """Lower-case name of the kind, without parsing; null for null."""
    g = _as_column(c)
    return F.when(g.isNotNull(), F.element_at(F.array(*[F.lit(NAMES[k].lower()) for k in sorted(NAMES)]), _kind(g)))


_count_points = _on_geometry(lambda g: len(all_coords(g)), IntegerType())


def st_numpoints(c: Column | str) -> Column:
    """Number of points; that of a line follows from its size, only other kinds are parsed."""
    g = _as_column(c)
    is_line = _is_flat(g, LINE)
    return F.when(is_line, ((F.length(g) - 9) / 16).cast("int")).otherwise(_count_points(F.when(~is_line, g)))


def _flat(raw: list[bytes | None], head: bytes) -> np.ndarray:
    return np.fromiter((b is not None and b[:5] == head for b in raw), bool, len(raw))


def _ordinate(place: int) -> Callable[[Column | str], Column]:
    @F.arrow_udf(DoubleType())
    def run(c: pa.Array) -> pa.Array:
        raw = c.to_pylist()
        head = bytes([1, POINT, 0, 0, 0])
        rows = np.flatnonzero(_flat(raw, head))
        out = np.full(len(raw), np.nan)
        out[rows] = np.frombuffer(b"".join([raw[k][5:21] for k in rows.tolist()]), "<f8").reshape(-1, 2)[:, place]
        for k in np.setdiff1d(np.arange(len(raw)), rows).tolist():
            if raw[k] is not None and (g := from_wkb(raw[k]))[0] == POINT and g[1]:
                out[k] = g[1][place]
        return pa.array(out, mask=np.fromiter((b is None for b in raw), bool, len(raw)))

    return lambda c: run(_as_column(c))


st_x, st_y = _ordinate(0), _ordinate(1)


@F.arrow_udf(DoubleType())
def _length(c: pa.Array) -> pa.Array:
    raw = c.to_pylist()
    rows = np.flatnonzero(_flat(raw, _LINE_HEAD))
    out = np.zeros(len(raw))
    if len(rows):
        # All lines of the batch as one path, less the ways from each to the next.
        n = np.array([(len(raw[k]) - 9) // 16 for k in rows.tolist()])
        xy = np.frombuffer(b"".join([raw[k][9:] for k in rows.tolist()]), "<f8").reshape(-1, 2)
        steps = np.hypot(*np.diff(xy, axis=0, append=np.zeros((1, 2))).T)
        own = np.repeat(np.arange(len(n)), n)
        last = np.cumsum(n)[n > 0] - 1
        steps[last] = 0.0
        out[rows] = np.bincount(own, steps, len(n))
    for k in np.setdiff1d(np.arange(len(raw)), rows).tolist():
        if raw[k] is not None:
            out[k] = planar.length(from_wkb(raw[k]))
    return pa.array(out, mask=np.fromiter((b is None for b in raw), bool, len(raw)))


def st_length(c: Column | str) -> Column:
    """Length of lines and of polygons' rings."""
    return _length(_as_column(c))


st_astext = _on_geometry(to_wkt, StringType())
st_asgeojson = _on_geometry(lambda g: json.dumps(to_geojson(g)), StringType())
st_centroid = _on_geometry(lambda g: to_wkb((POINT, planar.centroid(g))), BinaryType())
st_simplify = _on_geometry(lambda g, t: to_wkb(planar.simplify(g, t)), BinaryType())


def _reprojected(raw: list[bytes | None], sources: list[str], targets: list[str]) -> list[bytes | None]:
    """Plain points of one source and target go as one array, the rest one by one."""
    out: list[bytes | None] = [None] * len(raw)
    rows = np.empty(0, int)
    if len(set(sources)) == 1 and len(set(targets)) == 1:
        rows = np.flatnonzero(_flat(raw, bytes([1, POINT, 0, 0, 0])))
        xy = np.frombuffer(b"".join([raw[k][5:21] for k in rows.tolist()]), "<f8").reshape(-1, 2)
        some = ~np.isnan(xy).any(axis=1)
        rows, xy = rows[some], xy[some]
        if len(rows):
            data = planar.reproject((LINE, xy), sources[0], targets[0])[1].astype("<f8").tobytes()
            for k, at in zip(rows.tolist(), range(0, len(data), 16)):
                out[k] = b"\x01\x01\0\0\0" + data[at : at + 16]
    for k in np.setdiff1d(np.arange(len(raw)), rows).tolist():
        if raw[k] is not None:
            out[k] = to_wkb(planar.reproject(from_wkb(raw[k]), sources[k], targets[k]))
    return out


@F.arrow_udf(BinaryType())
def _reproject(c: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_reprojected(c.to_pylist(), a.to_pylist(), b.to_pylist()), pa.binary())


def st_reproject(c: Column | str, source: Column | str, target: Column | str) -> Column:
    """A geometry in another reference system."""
    return _reproject(*map(_as_column, (c, source, target)))


st_intersects = _on_geometry(lambda g, o: None if o is None else planar.intersects(g, from_wkb(o)), BooleanType())


def _contains(g, other: bytes | None) -> bool | None:
    """Whether a polygon holds all points of another geometry, none of them beyond its edge."""
    if other is None:
        return None
    o = from_wkb(other)
    p = all_coords(o)
    for _, body in (x for x in planar.parts(g) if x[0] == 3):
        rings = [coords(r) for r in body]
        inside = planar._inside_polygon(p, rings) | np.any([planar.on_ring(p, r) for r in rings], axis=0)
        if len(p) and inside.all():
            return True
    return False


st_contains = _on_geometry(_contains, BooleanType())


def _envelope(g):
    c = all_coords(g)
    if not len(c):
        return to_wkb((COLLECTION, []))
    (x0, y0), (x1, y1) = c.min(0), c.max(0)
    return to_wkb((3, [np.array([[x0, y0], [x0, y1], [x1, y1], [x1, y0], [x0, y0]])]))


st_envelope = _on_geometry(_envelope, BinaryType())


@F.pandas_udf(BinaryType())
def st_geomfromtext(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else to_wkb(from_wkt(x)) for x in s], dtype=object)


@F.pandas_udf(BinaryType())
def st_geomfromwkb(s: pd.Series) -> pd.Series:
    """Any WKB as the canonical one."""
    return pd.Series([None if x is None else to_wkb(from_wkb(x)) for x in s], dtype=object)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    unary = {
        "st_area": (planar.area, "double"), "st_isvalid": (planar.is_valid, "boolean"), "st_isempty": (is_empty, "boolean"), "st_astext": (to_wkt, "string"),
        "st_asgeojson": (lambda g: json.dumps(to_geojson(g)), "string"), "st_numpoints": (lambda g: len(all_coords(g)), "int"),
        "st_envelope": (_envelope, "binary"), "st_centroid": (lambda g: to_wkb((POINT, planar.centroid(g))), "binary"),
        "st_x": (lambda g: g[1][0] if g[0] == POINT and g[1] else None, "double"), "st_y": (lambda g: g[1][1] if g[0] == POINT and g[1] else None, "double"),
        "st_geometrytype": (lambda g: NAMES[g[0]].lower(), "string"),
    }
    for name, (f, returns) in unary.items():
        spark.udf.register(name, F.pandas_udf(_series(f), returns))
    binary = {
        "st_contains": (_contains, "boolean"), "st_intersects": (lambda g, o: None if o is None else planar.intersects(g, from_wkb(o)), "boolean"),
        "st_simplify": (lambda g, t: to_wkb(planar.simplify(g, float(t))), "binary"),
    }
    for name, (f, returns) in binary.items():
        spark.udf.register(name, F.pandas_udf(_series2(f), returns))
    spark.udf.register("st_reproject", _reproject)
    spark.udf.register("st_length", _length)
    spark.udf.register("st_geomfromtext", st_geomfromtext)
    spark.udf.register("st_geomfromwkb", st_geomfromwkb)
    spark.udf.register("st_makepoint", _make_point)


def _series(f):
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else f(from_wkb(g)) for g in s], dtype=object)

    return run


def _series2(f):
    def run(s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else f(from_wkb(g), x) for g, x in zip(s, o)], dtype=object)

    return run

