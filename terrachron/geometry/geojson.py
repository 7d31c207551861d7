"""Tolerant GeoJSON: features whose geometry can't be read keep their data."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

from .wkb import COLLECTION, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry, all_coords, coords, is_empty

_TYPES = {"Point": POINT, "LineString": LINE, "Polygon": POLYGON, "MultiPoint": MULTIPOINT, "MultiLineString": MULTILINE, "MultiPolygon": MULTIPOLYGON, "GeometryCollection": COLLECTION}


def from_geojson(x: dict) -> Geometry:
    """ValueError, KeyError or TypeError if it is no geometry."""
    kind = _TYPES[x["type"]]
    if kind == COLLECTION:
        return kind, [from_geojson(g) for g in x["geometries"]]
    c = x["coordinates"]
    if kind == POINT:
        return kind, (float(c[0]), float(c[1])) if c else None
    if kind == LINE:
        return kind, _line(c, 2)
    if kind == POLYGON:
        return kind, [_ring(r) for r in c]
    if kind == MULTIPOINT:
        return kind, [(POINT, (float(p[0]), float(p[1]))) for p in c]
    if kind == MULTILINE:
        return kind, [(LINE, _line(p, 2)) for p in c]
    return kind, [(POLYGON, [_ring(r) for r in p]) for p in c]


def _line(c: list, least: int) -> np.ndarray:
    out = coords([p[:2] for p in c])
    if 0 < len(out) < least:
        raise ValueError("too few points")
    return out


def _ring(c: list) -> np.ndarray:
    out = _line(c, 4)
    if len(out) and (out[0] != out[-1]).any():
        raise ValueError("a ring that isn't closed")
    return out


def to_geojson(g: Geometry) -> dict:
    kind, body = g
    name = next(k for k, v in _TYPES.items() if v == kind)
    if kind == COLLECTION:
        return {"type": name, "geometries": [to_geojson(x) for x in body]}

    def plain(k: int, b):
        if k == POINT:
            return list(b) if b else []
        if k == LINE:
            return coords(b).tolist()
        if k == POLYGON:
            return [coords(r).tolist() for r in b]
        return [plain(*x) for x in b]

    return {"type": name, "coordinates": plain(kind, body)}


def read_feature(x: dict) -> tuple[Geometry | None, dict, str | None]:
    """(geometry or None if it is absent, empty or broken; properties; id as text).

    Without properties (an object) the feature itself is broken: ValueError.
    """
    if x.get("type") != "Feature" or not isinstance(x.get("properties"), dict):
        raise ValueError("not a feature with properties")
    try:
        g = from_geojson(x["geometry"])
        g = None if is_empty(g) else g
    except (KeyError, TypeError, ValueError, IndexError):
        g = None
    return g, x["properties"], None if x.get("id") is None else str(x["id"])


def read_collection(text: str | bytes) -> list[tuple[Geometry | None, dict, str | None]]:
    """All features of a collection that can be read; others are left out."""
    x = json.loads(text)
    out = []
    for f in x.get("features", []):
        try:
            out.append(read_feature(f))
        except (ValueError, AttributeError):
            pass
    return out


def write_feature(g: Geometry | None, properties: dict, feature_id: str | None = None) -> dict:
    """A feature with its bbox; an absent geometry is an empty multipoint."""
    out = {"type": "Feature", "geometry": to_geojson(g if g is not None else (MULTIPOINT, [])), "properties": properties}
    if g is not None and len(c := all_coords(g)):
        out["bbox"] = [*c.min(0).tolist(), *c.max(0).tolist()]
    return out if feature_id is None else out | {"id": feature_id}


def write_collection(features: Iterable[tuple[Geometry | None, dict, str | None]]) -> dict:
    """A collection whose bbox covers all its features."""
    made = [write_feature(*f) for f in features]
    boxes = np.array([f["bbox"] for f in made if "bbox" in f])
    out = {"type": "FeatureCollection", "features": made}
    if len(boxes):
        out["bbox"] = [*boxes[:, :2].min(0).tolist(), *boxes[:, 2:].max(0).tolist()]
    return out
