"""Geometries as tuples, to and from little-endian WKB and WKT.

A geometry is (kind, body): point (x, y) or None; line an [n, 2] array; polygon a list of
rings; multi kinds and collections a list of geometries.
"""

from __future__ import annotations

import re
import struct

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "POINT", LINE: "LINESTRING", POLYGON: "POLYGON", MULTIPOINT: "MULTIPOINT", MULTILINE: "MULTILINESTRING", MULTIPOLYGON: "MULTIPOLYGON", COLLECTION: "GEOMETRYCOLLECTION"}
PARTS = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}
Geometry = tuple[int, object]


def coords(c) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(c, dtype="<f8").reshape(-1, 2))


def to_wkb(g: Geometry | None) -> bytes | None:
    """Canonical 2-D little-endian WKB; an empty point has NaN ordinates."""
    if g is None:
        return None
    kind, body = g
    head = struct.pack("<BI", 1, kind)
    if kind == POINT:
        return head + struct.pack("<dd", *(body if body is not None else (np.nan, np.nan)))
    if kind == LINE:
        c = coords(body)
        return head + struct.pack("<I", len(c)) + c.tobytes()
    if kind == POLYGON:
        rings = [coords(r) for r in body]
        return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in rings)
    return head + struct.pack("<I", len(body)) + b"".join(map(to_wkb, body))


def from_wkb(b: bytes | None) -> Geometry | None:
    """WKB of either byte order, 2-D (further ordinates of ISO or EWKB forms are dropped)."""
    if b is None:
        return None
    b = bytes(b)
    if len(b) == 21 and b[:5] == b"\x01\x01\0\0\0":  # most rows are plain points
        x, y = struct.unpack_from("<dd", b, 5)
        return POINT, None if x != x and y != y else (x, y)
    return _read(b, 0)[0]


def _read(b: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if b[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    extra = (1 if code & 0x80000000 else 0) + (1 if code & 0x40000000 else 0)
    code &= 0x0FFFFFFF
    kind, iso = code % 1000, code // 1000
    dims = 2 + max(extra, 2 if iso == 3 else 1 if iso else 0)

    def points(n: int) -> np.ndarray:
        nonlocal at
        c = np.frombuffer(b, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype("<f8")
        at += 8 * n * dims
        return c

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", b, at - 4)[0]

    if kind == POINT:
        c = points(1)[0]
        return (POINT, None if np.isnan(c).all() else (float(c[0]), float(c[1]))), at
    if kind == LINE:
        return (LINE, points(count())), at
    if kind == POLYGON:
        return (POLYGON, [points(count()) for _ in range(count())]), at
    if kind not in (MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
        raise ValueError(f"unknown WKB type {code}")
    parts = []
    for _ in range(count()):
        g, at = _read(b, at)
        parts.append(g)
    return (kind, parts), at


def _num(x: float) -> str:
    return repr(float(x)).removesuffix(".0")


def to_wkt(g: Geometry | None) -> str | None:
    if g is None:
        return None
    kind, _ = g
    body = _wkt_body(g)
    return f"{NAMES[kind]} {body}"


def _wkt_body(g: Geometry) -> str:
    kind, body = g
    if body is None or kind != POINT and not len(body):
        return "EMPTY"
    line = lambda c: "(" + ", ".join(f"{_num(x)} {_num(y)}" for x, y in coords(c).tolist()) + ")"
    if kind == POINT:
        return line([body])
    if kind == LINE:
        return line(body)
    if kind == POLYGON:
        return "(" + ", ".join(map(line, body)) + ")"
    if kind == COLLECTION:
        return "(" + ", ".join(map(to_wkt, body)) + ")"
    return "(" + ", ".join(map(_wkt_body, body)) + ")"


_TOKEN = re.compile(r"[A-Za-z]+|[-+0-9.eE]+|[(),]")


def from_wkt(s: str) -> Geometry:
    tokens = _TOKEN.findall(s)
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def line() -> list[tuple[float, float]]:
        out = []
        assert take() == "("
        while True:
            # Points of a multipoint may have brackets of their own.
            nested = tokens[at] == "("
            if nested:
                take()
            x, y = float(take()), float(take())
            while tokens[at] not in ",()":
                take()
            if nested:
                take()
            out.append((x, y))
            if take() == ")":
                return out

    def many(read) -> list:
        out = []
        assert take() == "("
        while True:
            out.append(read())
            if take() == ")":
                return out

    def geometry() -> Geometry:
        name = take().upper()
        kind = next(k for k, v in NAMES.items() if v == name)
        if tokens[at].upper() == "EMPTY":
            take()
            return kind, None if kind == POINT else []
        if kind == POINT:
            return kind, line()[0]
        if kind == LINE:
            return kind, coords(line())
        if kind == POLYGON:
            return kind, [coords(r) for r in many(line)]
        if kind == MULTIPOINT:
            return kind, [(POINT, p) for p in line()]
        if kind == MULTILINE:
            return kind, [(LINE, coords(c)) for c in many(line)]
        if kind == MULTIPOLYGON:
            return kind, [(POLYGON, [coords(r) for r in p]) for p in many(lambda: many(line))]
        return kind, many(geometry)

    return geometry()


def is_empty(g: Geometry) -> bool:
    kind, body = g
    return body is None or kind != POINT and (not len(body) or kind >= MULTIPOINT and all(map(is_empty, body)))


def parts(g: Geometry) -> list[Geometry]:
    """Simple geometries of a geometry, in order."""
    return [p for x in g[1] for p in parts(x)] if g[0] >= MULTIPOINT else [] if is_empty(g) else [g]


def all_coords(g: Geometry) -> np.ndarray:
    out = [coords([b]) if k == POINT else coords(b) if k == LINE else np.concatenate([coords(r) for r in b]) for k, b in parts(g)]
    return np.concatenate(out) if out else np.empty((0, 2))


def mapped(g: Geometry, f) -> Geometry:
    """The geometry with ``f`` applied to each array of coordinates."""
    kind, body = g
    if is_empty(g):
        return g
    if kind == POINT:
        return kind, tuple(f(coords([body]))[0].tolist())
    if kind == LINE:
        return kind, f(coords(body))
    if kind == POLYGON:
        return kind, [f(coords(r)) for r in body]
    return kind, [mapped(p, f) for p in body]
