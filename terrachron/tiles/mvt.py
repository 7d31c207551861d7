"""Mapbox vector tiles, version 2: a protobuf writer and a reader for tests and tools."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from ..geometry.planar import area, signed_area
from ..geometry.wkb import COLLECTION, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry, coords, is_empty, parts

Feature = tuple[Geometry, dict]
#: Kinds in the order in which a layer lists them.
ORDER = {POINT: 0, MULTIPOINT: 1, LINE: 2, MULTILINE: 3, POLYGON: 4, MULTIPOLYGON: 5}
_TYPE = {POINT: 1, MULTIPOINT: 1, LINE: 2, MULTILINE: 2, POLYGON: 3, MULTIPOLYGON: 3}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(v: object) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, (int, np.integer)):
        v = int(v)
        return _varint(4 << 3) + _varint(v & (1 << 64) - 1)
    if isinstance(v, np.float32):
        return _varint(2 << 3 | 5) + struct.pack("<f", v)
    if isinstance(v, (float, np.floating)):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def point_shapes(xy: np.ndarray, boxes: np.ndarray, extent: int) -> list[bytes]:
    """Type and geometry fields of single points [n, 2] in their tiles' boxes [n, 4]."""
    x0, y0, x1, y1 = boxes.T
    q = np.stack([(xy[:, 0] - x0) / (x1 - x0), (y1 - xy[:, 1]) / (y1 - y0)], axis=1) * extent
    q = np.floor(q + 0.5).astype(np.int64)
    known: dict[tuple[int, int], bytes] = {}
    out = []
    for at in map(tuple, ((q << 1) ^ (q >> 63)).tolist()):
        if at not in known:
            known[at] = b"\x18\x01" + _field(4, b"\x09" + _varint(at[0]) + _varint(at[1]))
        out.append(known[at])
    return out


def _commands(g: Geometry, box: tuple[float, float, float, float], extent: int) -> list[int]:
    x0, y0, x1, y1 = box
    at = np.zeros(2, int)
    out: list[int] = []

    def grid(c) -> np.ndarray:
        c = coords(c)
        q = np.stack([(c[:, 0] - x0) / (x1 - x0), (y1 - c[:, 1]) / (y1 - y0)], axis=1) * extent
        return np.floor(q + 0.5).astype(int)

    def put(points: np.ndarray) -> None:
        nonlocal at
        for p in points:
            out.extend(_zigzag(int(d)) for d in p - at)
            at = p

    def path(q: np.ndarray, close: bool) -> None:
        q = q[np.concatenate([[True], (np.diff(q, axis=0) != 0).any(axis=1)])] if len(q) > 1 else q
        if close and len(q) > 1 and (q[0] == q[-1]).all():
            q = q[:-1]
        if len(q) < (3 if close else 2):
            return
        out.append(1 << 3 | 1)
        put(q[:1])
        out.append(len(q) - 1 << 3 | 2)
        put(q[1:])
        if close:
            out.append(1 << 3 | 7)

    simple = parts(g)
    if simple and simple[0][0] == POINT:
        out.append(len(simple) << 3 | 1)
        put(grid([b for _, b in simple]))
    for kind, body in simple:
        if kind == LINE:
            path(grid(body), False)
        elif kind == POLYGON:
            for k, r in enumerate(body):
                q = grid(r)
                # In tile coordinates, where y points down, shells have positive area, holes negative.
                if (signed_area(q) > 0) != (k == 0):
                    q = q[::-1]
                before = len(out)
                path(q, True)
                if k == 0 and len(out) == before:
                    break
    return out


#: What a feature is in a layer: (kind's order, area or 0, type and geometry fields).
Shape = tuple[int, float, bytes]


def shapes(g: Geometry | None, box: tuple[float, float, float, float], extent: int, order_areas: bool = False) -> list[Shape]:
    """A geometry as features of a tile; a collection gives one for each part, an empty or vanishing geometry none."""
    out: list[Shape] = []
    for p in [] if g is None or is_empty(g) else g[1] if g[0] == COLLECTION else [g]:
        commands = _commands(p, box, extent) if not is_empty(p) else []
        if commands:
            size = area(p) if order_areas and p[0] in (POLYGON, MULTIPOLYGON) else 0.0
            out.append((ORDER[p[0]], size, _varint(3 << 3) + _varint(_TYPE[p[0]]) + _field(4, b"".join(map(_varint, commands)))))
    return out


def tags(attributes: dict) -> list[tuple[str, bytes]]:
    """Names and encoded values of attributes; null ones are left out."""
    return [(k, _value(v)) for k, v in attributes.items() if v is not None]


#: Distinct sets of tags whose encoding is remembered.
TOLD = 1 << 16


class LayerWriter:
    """A layer of encoded features in the order they come, of which only the bytes are kept."""

    def __init__(self, name: str, extent: int) -> None:
        self.name, self.extent, self.made = name, extent, bytearray()
        self.keys: dict[str, int] = {}
        self.values: dict[bytes, int] = {}
        self.told: dict[tuple[int, ...], bytes] = {}

    def add(self, shape: bytes, pairs: Iterable[tuple[str, bytes]]) -> None:
        said = tuple(x for k, v in pairs for x in (self.keys.setdefault(k, len(self.keys)), self.values.setdefault(v, len(self.values))))
        text = self.told.get(said)
        if text is None:
            text = _field(2, b"".join(map(_varint, said))) if said else b""
            if len(self.told) < TOLD:
                self.told[said] = text
        self.made += _field(2, text + shape)

    def done(self) -> bytes:
        out = _varint(15 << 3) + _varint(2) + _field(1, self.name.encode()) + bytes(self.made)
        out += b"".join(_field(3, k.encode()) for k in self.keys) + b"".join(_field(4, v) for v in self.values)
        return out + _varint(5 << 3) + _varint(self.extent)


def assembled(name: str, features: Iterable[tuple[Shape, list[tuple[str, bytes]]]], extent: int) -> bytes:
    """A layer of encoded features: by kind, polygons by falling area if they have one."""
    out = LayerWriter(name, extent)
    for (_, _, shape), pairs in sorted(features, key=lambda f: (f[0][0], -f[0][1])):
        out.add(shape, pairs)
    return out.done()


def layer(name: str, features: Iterable[Feature], box: tuple[float, float, float, float], extent: int, order_areas: bool = False) -> bytes:
    """A layer of features by kind; polygons by falling area if ``order_areas``. Empty geometries are left out."""
    return assembled(name, [(s, tags(a)) for g, a in features for s in shapes(g, box, extent, order_areas)], extent)


def joined(layers: Iterable[bytes]) -> bytes:
    """A tile of encoded layers."""
    return b"".join(_field(3, x) for x in layers)


def tile(layers: dict[str, list[Feature]], box: tuple[float, float, float, float], extent: int, order_areas: bool = False) -> bytes:
    return joined(layer(n, f, box, extent, order_areas) for n, f in layers.items())


# --------------------------------------------------------------------------- reading


def _fields(b: bytes) -> Iterable[tuple[int, object]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            n |= (b[at] & 0x7F) << shift
            at += 1
            if not b[at - 1] & 0x80:
                return n
            shift += 7

    while at < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, b[at : at + n]
            at += n


def _ints(b: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for x in b:
        n |= (x & 0x7F) << shift
        shift += 7
        if not x & 0x80:
            out.append(n)
            n = shift = 0
    return out


def counts(b: bytes) -> dict[str, int]:
    """Layers of a tile and their numbers of features, which aren't read themselves."""
    out = {}
    for number, raw in _fields(b):
        if number == 3:
            name, n = "", 0
            for k, v in _fields(raw):
                name, n = (v.decode(), n) if k == 1 else (name, n + (k == 2))
            out[name] = n
    return out


def read(b: bytes) -> dict[str, dict]:
    """Layers of a tile: extent and features (type, attributes, paths in tile coordinates)."""
    out = {}
    for number, raw in _fields(b):
        if number != 3:
            continue
        found: dict = {"keys": [], "values": [], "raw": [], "extent": 4096}
        for k, v in _fields(raw):
            if k == 1:
                found["name"] = v.decode()
            elif k == 2:
                found["raw"].append(v)
            elif k == 3:
                found["keys"].append(v.decode())
            elif k == 4:
                ((t, x),) = _fields(v)
                found["values"].append(
                    x.decode() if t == 1 else struct.unpack("<f", x)[0] if t == 2 else struct.unpack("<d", x)[0] if t == 3
                    else bool(x) if t == 7 else x - (1 << 64) if t == 4 and x >> 63 else (x >> 1) ^ -(x & 1) if t == 6 else x
                )
            elif k == 5:
                found["extent"] = v
        features = []
        for f in found["raw"]:
            kind, tags, commands = 0, [], []
            for k, v in _fields(f):
                if k == 2:
                    tags = _ints(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = _ints(v)
            paths: list[list[tuple[int, int]]] = []
            x = y = at = 0
            while at < len(commands):
                op, n = commands[at] & 7, commands[at] >> 3
                at += 1
                if op == 7:
                    paths[-1].append(paths[-1][0])
                    continue
                for _ in range(n):
                    x += (commands[at] >> 1) ^ -(commands[at] & 1)
                    y += (commands[at + 1] >> 1) ^ -(commands[at + 1] & 1)
                    at += 2
                    if op == 1:
                        paths.append([(x, y)])
                    else:
                        paths[-1].append((x, y))
            attributes = {found["keys"][tags[i]]: found["values"][tags[i + 1]] for i in range(0, len(tags), 2)}
            features.append({"type": kind, "attributes": attributes, "paths": paths})
        out[found["name"]] = {"extent": found["extent"], "features": features}
    return out
