"""Rows of the three feeds: element changes, changesets and augmented diffs."""

from __future__ import annotations

import datetime as dt
import importlib
import io
import json
import logging
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.time import EPOCH
from ..geometry.geojson import read_feature
from ..geometry.wkb import to_wkb
from ..schema import TYPE_CODES
from .replication import Missing, join_uri, memoised, opened_uri, parse_time, parse_yaml, read_uri, retried, sequence_path, state_sequence

log = logging.getLogger(__name__)
_START = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
CHANGES, CHANGESETS, AUGMENTED_DIFFS = "changes", "changesets", "augmented-diffs"
DEFAULT_BASES = {CHANGES: "https://planet.osm.org/replication/minute/", CHANGESETS: "https://planet.osm.org/replication/changesets/"}


def _tags(e: ET.Element) -> dict[str, str]:
    return {t.get("k"): t.get("v") for t in e.findall("tag")}


def _stream(data: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(data) if isinstance(data, bytes) else data


def read_changes(data: bytes | BinaryIO, sequence: int) -> Iterator[tuple]:
    """Rows of an OsmChange document, which lists create, modify and delete blocks.

    What was read is dropped, of the document and of its blocks, so that memory doesn't grow with it.
    """
    action, root, block = "", None, None
    for event, e in ET.iterparse(_stream(data), events=("start", "end")):
        name = e.tag.lower()
        if event == "start":
            root = e if root is None else root
            if name in ("create", "modify", "delete"):
                block = e
            if name in ("create", "modify", "delete"):
                action = name
            continue
        if name in TYPE_CODES:
            if not action:
                raise ValueError(f"{name} {e.get('id')} outside of create, modify and delete")
            lat, lon, at = e.get("lat"), e.get("lon"), e.get("timestamp")
            nds = [(int(n.get("ref")),) for n in e.findall("nd")]
            members = [(TYPE_CODES.get(m.get("type"), 0), int(m.get("ref")), m.get("role")) for m in e.findall("member")]
            yield (
                int(e.get("id")), name, _tags(e), float(lat) if lat else None, float(lon) if lon else None, nds or None, members or None,
                int(e.get("changeset", -1)), parse_time(at) if at else _START, int(e.get("uid", -1)), e.get("user", ""),
                int(e.get("version", -1)), action != "delete", sequence,
            )
            if block is not None:
                block.clear()
        elif name in ("create", "modify", "delete"):
            action, block = "", None
            root.clear()


def read_changesets(data: bytes | BinaryIO, sequence: int) -> Iterator[tuple]:
    """Rows of a changeset replication document, of which no more than one changeset is in memory."""
    number = lambda s: float(s) if s else None
    time = lambda s: parse_time(s) if s else None
    root = None
    for event, e in ET.iterparse(_stream(data), events=("start", "end")):
        root = e if root is None else root
        if event == "start" or e.tag != "changeset":
            continue
        comments = [
            (time(c.get("date")), c.get("user"), int(c.get("uid")) if c.get("uid") else None, c.findtext("text") or "")
            for c in e.findall("discussion/comment")
        ]
        yield (
            int(e.get("id")), _tags(e), time(e.get("created_at")), e.get("open") == "true", time(e.get("closed_at")),
            int(e.get("comments_count") or 0), number(e.get("min_lat")), number(e.get("max_lat")), number(e.get("min_lon")),
            number(e.get("max_lon")), int(e.get("num_changes") or 0), int(e.get("uid")) if e.get("uid") else None, e.get("user"),
            comments, sequence,
        )
        root.clear()


Handler = Callable[[int, dict], None]


def load_handler(spec: str | None, options: dict[str, str]) -> Handler | None:
    """``module:attr`` of a callable (sequence, feature), or of a class with set_options and handle."""
    if not spec:
        return None
    module, _, name = spec.partition(":")
    target = getattr(importlib.import_module(module), name)
    if isinstance(target, type):
        made = target()
        if hasattr(made, "set_options"):
            made.set_options(options)
        return made.handle
    return target


def read_augmented_diffs(data: bytes | BinaryIO, sequence: int, handler: Handler | None = None) -> Iterator[tuple]:
    """Rows of lines of feature collections with ids old and new; the handler sees new features without a geometry."""
    codes = {**TYPE_CODES, "n": 1, "w": 2, "r": 3}
    for raw in _stream(data):
        line = raw.decode("utf-8").replace("\x1e", "")
        if not line.strip():
            continue
        by_id = {str(f.get("id")): f for f in json.loads(line).get("features", [])}
        if "new" not in by_id:
            raise ValueError(f"sequence {sequence}: a diff without a new feature")
        sides = {}
        for side in ("old", "new"):
            if side in by_id:
                g, p, _ = read_feature(by_id[side])
                sides[side] = (to_wkb(g), p)
                if side == "new" and g is None and handler is not None:
                    handler(sequence, by_id[side])
        geom, new = sides["new"]
        prev_geom, old = sides.get("old", (None, None))

        def both(f: Callable[[dict], object]) -> tuple:
            return (None if old is None else f(old)), f(new)

        number = lambda p, k: None if p.get(k) is None else int(p[k])
        version = both(lambda p: number(p, "version"))
        raw_type = str(new.get("type"))
        yield (
            number(new, "augmentedDiff") if new.get("augmentedDiff") is not None else sequence,
            codes.get(raw_type.lower(), 0), int(new["id"]), prev_geom, geom,
            *both(lambda p: {str(k): str(v) for k, v in (p.get("tags") or {}).items()}),
            *both(lambda p: [int(n) for n in p.get("nds") or []]),
            *both(lambda p: number(p, "changeset")), *both(lambda p: number(p, "uid")), *both(lambda p: p.get("user")),
            *both(lambda p: parse_time(p["timestamp"]) if p.get("timestamp") else None),
            *both(lambda p: True if p.get("visible") is None else bool(p["visible"])),
            *version, version[0] is not None and version[0] == version[1],
        )


def element_id(code: int, number: int) -> str:
    """n1, w1, r1; other types give the number alone."""
    return {1: "n", 2: "w", 3: "r"}.get(code, "") + str(number)


def element_id_column(code: Column | str, number: Column | str) -> Column:
    """The same of columns, by built-in expressions."""
    code, number = (F.col(c) if isinstance(c, str) else c for c in (code, number))
    letter = F.when(code == 1, "n").when(code == 2, "w").when(code == 3, "r").otherwise("")
    return F.concat(letter, number.cast("string"))


SUFFIX = {CHANGES: ".osc.gz", CHANGESETS: ".osm.gz", AUGMENTED_DIFFS: ".json.gz"}


def current_sequence(feed: str, base: str) -> int | None:
    """The feed's latest sequence; None where its state can't be read."""
    if feed == CHANGES:
        return state_sequence(base, "state.txt", "sequenceNumber")
    return state_sequence(base, "state.yaml", "sequence", attempts=5 if feed == CHANGESETS and base.startswith("http") else 1)


def opened(feed: str, base: str, sequence: int, retries: int, delay: float) -> BinaryIO | None:
    """The file of one sequence. One that stays missing is None if the feed is beyond it, else it is an error."""

    def passed() -> bool:
        now = current_sequence(feed, base)
        return now is not None and now > sequence

    uri = join_uri(base, sequence_path(sequence, SUFFIX[feed]))
    try:
        return retried(lambda: opened_uri(uri), retries, delay, passed)
    except Missing:
        if feed == CHANGESETS or passed():
            log.warning("%s is missing", uri)
            return None
        raise


def rows_of(feed: str, data: BinaryIO | None, sequence: int, handler: Handler | None = None) -> Iterator[tuple]:
    """Rows of a sequence's file, as they are read."""
    if data is None:
        return
    with data:
        if feed == CHANGES:
            yield from read_changes(data, sequence)
        elif feed == CHANGESETS:
            yield from read_changesets(data, sequence)
        else:
            yield from read_augmented_diffs(data, sequence, handler)


def fetch(feed: str, base: str, sequence: int, retries: int, delay: float, handler: Handler | None = None) -> list[tuple]:
    """Rows of one sequence, as a list."""
    return list(rows_of(feed, opened(feed, base, sequence, retries, delay), sequence, handler))


# --------------------------------------------------------------------------- changeset sequences by time


def changeset_state(base: str, sequence: int | None = None) -> tuple[int, dt.datetime]:
    """(sequence, last run) of the feed now, or of one of its sequences."""
    name = "state.yaml" if sequence is None else sequence_path(sequence, ".state.txt")
    found = parse_yaml(read_uri(join_uri(base, name)).decode())
    return int(found["sequence"]), parse_time(found["last_run"])


def find_changeset_sequence(base: str, at: dt.datetime) -> int:
    """The first sequence whose run was at or after a time, by bisection between 1 and the current one."""
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    high, last = changeset_state(base)
    if last < at:
        raise ValueError(f"{at} is after the feed's last run at {last}")
    low = 1
    while low < high:
        middle = (low + high) // 2
        try:
            _, ran = changeset_state(base, middle)
        except Missing:
            low = middle + 1
            continue
        low, high = (middle + 1, high) if ran < at else (low, middle)
    return low


def diff_sequence_now() -> int:
    return memoised("now", lambda: int((dt.datetime.now(dt.timezone.utc).timestamp() - EPOCH) // 60), 1.0)  # type: ignore[return-value]
