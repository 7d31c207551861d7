"""Relations over time: the members that are valid are kept while a relation's times pass, never all members for each time."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..geometry.wkb import from_wkb
from ..schema import WAY

#: Bytes and rows of results that are handed on at a time.
MOST_BYTES, MOST_ROWS = 4 << 20, 4096


def _events(timeline: DataFrame, members: DataFrame, geoms: DataFrame) -> DataFrame:
    """Members with the spans of their geometries, and rows of the timeline, by relation, version and time."""
    now = F.current_timestamp()
    spans = timeline.groupBy("id", "version").agg(F.min("updated").alias("begins"), F.max("updated").alias("ends"))
    listed = members.where(F.col("type").isNotNull()).join(spans.hint("merge"), ["id", "version"])
    ways = geoms.select(
        F.lit(WAY).cast("byte").alias("type"), F.col("id").alias("ref"), F.col("updated").alias("since"), F.coalesce("validUntil", now).alias("until"), "geom",
        F.lit(True).alias("known"),
    )
    met = listed.join(ways.hint("merge"), ["type", "ref"], "left")
    # A way that is known, but at no time of the version, is dropped; a member that is no known way is there at all times.
    met = met.where(F.col("known").isNull() | (F.col("since") <= F.col("ends")) & (F.col("until") > F.col("begins")))
    micros = lambda c: F.unix_micros(c)
    member = met.select(
        "id", F.col("version").cast("int").alias("version"), F.coalesce(micros(F.col("since")), F.lit(-(1 << 62))).alias("at"), F.lit(0).alias("kind"),
        F.coalesce(micros(F.col("until")), F.lit(1 << 62)).alias("until"), "pos", F.col("ref"), F.col("type").cast("int").alias("type"), "role", "geom",
        F.lit(None).cast("long").alias("changeset"), F.lit(None).cast("int").alias("minor"),
    )
    none = {"pos": "int", "ref": "long", "type": "int", "role": "string", "geom": "binary"}
    row = timeline.select(
        "id", F.col("version").cast("int").alias("version"), micros(F.col("updated")).alias("at"), F.lit(1).alias("kind"), micros(F.col("validUntil")).alias("until"),
        *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "changeset", F.col("minorVersion").cast("int").alias("minor"),
    )
    return member.unionByName(row).repartition("id").sortWithinPartitions("id", "version", "at", "kind")


def _built(events: Iterator[tuple], build: Callable) -> Iterator[tuple]:
    """Keys, role and WKB of each row of the timeline that has members; a way of unknown geometry makes it null at once."""
    for _, group in itertools.groupby(events, lambda e: e[:2]):
        valid: dict[int, tuple] = {}
        ends: list[tuple[int, int]] = []
        unknown = 0
        for n, (id_, version, at, kind, until, pos, ref, type_, role, geom, changeset, minor) in enumerate(group):
            if kind == 0:
                valid[n] = (pos, ref, type_, role, geom)
                heapq.heappush(ends, (until, n))
                unknown += type_ == WAY and geom is None
                continue
            while ends and ends[0][0] <= at:
                _, _, t, _, g = valid.pop(heapq.heappop(ends)[1])
                unknown -= t == WAY and g is None
            if not valid:
                continue
            made = [("", None)] if unknown else build(*_members(valid.values()))
            for name, wkb in made:
                yield changeset, id_, version, minor, at, until, name, wkb


def _members(rows) -> tuple[list[int], list[str], list]:
    key = lambda m: (m[0], m[1], m[2], m[3] is not None, m[3] or "", m[4] is not None, m[4] or b"")
    rows = sorted(rows, key=key)
    return [m[2] for m in rows], [m[3] for m in rows], [from_wkb(m[4]) for m in rows]


_SCHEMA = "changeset long, id long, version int, minorVersion int, updated long, validUntil long, role string, geom binary"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def assembled(timeline: DataFrame, members: DataFrame, geoms: DataFrame, build: Callable) -> DataFrame:
    """Each row of the timeline with what ``build`` (types, roles, geometries) makes of its members: rows of role and WKB."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in _built((e for b in batches for e in zip(*(c.to_pylist() for c in b.columns))), build):
            held.append(r)
            size += len(r[-1] or b"")
            if len(held) == MOST_ROWS or size > MOST_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    out = _events(timeline, members, geoms).mapInArrow(run, _SCHEMA)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("updated", "validUntil")})
