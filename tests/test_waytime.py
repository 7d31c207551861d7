"""Ways over time in one shuffle, against the join step by step; small rings against the test for large ones."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.geometry import planar
from terrachron.operators import history, waytime
from terrachron.schema import ELEMENT_DDL


@pytest.fixture(scope="module")
def elements(spark):
    """Few nodes and ways with many versions: equal and disordered times, deletions, shared changesets, repeated nodes."""
    r, rows = random.Random(7), []
    at = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    for n in range(12):
        day = 0
        for v in range(1, 9):
            day += r.choice((0, 1, 5, -2))
            gone = r.random() < 0.15
            rows.append((n, "node", {}, None if gone else r.randint(0, 3), None if gone else r.randint(0, 3), None, None, r.randint(1, 40), at(day), 1, "u", v, not gone))
    for w in range(8):
        day = 0
        for v in range(1, 6):
            day += r.choice((0, 2, 6, -1))
            gone = v > 1 and r.random() < 0.3
            nds = [(r.randint(0, 13),) for _ in range(r.randint(1, 5))]
            tags = {} if gone else r.choice(({"building": "yes"}, {"highway": "path"}))
            rows.append((w, "way", tags, None, None, None if gone else nds + nds[:1], None, r.randint(1, 40), at(day), 1, "u", v, not gone))
    df = spark.createDataFrame(rows, ELEMENT_DDL.replace("DECIMAL(9,7)", "INT").replace("DECIMAL(10,7)", "INT"))
    return df.withColumns({"lat": F.col("lat").cast("decimal(9,7)"), "lon": F.col("lon").cast("decimal(10,7)")}).localCheckpoint()


def test_one_shuffle_gives_what_the_joins_give(elements, monkeypatch):
    monkeypatch.setattr(waytime, "BLOCK", 7)
    ways = history.preprocess_ways(elements)
    columns = ["id", "version", "changeset", "updated", "validUntil", "minorVersion", "geom", "geometryChanged", "tags", "visible"]
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    joined = history.reconstruct_way_geometries(elements, elements, history.nodes_to_ways(ways))
    found = rows(history.reconstruct_way_geometries(elements, elements), *columns)
    assert len(found) > 50 and found == rows(joined, *columns)
    moved = history.moved_nodes(elements)
    assert rows(waytime.way_times(ways, moved), *columns[:6]) == rows(joined, *columns[:6])
    lines = waytime.way_lines(ways, moved).select("*", F.explode("vertices").alias("v")).select("id", "version", "changeset", "updated", "isArea", "v.idx", "v.lon", "v.lat")
    steps = history.way_vertices(history.way_timeline(ways, moved), ways, moved)
    assert rows(lines, *lines.columns) == rows(steps, *lines.columns)


def test_nothing_goes_through_the_driver(elements):
    geoms = history.reconstruct_way_geometries(elements, elements)
    plan = history.reconstruct_relation_geometries(elements, geoms)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_ways_are_whole(elements):
    import pyarrow as pa

    batches = [pa.record_batch({"id": ids}) for ids in ([1, 1], [1], [1, 2, 2, 3], [3], [], [4])]
    assert [t["id"].to_pylist() for t in waytime._whole(iter(batches))] == [[1, 1, 1, 1, 2, 2], [3, 3], [4]]


def test_small_rings(monkeypatch):
    r = np.random.default_rng(3)
    rings = [np.vstack([c, c[:1]]) for c in (r.integers(0, 5, (n, 2)).astype(float) for n in r.integers(1, 8, 3000).tolist())]
    small = [planar.is_simple_ring(c) for c in rings]
    monkeypatch.setattr(planar, "SMALL_RING", 0)
    assert small == [planar.is_simple_ring(c) for c in rings] and 100 < sum(small) < 2900


def test_relations_as_their_members_change(spark, elements):
    """Members of each time are those that the join of all members with all times gives."""
    from terrachron.geometry.udfs import build_multipolygon, build_routes

    r = random.Random(5)
    at = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    rows = []
    for n in range(6):
        for v in (1, 2):
            members = [(r.choice(("way", "way", "node")), r.randint(0, 8), r.choice(("", "outer", "inner", "x"))) for _ in range(r.randint(0, 3))]
            rows.append((n, "relation", {"type": ("route", "multipolygon")[n % 2]}, None, None, None, members, 100 + 2 * n + v, at(3 * v + n), 1, "u", v, True))
    relations = history.preprocess_relations(spark.createDataFrame(rows, ELEMENT_DDL))
    geoms = history.reconstruct_way_geometries(elements, elements).localCheckpoint()
    timeline = history.relation_timeline(relations, geoms)
    listed = F.sort_array(F.collect_list(F.struct("pos", "ref", "type", "role", "geom"))).alias("members")
    joined = history.with_member_geometries(history.relation_members(timeline, relations), geoms).where("type is not null")
    show = lambda df: sorted(map(str, df.select("id", "changeset", "version", "minorVersion", "updated", "validUntil", "geom").collect()))
    grouped = joined.groupBy(*history.KEYS).agg(listed)
    want = grouped.where("id % 2 = 0").select("*", F.explode(build_routes("members")).alias("p")).withColumn("geom", F.col("p.geom"))
    found = show(history.reconstruct_routes(relations, geoms))
    assert found == show(want) and any("geom=bytearray" in x or "geom=b" in x for x in found) and any("geom=None" in x for x in found)
    used = joined.where(F.col("role").isin("", "outer", "inner")).groupBy(*history.KEYS).agg(listed).where("id % 2 = 1")
    assert show(history.reconstruct_multipolygons(relations, geoms)) == show(used.withColumn("geom", build_multipolygon("members")))


def test_a_timeline_meets_relations_without_another_shuffle(elements):
    ways, moved = history.preprocess_ways(elements), history.moved_nodes(elements)
    timeline = history.way_timeline(ways, moved)
    plan = timeline._jdf.queryExecution().executedPlan().toString()
    joined = timeline.join(ways.select("id", "tags").hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    # The nodes' and ways' windows and the lookup, and one on the way; the join adds that of its other side alone.
    assert joined.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning") + 1
