"""Feeds from a local tree: batch, stream, checkpoints, gaps and errors."""

import datetime as dt
import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from terrachron.functions import time as seq
from terrachron.sources import feeds, replication
from terrachron.sources.datasources import register
from terrachron.sources.elements import read_osm_xml

CHANGE = """<osmChange><create><node id="{n}" version="1" timestamp="2020-01-01T00:00:0{s}Z" changeset="5" uid="7" user="u" lat="1.5" lon="2.5"><tag k="a" v="b"/></node></create>
<modify><way id="9" version="2" timestamp="2020-01-01T00:00:00Z" changeset="5"><nd ref="1"/><nd ref="2"/></way></modify>
<delete><relation id="3" version="3" timestamp="2020-01-01T00:00:00Z" changeset="6"><member type="way" ref="9" role="outer"/><member type="x" ref="1" role=""/></relation></delete></osmChange>"""
SETS = """<osm><changeset id="1" created_at="2020-01-01T00:00:00Z" open="true" uid="4" user="q" comments_count="1"><tag k="comment" v="hi"/>
<discussion><comment date="2020-01-02T00:00:00Z" uid="5" user="r"><text>hello</text></comment></discussion></changeset>
<changeset id="2" created_at="2020-01-01T00:00:00Z" closed_at="2020-01-01T01:00:00Z" open="false" min_lat="1" max_lat="2" min_lon="3" max_lon="4" num_changes="8"/></osm>"""


def put(path, data: bytes):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture
def feed(tmp_path):
    replication._memo.clear()
    for n in range(1, 6):
        put(tmp_path / f"000/000/00{n}.osc.gz", gzip.compress(CHANGE.format(n=n, s=n).encode()))
        put(tmp_path / f"000/000/00{n}.osm.gz", gzip.compress(SETS.encode()))
    (tmp_path / "state.txt").write_text("#c\nsequenceNumber=5\ntimestamp=2020-01-01T00\\:00\\:00Z\n")
    (tmp_path / "state.yaml").write_text("---\nlast_run: 2020-01-01 00:05:00.000000000 Z\nsequence: 5\n")
    return tmp_path


def test_changes_batch(spark, feed):
    register(spark)
    df = spark.read.format("changes").option("base_uri", f"file://{feed}").option("start_sequence", 1).option("end_sequence", 4).load()
    rows = df.orderBy("sequence", "id").collect()
    assert len(rows) == 9 and {r.sequence for r in rows} == {1, 2, 3}
    node = next(r for r in rows if r.type == "node" and r.sequence == 1)
    assert (node.lat, node.tags, node.nds, node.visible) == (1.5, {"a": "b"}, None, True)
    way = next(r for r in rows if r.type == "way")
    assert [n.ref for n in way.nds] == [1, 2] and way.uid == -1 and way.user == ""
    relation = next(r for r in rows if r.type == "relation")
    assert [(m.type, m.role) for m in relation.members] == [(2, "outer"), (0, "")] and not relation.visible
    assert spark.read.format("changes").option("base_uri", f"file://{feed}").option("start_sequence", 2).load().count() == 12


def test_changesets_batch(spark, feed):
    register(spark)
    df = spark.read.format("changesets").option("base_uri", f"file://{feed}").option("start_sequence", 1).option("end_sequence", 2).load()
    a, b = df.orderBy("id").collect()
    assert a.open and a.closedAt is None and a.minLat is None and a.numChanges == 0 and a.comments[0].body == "hello"
    assert b.maxLon == 4.0 and b.numChanges == 8 and b.commentsCount == 0 and b.comments == []


def test_augmented_diffs(spark, feed):
    def feature(side, version, geometry):
        p = {"id": "1", "type": "way", "tags": {"a": "b"}, "nds": [1, 2], "changeset": "3", "timestamp": "2020-01-01T00:00:00Z", "uid": "4", "user": "u", "version": version, "augmentedDiff": 1}
        return {"type": "Feature", "id": side, "properties": p, "geometry": geometry}

    point = {"type": "Point", "coordinates": [1, 2]}
    lines = [
        {"type": "FeatureCollection", "features": [feature("new", 1, point)]},
        {"type": "FeatureCollection", "features": [feature("old", 1, point), feature("new", 1, point)]},
        {"type": "FeatureCollection", "features": [feature("old", 1, point), feature("new", 2, {"type": "Polygon", "coordinates": [[[0, 0]]]})]},
    ]
    put(feed / "000/000/001.json.gz", gzip.compress("\n".join("\x1e" + json.dumps(x) for x in lines).encode()))
    register(spark)
    df = spark.read.format("augmented-diffs").option("base_uri", f"file://{feed}").option("start_sequence", 1).option("end_sequence", 2).load()
    rows = df.collect()
    assert [(r.prevVersion, r.version, r.minorVersion) for r in rows] == [(None, 1, False), (1, 1, True), (1, 2, False)]
    assert rows[0].geom is not None and rows[2].geom is None and rows[0].prevNds is None and rows[1].prevNds == [1, 2]
    seen = []
    data = gzip.decompress((feed / "000/000/001.json.gz").read_bytes())
    list(feeds.read_augmented_diffs(data, 1, lambda s, f: seen.append((s, f["id"]))))
    assert seen == [(1, "new")]
    with pytest.raises(ValueError):
        list(feeds.read_augmented_diffs(b'{"features": []}', 1))
    with pytest.raises(Exception, match="base_uri"):
        spark.read.format("augmented-diffs").load().collect()


def test_missing_sequence(feed):
    (feed / "000/000/003.osc.gz").unlink()
    assert feeds.fetch("changes", f"file://{feed}", 3, 2, 0, None) == []
    with pytest.raises(replication.Missing):
        feeds.fetch("changes", f"file://{feed}", 9, 1, 0, None)


def test_stream_with_limit_end_and_checkpoint(spark, feed, tmp_path):
    register(spark)
    db = f"sqlite://{tmp_path}/c.db"
    replication.Checkpoints(db).put("p", 1)

    def run(end, name):
        out, check = str(tmp_path / "out"), str(tmp_path / "check")
        df = spark.readStream.format("changes").options(base_uri=f"file://{feed}", proc_name="p", db_uri=db, batch_size="2", end_sequence=str(end), retry_delay="0").load()
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="500 milliseconds").start()
        for _ in range(120):
            q.awaitTermination(0.5)
            if q.lastProgress and re.findall(r"\d+", str(q.lastProgress["sources"][0]["endOffset"])) == [str(end)]:
                break
        q.processAllAvailable()
        q.stop()
        return sorted(r[0] for r in spark.read.parquet(out).select("sequence").distinct().collect())

    assert run(4, "a") == [2, 3, 4]
    assert run(5, "b") == [2, 3, 4, 5]
    assert replication.Checkpoints(db).get("p") in (4, 5)


def test_small_parsers(tmp_path):
    assert replication.sequence_path(3700047, ".osc.gz") == "003/700/047.osc.gz"
    assert replication.parse_properties("a=1\\:2\n# x\n") == {"a": "1:2"}
    assert replication.parse_time("2020-01-02 03:04:05.123456789 +01:00") == dt.datetime(2020, 1, 2, 2, 4, 5, 123456, dt.timezone.utc)
    got = replication.connection_arguments("postgresql://h:5432/db?user=a&password=b%20c")
    assert got == {"host": "h", "dbname": "db", "port": 5432, "user": "a", "password": "b c"}
    assert feeds.element_id(1, 5) == "n5" and feeds.element_id(9, 5) == "5"
    store = replication.Checkpoints(f"file://{tmp_path}/c.json")
    assert store.get("x") is None
    store.put("x", 4)
    assert store.get("x") == 4


def test_find_changeset_sequence(feed):
    for n in range(1, 6):
        (feed / f"000/000/00{n}.state.txt").write_text(f"last_run: 2020-01-01 00:0{n}:00 Z\nsequence: {n}\n")
    at = dt.datetime(2020, 1, 1, 0, 2, 30)
    assert feeds.find_changeset_sequence(f"file://{feed}", at) == 3


def test_sequence_time(spark):
    assert seq.sequence_of(seq.time_of(3700047)) == 3700047
    df = spark.createDataFrame([(3700047,)], "s int")
    assert df.select(seq.sequence_of_column(seq.time_of_column(F.col("s")))).first()[0] == 3700047


def test_osm_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        '<osm><node id="1" lat="1" lon="2" version="1" changeset="1" timestamp="2020-01-01T00:00:00Z" user="u" uid="1" visible="true"><tag k="a" v="b"/></node>'
        '<way id="2" version="1" changeset="1" timestamp="2020-01-01T00:00:00Z" user="u" uid="1" visible="true"><nd ref="1"/></way></osm>'
    )
    rows = read_osm_xml(spark, str(tmp_path / "a.osm")).orderBy("id").collect()
    assert [r.type for r in rows] == ["node", "way"] and rows[0].tags == {"a": "b"} and rows[1].nds[0].ref == 1


def test_memory_does_not_grow_with_a_file(tmp_path):
    """Rows come as the file is read: changes, changesets and diffs of 30 MB and more."""
    import tracemalloc

    change = '<create><node id="1" version="1" timestamp="2020-01-01T00:00:00Z" changeset="5" lat="1" lon="2"><tag k="a" v="' + "b" * 900 + '"/></node></create>'
    changeset = '<changeset id="1" created_at="2020-01-01T00:00:00Z" open="true"><tag k="comment" v="' + "b" * 900 + '"/></changeset>'
    diff = json.dumps({"features": [{"type": "Feature", "id": "new", "properties": {"id": "1", "type": "way", "tags": {"a": "b" * 900}}, "geometry": None}]})
    n = 30_000
    for feed, suffix, text, head, tail in (
        ("changes", ".osc.gz", change, "<osmChange>", "</osmChange>"), ("changes", ".osc.gz", change[8:-9], "<osmChange><create>", "</create></osmChange>"),
        ("changesets", ".osm.gz", changeset, "<osm>", "</osm>"), ("augmented-diffs", ".json.gz", diff, "", ""),
    ):
        put(tmp_path / f"000/000/001{suffix}", gzip.compress((head + "\n".join([text] * n) + tail).encode(), 1))
        tracemalloc.start()
        found = feeds.opened(feed, f"file://{tmp_path}", 1, 0, 0)
        assert sum(1 for _ in feeds.rows_of(feed, found, 1)) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 5e6, feed
