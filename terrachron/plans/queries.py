"""Registered queries of the engine's own operators, each with DuckDB SQL where it can express it."""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, tags
from ..functions import time as seq
from ..geometry import udfs
from ..geometry.wkb import MULTIPOLYGON, POLYGON
from ..operators import geocode, history, waytime
from ..osm import add_user_metadata, snapshot, to_geometry
from ..tiles import grid
from ..tiles.pipeline import LayerNamesInColumn, Options, Pipeline, SimplifyToCell, SingleLayer, level_tiles
from . import derive
from .registry import QUERIES, SQL, Query, decoded, query, real, real_sql
from .derive import NODES_SQL, RELATIONS_SQL, TIMELINE_SQL, VERTICES_SQL, WAYS_SQL, table, tags_text, time_sql, time_text

# --------------------------------------------------------------------------- histories


@query(f"""WITH {NODES_SQL} SELECT id, version, changeset, visible, tags, {real_sql('lat')} AS lat, {real_sql('lon')} AS lon,
{time_sql('until')} AS valid_until, changed AS geometry_changed FROM np""")
def node_preprocess(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d))
    return df.select("id", "version", "changeset", "visible", tags_text("tags").alias("tags"), real("lat").alias("lat"), real("lon").alias("lon"), time_text("validUntil").alias("valid_until"), F.col("geometryChanged").alias("geometry_changed"))


@query(f"""WITH {NODES_SQL} SELECT id, version, {time_sql('ts')} AS since, {time_sql('until')} AS valid_until FROM np""")
def node_valid_until(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d))
    return df.select("id", "version", time_text("timestamp").alias("since"), time_text("validUntil").alias("valid_until"))


@query(f"""WITH {NODES_SQL}, e AS (SELECT * FROM nh WHERE visible AND lat0 > -45 AND lat0 < 45 AND lon0 > -90 AND lon0 < 90)
SELECT id, version, {real_sql('lat0')} AS lat, {real_sql('lon0')} AS lon,
       {time_sql('lead(ts) OVER (PARTITION BY id ORDER BY version)')} AS valid_until FROM e""")
def node_extent_filter(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d), (-90.0, -45.0, 90.0, 45.0))
    return df.select("id", "version", real("lat").alias("lat"), real("lon").alias("lon"), time_text("validUntil").alias("valid_until"))


POINTS_SQL = f"""{NODES_SQL}, ni AS (SELECT * FROM np WHERE tags NOT IN ('', 'source=survey')),
pl AS (
  SELECT changeset, id, max(version)::INTEGER AS version, max(ts) AS updated, arg_max(lon, version) AS lon, arg_max(lat, version) AS lat,
         arg_max(tags, version) AS tags, max_by({{'u': until}}, version).u AS until, arg_max(visible, version) AS visible FROM ni GROUP BY 1, 2
)"""


@query(f"""WITH {POINTS_SQL} SELECT changeset, id, version, {time_sql('updated')} AS updated, {real_sql('lon')} AS x, {real_sql('lat')} AS y,
visible FROM pl""")
def node_points_latest(spark: SparkSession, d: str) -> DataFrame:
    df = history.construct_point_geometries(derive.node_history(spark, d))
    return df.select("changeset", "id", "version", time_text("updated").alias("updated"), real(udfs.st_x("geom")).alias("x"), real(udfs.st_y("geom")).alias("y"), "visible")


@query(f"""WITH {WAYS_SQL} SELECT id, version, changeset, visible, tags, array_to_string(nds, ',') AS nds, {time_sql('until')} AS valid_until,
changed AS geometry_changed FROM wp""")
def way_preprocess(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_ways(derive.way_history(spark, d))
    return df.select("id", "version", "changeset", "visible", tags_text("tags").alias("tags"), F.array_join(F.col("nds").cast("array<string>"), ",").alias("nds"), time_text("validUntil").alias("valid_until"), F.col("geometryChanged").alias("geometry_changed"))


@query(f"""WITH {RELATIONS_SQL} SELECT id, version, changeset, kind, len(members)::INTEGER AS n_members, {time_sql('until')} AS valid_until FROM rp""")
def relation_preprocess(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_relations(derive.relation_history(spark, d))
    return df.select("id", "version", "changeset", F.col("tags")["type"].alias("kind"), F.size("members").alias("n_members"), time_text("validUntil").alias("valid_until"))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    return history.moved_nodes(derive.node_history(spark, d))


def _ways(spark: SparkSession, d: str) -> DataFrame:
    return history.preprocess_ways(derive.way_history(spark, d))


@query(f"WITH {TIMELINE_SQL} SELECT changeset, id, version, {time_sql('updated')} AS updated FROM wt")
def way_timeline(spark: SparkSession, d: str) -> DataFrame:
    df = history.way_timeline(_ways(spark, d), _moved(spark, d))
    return df.select("changeset", "id", "version", time_text("updated").alias("updated"))


@query(f"""WITH {VERTICES_SQL} SELECT changeset, id, version, count(*) AS n,
{real_sql('sum(lon)', 3)} AS sum_lon, {real_sql('sum(lat)', 3)} AS sum_lat, min(idx)::INTEGER AS first_idx FROM wv GROUP BY 1, 2, 3""")
def way_vertices(spark: SparkSession, d: str) -> DataFrame:
    ways, nodes = _ways(spark, d), _moved(spark, d)
    # All vertices of a row of the timeline come together, so that their sums need no shuffle.
    df = waytime.way_lines(ways, nodes)
    total = lambda c: F.aggregate(F.col(f"vertices.{c}"), F.lit(0.0), lambda a, x: a + x)
    return df.select("changeset", "id", "version", F.size("vertices").cast("long").alias("n"), real(total("lon"), 3).alias("sum_lon"), real(total("lat"), 3).alias("sum_lat"), F.array_min("vertices.idx").alias("first_idx"))


#: Ways whose tags say no area; whether a polygon is valid is beyond SQL (see way_shapes).
LINES_SQL = f"""{VERTICES_SQL}, wl AS (
  SELECT changeset, id, version, updated, count(*)::INTEGER AS n, bool_or(isnan(lon) OR isnan(lat) OR lon IS NULL OR lat IS NULL) AS bad,
         count(DISTINCT {{'x': lon, 'y': lat}}) AS places, list({{'x': lon, 'y': lat}} ORDER BY idx) AS xy, any_value(tags) AS tags
  FROM wv GROUP BY 1, 2, 3, 4
)"""


@query(f"""WITH {LINES_SQL} SELECT changeset, id, version, CASE WHEN bad OR (n > 1 AND places = 1) THEN NULL WHEN n = 1 THEN 'point' ELSE 'linestring' END AS kind,
CASE WHEN bad OR (n > 1 AND places = 1) THEN 0 ELSE n END AS n_points,
CASE WHEN bad OR (n > 1 AND places = 1) THEN NULL WHEN n = 1 THEN 0.0 ELSE round(list_sum(list_transform(range(1, n), lambda i: sqrt((xy[i + 1].x - xy[i].x) ** 2 + (xy[i + 1].y - xy[i].y) ** 2))), 3) END AS length
FROM wl WHERE tags NOT LIKE '%building%'""")
def way_line_stats(spark: SparkSession, d: str) -> DataFrame:
    df = history.reconstruct_way_geometries(derive.way_history(spark, d), derive.node_history(spark, d)).where(~tags.is_area("tags"))
    n = F.when(F.col("geom").isNotNull(), udfs.st_numpoints("geom")).otherwise(0)
    return df.select("changeset", "id", "version", udfs.st_geometrytype("geom").alias("kind"), n.alias("n_points"), real(udfs.st_length("geom"), 3).alias("length"))


@query(f"""WITH {VERTICES_SQL}, k AS (SELECT DISTINCT changeset, id, version, updated FROM wv)
SELECT id, version, changeset, (row_number() OVER (PARTITION BY id, version ORDER BY updated, changeset) - 1)::INTEGER AS minor_version,
{time_sql('lead(updated) OVER (PARTITION BY id ORDER BY updated, changeset)')} AS valid_until FROM k""")
def way_minor_versions(spark: SparkSession, d: str) -> DataFrame:
    df = waytime.way_times(_ways(spark, d), _moved(spark, d))
    return df.select("id", "version", "changeset", F.col("minorVersion").alias("minor_version"), time_text("validUntil").alias("valid_until"))


def _way_geometries(spark: SparkSession, d: str) -> DataFrame:
    return history.reconstruct_way_geometries(derive.way_history(spark, d), derive.node_history(spark, d))


#: Each way version as it stands in the way's own timeline; its geometry is taken as changed each time.
RELATION_TIMELINE_SQL = f"""{TIMELINE_SQL}, {RELATIONS_SQL},
rm AS (SELECT DISTINCT unnest(members).ref AS way, id, version, ts, until FROM rp),
rt AS (
  SELECT changeset, id, max(version)::INTEGER AS version, max(updated) AS updated FROM (
    SELECT wt.changeset, rm.id, rm.version, wt.updated FROM wt JOIN rm ON wt.id = rm.way
    WHERE rm.ts <= wt.updated AND wt.updated < coalesce(rm.until, now()::TIMESTAMP)
    UNION ALL SELECT changeset, id, version, ts FROM rp
  ) GROUP BY 1, 2
)"""


def _relation_timeline(spark: SparkSession, d: str) -> DataFrame:
    timeline = history.way_timeline(_ways(spark, d), _moved(spark, d)).withColumn("geometryChanged", F.lit(True))
    return history.relation_timeline(history.preprocess_relations(derive.relation_history(spark, d)), timeline)


@query(f"""WITH {RELATION_TIMELINE_SQL} SELECT changeset, id, version, {time_sql('updated')} AS updated,
(row_number() OVER (PARTITION BY id, version ORDER BY updated, changeset) - 1)::INTEGER AS minor_version,
{time_sql('lead(updated) OVER (PARTITION BY id ORDER BY updated, changeset)')} AS valid_until FROM rt""")
def relation_timeline(spark: SparkSession, d: str) -> DataFrame:
    df = _relation_timeline(spark, d)
    return df.select("changeset", "id", "version", time_text("updated").alias("updated"), F.col("minorVersion").alias("minor_version"), time_text("validUntil").alias("valid_until"))


@query(f"""WITH {RELATION_TIMELINE_SQL}, m AS (SELECT rt.changeset, rt.id, unnest(members) AS m FROM rt JOIN rp ON rt.id = rp.id AND rt.version = rp.version)
SELECT changeset, id, count(*) AS n, sum(m.ref)::BIGINT AS refs, count(*) FILTER (m.role = 'outer') AS outers FROM m GROUP BY 1, 2""")
def relation_members(spark: SparkSession, d: str) -> DataFrame:
    # Members are those of the version, so their sums are made once a version and met by its changesets.
    members = history.version_members(history.preprocess_relations(derive.relation_history(spark, d))).groupBy("id", "version")
    sums = members.agg(F.count("*").alias("n"), F.sum("ref").alias("refs"), F.count(F.when(F.col("role") == "outer", 1)).alias("outers"))
    return _relation_timeline(spark, d).join(sums, ["id", "version"]).select("changeset", "id", "n", "refs", "outers")


@query(f"""WITH {POINTS_SQL} SELECT changeset, id, version FROM pl WHERE updated <= TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-01' < coalesce(until, TIMESTAMP '2999-01-01')""")
def snapshot_points(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return snapshot(history.construct_point_geometries(derive.node_history(spark, d)), at).select("changeset", "id", "version")


@query(f"""WITH {VERTICES_SQL}, k AS (SELECT DISTINCT changeset, id, version, updated FROM wv),
v AS (SELECT *, lead(updated) OVER (PARTITION BY id ORDER BY updated, changeset) AS until FROM k)
SELECT changeset, id, version FROM v WHERE updated <= TIMESTAMP '1999-06-01' AND TIMESTAMP '1999-06-01' < coalesce(until, TIMESTAMP '2999-01-01')""")
def snapshot_ways(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(waytime.way_times(_ways(spark, d), _moved(spark, d)), F.lit("1999-06-01 00:00:00").cast("timestamp")).select("changeset", "id", "version")


@query(f"""WITH {POINTS_SQL} SELECT pl.changeset, pl.id, o_custkey AS uid, 'c' || o_custkey AS "user" FROM pl JOIN orders ON changeset = o_orderkey""")
def user_metadata(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), F.concat(F.lit("c"), F.col("o_custkey")).alias("user"))
    return add_user_metadata(history.construct_point_geometries(derive.node_history(spark, d)), sets).select("changeset", "id", "uid", "user")


@query(f"""WITH {RELATIONS_SQL}, m AS (SELECT id, version, unnest(members) AS m FROM rp)
SELECT id, version, 2::BIGINT * count(*) AS codes, count(*) FILTER (m.role <> '') AS roles FROM m GROUP BY 1, 2""")
def compress_members(spark: SparkSession, d: str) -> DataFrame:
    df = tags.ensure_compressed_members(derive.relation_history(spark, d)).select("id", "version", F.explode("members").alias("m"))
    return df.groupBy("id", "version").agg(F.sum(F.col("m.type").cast("long")).alias("codes"), F.count(F.when(F.col("m.role") != "", 1)).alias("roles"))


@query(f"""WITH {RELATIONS_SQL} SELECT id, version, array_to_string(list_transform(members, lambda m: 'way' || m.ref || m.role), ',') AS members FROM rp""")
def elaborate_members(spark: SparkSession, d: str) -> DataFrame:
    df = tags.ensure_compressed_members(derive.relation_history(spark, d)).select("id", "version", tags.elaborate_members("members").alias("m"))
    return df.select("id", "version", F.array_join(F.transform("m", lambda m: F.concat(m["type"], m["ref"], m["role"])), ",").alias("members"))


# --------------------------------------------------------------------------- tags

_CASES = [
    ("area", v) for v in ("yes", "YES", "1", "True", "yes;no", "yes ;no", "no", "0", "something", "no ; maybe")
] + [
    ("office", "architect"), ("waterway", "riverbank"), ("waterway", "canal"), ("waterway", "canal ; fuel"), ("waterway", "fuel"),
    ("aeroway", "aerodrome ; runway"), ("aeroway", "taxiway;runway"), ("building", "yes"), ("building", "No"), ("building", "farm;apartments"),
    ("type", "multipolygon"), ("type", "multipolygon ; boundary"), ("type", "route"), ("type", "Route; boundary"), ("type", "site"),
    ("amenity", "bench"), ("amenity", "bench;cafe"), ("shop", "bakery ; dairy"), ("highway", "motorway"), ("natural", "coastline ; water"),
    ("natural", "water"), ("name", "x"), ("leisure", "track"), ("junction", "roundabout"), ("addr:*", "x"), ("landuse", ""),
]


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Events with a tag of the table of cases; every seventh has a second one, every thirteenth none."""
    e = table(spark, d, "events")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in _CASES])
    one = F.element_at(pairs, (F.col("event_id") % len(_CASES) + 1).cast("int"))
    extra = F.when(F.col("event_id") % 7 == 0, F.create_map(F.lit("extra"), F.lit("x"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    t = F.when(F.col("event_id") % 13 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.map_concat(F.create_map(one["k"], one["v"]), extra))
    return e.select("event_id", t.alias("tags"))


_T_SQL = "t AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE c.k END AS k, CASE WHEN event_id % 13 = 0 THEN NULL ELSE c.v END AS v, event_id % 13 <> 0 AND event_id % 7 = 0 AS extra FROM events JOIN (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_CASES)) + ") AS c(i, k, v) ON event_id % " + str(len(_CASES)) + " = c.i), s AS (SELECT *, string_split(lower(regexp_replace(trim(v), '\\s*;\\s*', ';', 'g')), ';') AS parts FROM t)"


def _listed(key: str, values: list[str] | tuple[str, ...]) -> str:
    return f"WITH {_T_SQL} SELECT event_id, coalesce(k = '{key}' AND len(list_intersect(parts, {list(values)})) > 0, false) AS found FROM s"


def _predicate(f: Callable[[str], Column]) -> Query:
    return lambda spark, d: _tagged(spark, d).select("event_id", f("tags").alias("found"))


_AREA_ROWS = ", ".join(f"('{k}', {v if v else '[]::VARCHAR[]'})" for k, v in tags.AREA_KEYS.items())
_PREDICATES: dict[str, tuple[Callable[[str], Column], str]] = {
    "tags_is_multipolygon": (tags.is_multipolygon, _listed("type", tags.MULTIPOLYGON_TYPES)),
    "tags_is_route": (tags.is_route, _listed("type", ["route"])),
    "tags_is_coastline": (tags.is_coastline, _listed("natural", ["coastline"])),
    "tags_is_waterway": (tags.is_waterway, _listed("waterway", tags.WATERWAYS)),
    "tags_is_building": (tags.is_building, f"WITH {_T_SQL} SELECT event_id, coalesce(k = 'building' AND lower(v) NOT IN ('no', 'false', '0'), false) AS found FROM s"),
    "tags_is_poi": (tags.is_poi, f"WITH {_T_SQL} SELECT event_id, coalesce(k IN {tuple(tags.POI_KEYS)}, false) AS found FROM s"),
    "tags_is_road": (tags.is_road, f"WITH {_T_SQL} SELECT event_id, coalesce(k = 'highway', false) AS found FROM s"),
    "tags_is_tagged": (tags.is_tagged, f"WITH {_T_SQL} SELECT event_id, k IS NOT NULL AS found FROM s"),
    "tags_is_area": (tags.is_area, f"""WITH {_T_SQL}, a(key, lines) AS (VALUES {_AREA_ROWS})
SELECT event_id, CASE WHEN s.k = 'area' AND len(list_intersect(parts, ['yes', 'true', '1'])) > 0 THEN true WHEN s.k = 'area' THEN false
ELSE coalesce(len(list_filter(parts, lambda p: NOT list_contains(lines, p))) > 0, false) END AS found FROM s LEFT JOIN a ON s.k = a.key"""),
}
for _name, (_f, _sql) in _PREDICATES.items():
    QUERIES[_name], SQL[_name] = _predicate(_f), _sql


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = 1 AND l_quantity::INTEGER % 3 = 0 AS found FROM lineitem")
def is_new(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    minor = F.col("l_quantity").cast("int") % 3
    return li.select("l_orderkey", "l_linenumber", "l_partkey", tags.is_new(F.col("l_linenumber"), minor).alias("found"))


_CLEAN = [
    {"building": "yes", "created_by": "JOSM"}, {"building": "yes", "colour": "grey"}, {"colour": "grey"},
    {"highway": "motorway", "tiger:reviewed": "no"}, {"building": "yes", "CLC:something": "something"}, {"highway": "motorway", "k=v": "value"},
    {"building": "yes", "land use": "something"}, {"building": "yes", "source": "MassGIS"}, {"highway": "motorway", "source:geometry": "MassGIS"},
    {"Source": "x", "it:fvg:y": "z", "itx:fvg": "q"}, {"gnis": "1", "gnis:id": "2"},
]


def _cleaned(f: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        all_tags = F.array(*[F.create_map(*[F.lit(x) for p in t.items() for x in p]) for t in _CLEAN])
        e = table(spark, d, "events").select("event_id", F.element_at(all_tags, (F.col("event_id") % len(_CLEAN) + 1).cast("int")).alias("tags"))
        return e.select("event_id", tags_text(f(F.col("tags"))).alias("tags"))

    return run


def _cleaned_sql(dull: str, alone: str) -> str:
    rows = ", ".join(f"({i}, '{k}', '{v}')" for i, t in enumerate(_CLEAN) for k, v in t.items())
    return f"""WITH c(i, k, v) AS (VALUES {rows}), n AS (SELECT i, count(*) AS n FROM c GROUP BY 1),
kept AS (SELECT c.* FROM c JOIN n USING (i) WHERE NOT ({dull}) AND NOT ({alone})),
j AS (SELECT i, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS tags FROM kept GROUP BY 1)
SELECT event_id, coalesce(tags, '') AS tags FROM events LEFT JOIN j ON event_id % {len(_CLEAN)} = i"""


_PREFIX = "|".join(tags.UNINTERESTING_PREFIXES)
QUERIES["tags_remove_uninteresting"] = _cleaned(tags.remove_uninteresting_tags)
SQL["tags_remove_uninteresting"] = _cleaned_sql(
    f"lower(k) IN {tuple(tags.UNINTERESTING_KEYS)} OR k LIKE '%=%' OR k LIKE '% %' OR regexp_matches(lower(k), '^({_PREFIX}):')", "n = 1 AND k = 'colour'"
)
QUERIES["tags_remove_semi_interesting"] = _cleaned(tags.remove_semi_interesting_tags)
SQL["tags_remove_semi_interesting"] = _cleaned_sql("lower(k) = 'source' OR lower(k) LIKE 'source:%'", "false")


@query("""WITH p AS (SELECT user_id, event_type AS k, list_sort(list_distinct(list((event_id % 3)::VARCHAR))) AS v FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(k || '=' || array_to_string(v, ';'), ',' ORDER BY k || '=' || array_to_string(v, ';')) AS tags FROM p GROUP BY 1""")
def tags_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all events by user; a user's equal pairs are reduced once."""
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 3).cast("string").alias("v")).distinct()
    e = e.groupBy("user_id").agg(tags.reduce_tags(F.collect_list(F.create_map("event_type", "v"))).alias("t"))
    ordered = F.transform_values("t", lambda k, v: F.array_join(F.array_sort(F.split(v, ";")), ";"))
    return e.select("user_id", tags_text(ordered).alias("tags"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a=x,b=1' WHEN event_id % 3 = 1 THEN 'a=x;y,b=1,c=2' ELSE 'a=x,b=1' END AS tags FROM events""")
def tags_merge(spark: SparkSession, d: str) -> DataFrame:
    one = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("1"))
    other = F.when(F.col("event_id") % 3 == 1, F.create_map(F.lit("a"), F.lit("y"), F.lit("c"), F.lit("2"))).when(F.col("event_id") % 3 == 2, F.create_map(F.lit("a"), F.lit("x")))
    return table(spark, d, "events").select("event_id", tags_text(tags.merge_tags(one, other)).alias("tags"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ',osm' WHEN 1 THEN '' WHEN 2 THEN 'été' ELSE event_type END AS hashtags FROM events""")
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.concat(F.lit("a #"), F.upper("event_type"), F.lit(" #osm: #OSM, #1"))).when(n == 1, F.lit("#123 no tags # here")).when(n == 2, F.lit("x#Été!")).otherwise(F.concat(F.lit("#"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.array_join(tags.hashtags(text), ",").alias("hashtags"))


@query("SELECT event_id, array_to_string(string_split(lower(event_type) || ';b', ';'), '|') AS parts FROM events")
def split_delimited(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ;  B "))
    return table(spark, d, "events").select("event_id", F.array_join(tags.split_delimited_values(text), "|").alias("parts"))


@query("SELECT event_id, event_id % 5 IN (1, 2) AS found FROM events")
def array_intersects(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 5
    a = F.when(n < 4, F.array(n, F.lit(None).cast("long")))
    return table(spark, d, "events").select("event_id", maps.array_intersects(a, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("found"))


# --------------------------------------------------------------------------- maps and arrays


def _counts_text(c: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",")


_BY_USER = """SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type || ':' || n) AS counts
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"""


@query(_BY_USER)
def count_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    return e.select("user_id", _counts_text(maps.count_values("types")).alias("counts"))


@query(_BY_USER)
def counts_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.create_map("event_type", F.count("*").cast("int")).alias("m"))
    e = e.groupBy("user_id").agg(F.collect_list("m").alias("ms"))
    return e.select("user_id", _counts_text(maps.sum_counts("ms")).alias("counts"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a:1' WHEN event_id % 3 = 1 THEN 'a:3,b:5' ELSE 'a:1,c:4' END AS counts FROM events""")
def counts_merge(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 3
    other = F.when(n == 1, F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(5))).when(n == 2, F.create_map(F.lit("c"), F.lit(4)))
    return table(spark, d, "events").select("event_id", _counts_text(maps.merge_counts(F.create_map(F.lit("a"), F.lit(1)), other)).alias("counts"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ',x' ELSE event_type || ',y' END AS parts FROM events")
def flatten_set(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("event_id") % 2 == 0, F.lit("x")).otherwise(F.lit("y"))
    nested = F.array(F.array("event_type"), F.array("event_type", last), F.array(last))
    return table(spark, d, "events").select("event_id", F.array_join(maps.flatten_set(nested), ",").alias("parts"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE array_to_string(list_sort([event_type, 'zz']), ',') END AS parts FROM events")
def merge_sets(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("event_id") % 4 != 0, F.array(F.lit("zz"), F.col("event_type")))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(maps.merge_sets(F.array("event_type"), other)), ",").alias("parts"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'x' ELSE event_type || ',x' END AS parts FROM events")
def array_without(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.array_join(maps.without(F.array("event_type", F.lit("x"), F.lit("click")), "click"), ",").alias("parts"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity % 5 = 0 AS missing FROM lineitem")
def as_double(spark: SparkSession, d: str) -> DataFrame:
    c = maps.as_double(F.when(F.col("l_quantity") % 5 != 0, F.col("l_quantity").cast("decimal(9,2)")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.isnan(c).alias("missing"))


@query("SELECT event_id, floor((epoch(ts) - 1347432900) / 60)::INTEGER AS sequence, floor((epoch(ts) - 1347432900) / 60)::BIGINT * 60 + 1347432900 AS back FROM events")
def sequence_time(spark: SparkSession, d: str) -> DataFrame:
    # The wall clock of the table is taken as UTC, whatever the session's zone.
    at = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")
    zone = F.timestamp_seconds(F.unix_timestamp(F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'"), "yyyy-MM-dd HH:mm:ss z"))
    s = seq.sequence_of_column(zone)
    return table(spark, d, "events").select("event_id", s.alias("sequence"), F.unix_timestamp(seq.time_of_column(s)).alias("back"))


# --------------------------------------------------------------------------- tiles and countries

_MERCATOR_SQL = f"""{NODES_SQL}, g AS (SELECT id, version, lon, lat, {grid.RADIUS} * radians(lon) AS x, {grid.RADIUS} * ln(tan(pi() / 4 + radians(lat) / 2)) AS y
FROM np WHERE NOT isnan(lon) AND lon IS NOT NULL)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d)).where("lon is not null and not isnan(lon)")
    return df.withColumns({"x": grid.mercator_x(F.col("lon")), "y": grid.mercator_y(F.col("lat"))})


def _key_sql(zoom: int) -> str:
    n = 1 << zoom
    return (
        f"greatest(0, least({n - 1}, floor((x + {grid.HALF}) / {2 * grid.HALF} * {n})))::INTEGER AS col, "
        f"greatest(0, least({n - 1}, floor(({grid.HALF} - y) / {2 * grid.HALF} * {n})))::INTEGER AS row"
    )


@query(f"WITH {_MERCATOR_SQL} SELECT id, version, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y FROM g")
def reproject_mercator(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d)).where("lon is not null and not isnan(lon)")
    g = udfs.st_reproject(udfs.st_makepoint("lon", "lat"), F.lit("EPSG:4326"), F.lit("EPSG:3857"))
    df = df.select("id", "version", g.alias("g"))
    return df.select("id", "version", real(udfs.st_x("g"), 2).alias("x"), real(udfs.st_y("g"), 2).alias("y"))


@query(f"WITH {_MERCATOR_SQL} SELECT id, version, {_key_sql(8)} FROM g")
def tile_keys_point_z8(spark: SparkSession, d: str) -> DataFrame:
    k = grid.point_key(F.col("x"), F.col("y"), grid.zoomed(8))
    return _placed(spark, d).select("id", "version", k.alias("k")).select("id", "version", "k.col", "k.row")


@query(f"WITH {_MERCATOR_SQL}, k AS (SELECT {_key_sql(8)} FROM g) SELECT z AS zoom, col >> (8 - z) AS col, row >> (8 - z) AS row, count(*) AS n FROM k, (VALUES (8), (7), (6)) AS t(z) GROUP BY 1, 2, 3")
def tile_keys_pyramid(spark: SparkSession, d: str) -> DataFrame:
    df = _placed(spark, d).select(udfs.st_makepoint("x", "y").alias("g")).select(grid.key_to(grid.zoomed(8))("g").alias("k"))
    df = df.select(F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), grid.parent_keys(F.col("k"), 8 - z).alias("keys")) for z in (8, 7, 6)])).alias("l"))
    return df.select("l.zoom", F.explode("l.keys").alias("k")).groupBy("zoom", "k.col", "k.row").agg(F.count("*").alias("n"))


@query(f"""WITH {_MERCATOR_SQL}, k AS (SELECT x, y, version AS w, {_key_sql(5)} FROM g)
SELECT col, row, sum(w)::BIGINT AS weight, round(sum(x * w) / sum(w), 1) AS x, round(sum(y * w) / sum(w), 1) AS y FROM k GROUP BY 1, 2""")
def tile_bin_reduce(spark: SparkSession, d: str) -> DataFrame:
    df = _placed(spark, d).select("x", "y", F.col("version").alias("w"), grid.point_key(F.col("x"), F.col("y"), grid.zoomed(5)).alias("k"))
    total = F.sum("w")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("w")) / total, 1).alias(c)
    return df.groupBy("k.col", "k.row").agg(total.alias("weight"), mean("x"), mean("y"))


def _tiles(spark: SparkSession, d: str, p: Pipeline, zoom: int, extra: Column) -> DataFrame:
    df = _placed(spark, d).select(udfs.st_makepoint("x", "y").alias("geom"), "version", extra.alias("layer"))
    level = grid.zoomed(zoom)
    return level_tiles(df.withColumn("_keys", grid.key_to(level)("geom")), p, level, "_keys", Options((level,)))


class _Points(Pipeline):
    layers = SingleLayer("points")
    attributes = ("version",)


class _Layers(Pipeline):
    layers = LayerNamesInColumn("layer")


@query(f"WITH {_MERCATOR_SQL}, k AS (SELECT {_key_sql(4)} FROM g) SELECT 4 AS zoom, col, row, 'points' AS layer, count(*)::INTEGER AS n FROM k GROUP BY col, row")
def tile_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    return decoded(_tiles(spark, d, _Points(), 4, F.lit("")))


@query(f"WITH {_MERCATOR_SQL}, k AS (SELECT 'l' || (id % 3) AS layer, {_key_sql(3)} FROM g) SELECT 3 AS zoom, col, row, layer, count(*)::INTEGER AS n FROM k GROUP BY col, row, layer")
def tile_layers(spark: SparkSession, d: str) -> DataFrame:
    return decoded(_tiles(spark, d, _Layers(), 3, F.concat(F.lit("l"), F.col("id") % 3)))


def _box(x0: float, y0: float, x1: float, y1: float) -> tuple:
    return MULTIPOLYGON, [(POLYGON, [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)])]


#: Made-up countries: boxes of 30 by 20 degrees that overlap their neighbours, off the nodes' grid.
_BOXES = [(f"C{k}", -170.05 + 14 * k, -60.05 + 4 * k, -140.05 + 14 * k, -40.05 + 4 * k) for k in range(22)]
_BOX_SQL = "b(code, x0, y0, x1, y1) AS (VALUES " + ", ".join(str(b) for b in _BOXES) + ")"


@query(f"""WITH {NODES_SQL}, {_BOX_SQL} SELECT id, version, coalesce(string_agg(code, ',' ORDER BY code), '') AS countries
FROM np LEFT JOIN b ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY id, version""")
def geocode_boxes(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d))
    df = df.withColumn("geom", F.when(~F.isnan("lon"), udfs.st_makepoint("lon", "lat")))
    out = geocode.geocode(df, [(c, _box(*b)) for c, *b in _BOXES])
    return out.select("id", "version", F.array_join("countries", ",").alias("countries"))


@query(f"""WITH {NODES_SQL}, {_BOX_SQL}, c AS (SELECT DISTINCT changeset, code FROM np JOIN b ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)
SELECT changeset, string_agg(code, ',' ORDER BY code) AS countries FROM c GROUP BY 1""")
def regions_by_changeset(spark: SparkSession, d: str) -> DataFrame:
    df = history.preprocess_nodes(derive.node_history(spark, d))
    df = df.withColumn("geom", F.when(~F.isnan("lon"), udfs.st_makepoint("lon", "lat")))
    out = geocode.regions_by_changeset(geocode.geocode(df, [(c, _box(*b)) for c, *b in _BOXES]))
    return out.select("changeset", F.array_join("countries", ",").alias("countries"))


# --------------------------------------------------------------------------- beyond SQL


@query()
def union_geometry_summary(spark: SparkSession, d: str) -> DataFrame:
    """All geometries of the whole history, by element type and kind."""
    parts = derive.node_history(spark, d), derive.way_history(spark, d), derive.relation_history(spark, d)
    history_df = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    df = to_geometry(history_df, persist=False)
    return df.groupBy("_type", udfs.st_geometrytype("geom").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("geom")).alias("bytes"))


@query()
def multipolygon_build(spark: SparkSession, d: str) -> DataFrame:
    df = history.reconstruct_multipolygons(derive.relation_history(spark, d), _way_geometries(spark, d))
    return df.select("id", "version", "minorVersion", "changeset", udfs.st_geometrytype("geom").alias("kind"))


@query()
def route_build(spark: SparkSession, d: str) -> DataFrame:
    df = history.reconstruct_routes(derive.relation_history(spark, d), _way_geometries(spark, d))
    return df.select("id", "version", "minorVersion", "changeset", tags_text("tags").alias("tags"), udfs.st_geometrytype("geom").alias("kind"))


def _mercator_ways(spark: SparkSession, d: str) -> DataFrame:
    df = _way_geometries(spark, d).where("geom is not null and validUntil is null")
    return df.select("id", udfs.st_reproject("geom", F.lit("EPSG:4326"), F.lit("EPSG:3857")).alias("geom"), tags_text("tags").alias("layer"))


@query()
def way_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The current ways as clipped and simplified tiles, read back."""

    class Ways(SimplifyToCell):
        layers = LayerNamesInColumn("layer")
        attributes = ("id",)

    level = grid.zoomed(3)
    df = _mercator_ways(spark, d).withColumn("_keys", grid.key_to(level)("geom"))
    return decoded(level_tiles(df, Ways(), level, "_keys", Options((level,), tile_extent=4096)))


@query()
def way_simplify(spark: SparkSession, d: str) -> DataFrame:
    df = _mercator_ways(spark, d)
    return df.select("id", udfs.st_numpoints("geom").alias("before"), udfs.st_numpoints(udfs.st_simplify("geom", F.lit(1e6))).alias("after"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Points of a node history as of 2000, counted by tile at zoom 8."""
    at = F.lit("2000-01-01 00:00:00").cast("timestamp")
    nodes = history.latest_points(derive.node_history(spark, d)).where("lon is not null and not isnan(lon)")
    k = grid.point_key(grid.mercator_x(F.col("lon")), grid.mercator_y(F.col("lat")), grid.zoomed(8))
    return snapshot(nodes, at).groupBy(k.alias("k")).agg(F.count("*").alias("n")).select("k.col", "k.row", "n")


@query(f"""WITH {POINTS_SQL}, g AS (SELECT {grid.RADIUS} * radians(lon) AS x, {grid.RADIUS} * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM pl
WHERE lon IS NOT NULL AND NOT isnan(lon) AND updated <= TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-01-01' < coalesce(until, TIMESTAMP '2999-01-01')),
k AS (SELECT {_key_sql(8)} FROM g) SELECT col, row, count(*) AS n FROM k GROUP BY 1, 2""")
def snapshot_tiles(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


# They register further queries.
from . import feed_queries, geometry_queries  # noqa: E402, F401
