"""Registered queries of assembly, tiles and geometry functions on shapes whose measures SQL can tell.

Each takes its shapes from every row of a table: sides come from the row, variants from its
key, so that joined, nested, broken and invalid shapes all occur.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..geometry import udfs
from ..operators import geocode, history
from ..osm import to_geometry
from ..schema import ELEMENT_DDL, schema_of
from ..sources.elements import read_history, read_osm_xml
from ..tiles import export, grid
from ..tiles.pipeline import LayerNamesInColumn, Options, Pipeline, SimplifyToCell, level_tiles
from . import derive
from .derive import NODES_SQL, scratch, spread, table
from .registry import decoded, query, real
from .registry import text_of as _text

AT = "timestamp '2020-01-01 00:00:00'"


def _geoms(rows: DataFrame, *ways: tuple[int, Column, Column]) -> DataFrame:
    """Way geometries of each row of ``rows`` (key): (number of the way, WKT, whether there is one)."""
    parts = F.array(*[F.struct((F.col("key") * 10 + n).alias("id"), F.when(some, text).alias("text")) for n, text, some in ways])
    g = rows.select("key", F.explode(parts).alias("w")).where("w.text is not null")
    return g.select(
        F.col("key").alias("changeset"), "w.id", udfs.st_geomfromtext("w.text").alias("geom"), F.expr(AT).alias("updated"),
        F.lit(None).cast("timestamp").alias("validUntil"), F.lit(True).alias("geometryChanged"),
    )


def _relations(rows: DataFrame, kind: str, *members: tuple[int, str, Column]) -> DataFrame:
    """A relation of each row with members (number of the way, role, whether it is one)."""
    listed = F.array(*[
        F.when(some, F.struct(F.lit("way").alias("type"), (F.col("key") * 10 + n).alias("ref"), F.lit(role).alias("role"))) for n, role, some in members
    ])
    return rows.select(
        F.col("key").alias("id"), F.lit("relation").alias("type"), F.create_map(F.lit("type"), F.lit(kind)).alias("tags"),
        F.filter(listed, lambda m: m.isNotNull()).alias("members"), F.col("key").alias("changeset"), F.expr(AT).alias("timestamp"),
        F.lit(1).cast("long").alias("uid"), F.lit("u").alias("user"), F.lit(1).cast("long").alias("version"), F.lit(True).alias("visible"),
    )


_YES = F.lit


@query("""WITH s AS (SELECT p_partkey AS key, 10 + p_size AS a, 1 + p_partkey % 5 AS b, p_partkey % 4 <> 1 AS hole, p_partkey % 3 = 0 AS apart,
  p_partkey % 3 = 1 AS beside, p_partkey % 7 = 0 AS broken FROM part)
SELECT key AS id, CASE WHEN broken THEN NULL WHEN apart THEN 'multipolygon' ELSE 'polygon' END AS kind,
  CASE WHEN NOT broken THEN a * a * (CASE WHEN apart OR beside THEN 2 ELSE 1 END) - (CASE WHEN hole THEN b * b ELSE 0 END) END::DOUBLE AS area,
  CASE WHEN NOT broken THEN (CASE WHEN apart THEN 8 WHEN beside THEN 6 ELSE 4 END) * a + (CASE WHEN hole THEN 4 * b ELSE 0 END) END::DOUBLE AS length,
  CASE WHEN NOT broken THEN true END AS valid FROM s""")
def multipolygon_rings(spark: SparkSession, d: str) -> DataFrame:
    """Outer squares of two joined ways, with a hole, a second outer apart or beside, or a way that is missing from the ring."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(key.alias("key"), (F.col("p_size") + 10).alias("a"), (key % 5 + 1).alias("b"))
    key, a, b = F.col("key"), F.col("a"), F.col("b")
    hole, second, broken = key % 4 != 1, key % 3 != 2, key % 7 == 0
    x0 = F.when(key % 3 == 0, 2 * a).otherwise(a)  # the second outer: apart, or sharing an edge
    geoms = _geoms(
        rows,
        (1, _text("LINESTRING (0 0, ", a, " 0, ", a, " ", a, ")"), _YES(True)),
        (2, _text("LINESTRING (0 0, 0 ", a, ", ", a, " ", a, ")"), _YES(True)),
        (3, _text("LINESTRING (2 2, ", b + 2, " 2, ", b + 2, " ", b + 2, ", 2 ", b + 2, ", 2 2)"), hole),
        (4, _text("LINESTRING (", x0, " 0, ", x0 + a, " 0, ", x0 + a, " ", a, ", ", x0, " ", a, ", ", x0, " 0)"), second),
    )
    relations = _relations(rows, "multipolygon", (3, "inner", hole), (2, "outer", ~broken), (4, "outer", second), (1, "outer", _YES(True)))
    df = history.reconstruct_multipolygons(relations, geoms)
    g = F.col("geom")
    return df.select("id", udfs.st_geometrytype(g).alias("kind"), real(udfs.st_area(g)).alias("area"), real(udfs.st_length(g)).alias("length"), udfs.st_isvalid(g).alias("valid"))


@query("""WITH s AS (SELECT c_custkey AS key, 1 + c_custkey % 50 AS n, 1 + c_custkey % 9 AS m, c_custkey % 5 = 0 AS apart, c_custkey % 6 = 0 AS unknown FROM customer)
SELECT key AS id, 'type=route' AS tags, CASE WHEN unknown THEN NULL WHEN apart THEN 'multilinestring' ELSE 'linestring' END AS kind,
  CASE WHEN NOT unknown THEN n + m END::DOUBLE AS length FROM s
UNION ALL SELECT key, 'role=link,type=route', 'linestring', 1.0 FROM s WHERE NOT unknown""")
def route_lines(spark: SparkSession, d: str) -> DataFrame:
    """Routes of two ways, joined head to tail or turned, or apart, and one of another role; an unknown way leaves one null row."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 50 + 1).alias("n"), (F.col("c_custkey") % 9 + 1).alias("m"))
    key, n, m = F.col("key"), F.col("n"), F.col("m")
    second = F.when(key % 5 == 0, _text("LINESTRING (", n + 1, " 0, ", n + 1, " ", m, ")")).when(key % 4 == 0, _text("LINESTRING (", n, " ", m, ", ", n, " 0)"))
    geoms = _geoms(
        rows,
        (1, _text("LINESTRING (0 0, ", n, " 0)"), _YES(True)),
        (2, second.otherwise(_text("LINESTRING (", n, " 0, ", n, " ", m, ")")), _YES(True)),
        (3, _text("LINESTRING (5 5, 5 6)"), _YES(True)),
    )
    relations = _relations(rows, "route", (1, "", _YES(True)), (2, "", _YES(True)), (3, "link", _YES(True)), (4, "", key % 6 == 0))
    df = history.reconstruct_routes(relations, geoms)
    return df.select("id", derive.tags_text("tags").alias("tags"), udfs.st_geometrytype("geom").alias("kind"), real(udfs.st_length("geom")).alias("length"))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """An element history of four nodes and a way for each part: rectangles, bow-ties, lines; deleted and moved ones."""
    key, a, b = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 9 + 1
    part = table(spark, d, "part").select(key.alias("key"), a.alias("a"), b.alias("b"))
    key, a, b = F.col("key"), F.col("a"), F.col("b")
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), x.alias("x"), y.alias("y")) for n, x, y in ((1, F.lit(0), F.lit(0)), (2, a, F.lit(0)), (3, a, b), (4, F.lit(0), b))]))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of(ELEMENT_DDL)}
    same = {"changeset": key.alias("changeset"), "uid": F.lit(1).cast("long").alias("uid"), "user": F.lit("u").alias("user"), "visible": F.lit(True).alias("visible")}

    def rows(df: DataFrame, kind: str, id_: Column, version: int, at: str, **more: Column) -> DataFrame:
        cols = none | same | {"id": id_.cast("long"), "type": F.lit(kind), "version": F.lit(version).cast("long"), "timestamp": F.expr(f"timestamp '{at}'")} | more
        return df.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in schema_of(ELEMENT_DDL)])

    empty = F.expr("cast(map() as map<string,string>)")
    corners = part.select("*", corner.alias("c"))
    nodes = rows(corners, "node", key * 10 + F.col("c.n"), 1, "2020-01-01 00:00:00", tags=empty, lat=F.col("c.y"), lon=F.col("c.x"))
    moved = rows(corners.where("c.n = 2 and key % 2 = 0"), "node", key * 10 + 2, 2, "2020-03-01 00:00:00", tags=empty, lat=F.lit(0), lon=a + 1, changeset=key + 100_000_000)
    order = F.when(key % 3 == 0, F.array(*map(F.lit, (1, 3, 2, 4)))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4))))
    refs = F.when(key % 7 == 0, order).otherwise(F.concat(order, F.array(F.lit(1))))
    nds = F.transform(refs, lambda n: F.struct((key * 10 + n).cast("long").alias("ref")))
    tags = F.when(key % 5 == 0, F.create_map(F.lit("highway"), F.lit("path"))).otherwise(F.create_map(F.lit("building"), F.lit("yes")))
    ways = rows(part, "way", key, 1, "2020-02-01 00:00:00", tags=tags, nds=nds)
    return nodes.unionByName(moved).unionByName(ways)


@query("""WITH s AS (SELECT p_partkey AS key, p_size AS a, 1 + p_partkey % 9 AS b, p_partkey % 3 = 0 AS bow, p_partkey % 7 = 0 OR p_partkey % 5 = 0 AS line,
  p_partkey % 7 = 0 AS open FROM part),
v AS (SELECT *, a AS a2, 0 AS minor FROM s UNION ALL SELECT *, a + 1, 1 FROM s WHERE key % 2 = 0),
p AS (SELECT *, sqrt((a2 - a) ** 2 + b * b)::DOUBLE AS side, sqrt(a * a + b * b)::DOUBLE AS one, sqrt(a2 * a2 + b * b)::DOUBLE AS two FROM v)
SELECT key AS id, CASE WHEN minor = 1 THEN key + 100000000 ELSE key END AS changeset, minor AS minor_version, CASE WHEN line THEN 'linestring' WHEN bow THEN NULL ELSE 'polygon' END AS kind,
  CASE WHEN line THEN 0.0 WHEN NOT bow THEN (a + a2) * b / 2.0 END::DOUBLE AS area,
  CASE WHEN line OR NOT bow THEN round(CASE WHEN bow THEN one + side + two + (CASE WHEN open THEN 0 ELSE b END) ELSE a2 + side + a + (CASE WHEN open THEN 0 ELSE b END) END, 6) + 0.0 END AS length,
  CASE WHEN line AND open THEN 4 WHEN line OR NOT bow THEN 5 END AS n_points, minor = 1 OR key % 2 = 1 AS last FROM p""")
def way_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Ways of all kinds from an element history: polygons and their validity, lines, and what a node's move makes of them."""
    elements = _shapes(spark, d)
    df = history.reconstruct_way_geometries(elements, elements)
    g = F.col("geom")
    return df.select(
        "id", "changeset", F.col("minorVersion").alias("minor_version"), udfs.st_geometrytype(g).alias("kind"), real(udfs.st_area(g)).alias("area"),
        real(udfs.st_length(g)).alias("length"), udfs.st_numpoints(g).alias("n_points"), F.col("validUntil").isNull().alias("last"),
    )


def _with_relations(spark: SparkSession, d: str) -> DataFrame:
    """The shapes, with a tag on each first corner and a multipolygon of each way that isn't a bow-tie."""
    key = F.col("p_partkey")
    part = table(spark, d, "part").select(key.alias("key"))
    elements = _shapes(spark, d)
    first = (F.col("type") == "node") & (F.col("id") % 10 == 1)
    elements = elements.withColumn("tags", F.when(first, F.create_map(F.lit("amenity"), F.lit("cafe"))).otherwise(F.col("tags")))
    key = F.col("key")
    none = {f.name: F.lit(None) for f in schema_of(ELEMENT_DDL)}
    cols = none | {
        "id": key, "type": F.lit("relation"), "tags": F.create_map(F.lit("type"), F.when(key % 3 == 0, "site").otherwise("multipolygon")),
        "members": F.array(F.struct(F.lit("way").alias("type"), key.alias("ref"), F.lit("outer").alias("role"))), "changeset": key + 200_000_000,
        "timestamp": F.expr("timestamp '2020-02-15 00:00:00'"), "uid": F.lit(1), "user": F.lit("u"), "version": F.lit(1), "visible": F.lit(True),
    }
    return elements.unionByName(part.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in schema_of(ELEMENT_DDL)]))


@query("""WITH s AS (SELECT p_partkey AS key, p_partkey % 3 = 0 AS bow, p_partkey % 7 = 0 OR p_partkey % 5 = 0 AS line, p_partkey % 2 = 0 AS moved FROM part)
SELECT key AS id, key + 200000000 AS changeset, 0 AS minor_version, NOT (moved AND (line OR NOT bow)) AS last FROM s
UNION ALL SELECT key, key + 100000000, 1, true FROM s WHERE moved AND (line OR NOT bow)""")
def relation_moves(spark: SparkSession, d: str) -> DataFrame:
    """Changesets that touched a relation: its own, and those that changed a member's shape. A way that stays invalid doesn't change."""
    elements = _with_relations(spark, d)
    ways = history.reconstruct_way_geometries(elements, elements)
    df = history.relation_timeline(history.preprocess_relations(elements), ways)
    return df.select("id", "changeset", F.col("minorVersion").alias("minor_version"), F.col("validUntil").isNull().alias("last"))


@query("""WITH s AS (SELECT p_partkey AS key, p_partkey % 3 = 0 AS bow, p_partkey % 7 = 0 OR p_partkey % 5 = 0 AS line, p_partkey % 7 = 0 AS open, p_partkey % 2 = 0 AS moved FROM part),
v AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE moved),
g AS (SELECT 1 AS type, key AS changeset, key * 10 + 1 AS id, 'point' AS kind, true AS last FROM s
UNION ALL SELECT 2, CASE WHEN n = 1 THEN key + 100000000 ELSE key END, key, CASE WHEN line THEN 'linestring' WHEN bow THEN NULL ELSE 'polygon' END, n = 1 OR NOT moved
  FROM s, (VALUES (0), (1)) AS t(n) WHERE n = 0 OR moved
UNION ALL SELECT 3, CASE WHEN n = 1 THEN key + 100000000 ELSE key + 200000000 END, key, CASE WHEN open THEN NULL ELSE 'polygon' END, n = 1 OR NOT moved
  FROM s, (VALUES (0), (1)) AS t(n) WHERE NOT bow AND (n = 0 OR moved))
SELECT type::INTEGER AS type, changeset, id, kind, last FROM g""")
def history_geometries(spark: SparkSession, d: str) -> DataFrame:
    """Points, ways and multipolygons of one history, in one table."""
    df = to_geometry(_with_relations(spark, d), persist=False)
    return df.select(F.col("_type").cast("int").alias("type"), "changeset", "id", udfs.st_geometrytype("geom").alias("kind"), F.col("validUntil").isNull().alias("last"))


def _ring(*points: tuple[float, float]) -> list[list[float]]:
    return [list(p) for p in (*points, points[0])]


#: Made-up countries as GeoJSON: a triangle, a square with a hole, and two islands; one without a code.
_COUNTRIES = json.dumps({"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"ADM0_A3": "TRI"}, "geometry": {"type": "Polygon", "coordinates": [_ring((0, 0), (60, 0), (0, 60))]}},
    {"type": "Feature", "properties": {"ADM0_A3": "HOL"}, "geometry": {"type": "Polygon", "coordinates": [_ring((10, 10), (90, 10), (90, 90), (10, 90)), _ring((30, 30), (50, 30), (50, 50), (30, 50))]}},
    {"type": "Feature", "properties": {"ADM0_A3": "ISL"}, "geometry": {"type": "MultiPolygon", "coordinates": [[_ring((70, 0), (80, 0), (80, 5), (70, 5))], [_ring((0, 70), (5, 70), (5, 80), (0, 80))]]}},
    {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [_ring((0, 0), (99, 0), (99, 99))]}},
]})


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey * 37 % 100 + 0.3 AS x, c_custkey * 61 % 89 + 0.4 AS y FROM customer)
SELECT id, concat_ws(',', CASE WHEN x > 10 AND x < 90 AND y > 10 AND y < 90 AND NOT (x > 30 AND x < 50 AND y > 30 AND y < 50) THEN 'HOL' END,
  CASE WHEN (x > 70 AND x < 80 AND y < 5) OR (x < 5 AND y > 70 AND y < 80) THEN 'ISL' END, CASE WHEN x + y < 60 THEN 'TRI' END) AS countries FROM p""")
def geocode_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Countries from GeoJSON (a triangle, one with a hole, islands) of points of all customers."""
    k = F.col("c_custkey")
    df = spread(spark, d, "customer", "c_custkey").select(k.alias("id"), udfs.st_makepoint(k * 37 % 100 + F.lit(0.3), k * 61 % 89 + F.lit(0.4)).alias("geom"))
    return geocode.geocode(df, geocode.read_countries(_COUNTRIES)).select("id", F.array_join("countries", ",").alias("countries"))


@query("""WITH s AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 40) / 10.0 + 0.05 AS e FROM supplier)
SELECT id, CASE WHEN e < 2 THEN 2 WHEN 20 * e / sqrt(900 + e * e) < 2 THEN 3 ELSE 5 END AS n FROM s""")
def line_simplify(spark: SparkSession, d: str) -> DataFrame:
    """Lines with two spikes at a tolerance of 2: none, the first or both stay, by their height."""
    e = (F.col("s_suppkey") * 7 % 40) / 10.0 + F.lit(0.05)
    text = _text("LINESTRING (0 0, 10 ", e, ", 20 0, 30 ", e, ", 40 0)")
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), udfs.st_geomfromtext(text).alias("g"))
    return df.select("id", udfs.st_numpoints(udfs.st_simplify("g", F.lit(2.0))).alias("n"))


class _Lines(SimplifyToCell):
    layers = LayerNamesInColumn("layer")
    attributes = ("id",)


_LINE = "(CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END)"


@query(f"""WITH s AS (SELECT c_custkey AS id, {_LINE} AS layer, (c_custkey * 13 % 256) AS i, 1 + c_custkey % 40 AS n, (c_custkey * 29 % 256) AS row FROM customer),
t AS (SELECT layer, row, unnest(range(i, least(i + n, 255) + 1)) AS col FROM s)
SELECT 8 AS zoom, col::INTEGER AS col, row::INTEGER AS row, layer, count(*)::INTEGER AS n FROM t GROUP BY ALL""")
def line_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of level lines, which cross a known number of tiles, clipped and read back by layer."""
    level = grid.zoomed(8)
    w = 2 * grid.HALF / 256
    k = F.col("c_custkey")
    i, n, row = k * 13 % 256, k % 40 + 1, k * 29 % 256
    x = lambda c: (c + 0.5) * w - grid.HALF
    y = grid.HALF - (row + 0.5) * w
    text = _text("LINESTRING (", x(i), " ", y, ", ", x(F.least(i + n, F.lit(255))), " ", y, ")")
    # A line that ends where it begins (in the last column) is a short one in its tile.
    short = _text("LINESTRING (", x(i), " ", y, ", ", x(i) + w / 4, " ", y, ")")
    layer = F.when(k % 2 == 0, "even").otherwise("odd")
    df = spread(spark, d, "customer", "c_custkey").select(k.alias("id"), layer.alias("layer"), udfs.st_geomfromtext(F.when(i == 255, short).otherwise(text)).alias("geom"))
    return decoded(level_tiles(df.withColumn("_keys", grid.key_to(level)("geom")), _Lines(), level, "_keys", Options((level,), tile_extent=4096)))


class _Marks(Pipeline):
    layers = LayerNamesInColumn("layer")
    attributes = ("id",)


@query("""SELECT 6 AS zoom, (s_suppkey * 5 % 64)::INTEGER AS col, (s_suppkey * 11 % 64)::INTEGER AS row, 's' || (s_suppkey % 2) AS layer, count(*)::INTEGER AS n
FROM supplier GROUP BY ALL""")
def tiles_saved(spark: SparkSession, d: str) -> DataFrame:
    """Tiles written as files and read back from their paths."""
    level, w = grid.zoomed(6), 2 * grid.HALF / 64
    k = F.col("s_suppkey")
    x, y = (k * 5 % 64 + 0.5) * w - grid.HALF, grid.HALF - (k * 11 % 64 + 0.5) * w
    df = table(spark, d, "supplier").select(k.alias("id"), _text("s", k % 2).alias("layer"), udfs.st_makepoint(x, y).alias("geom"))
    base = scratch(spark)
    export.save_tiles(level_tiles(df.withColumn("_keys", grid.key_to(level)("geom")), _Marks(), level, "_keys", Options((level,))), base)
    part = lambda n: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.mvt$", n).cast("int")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mvt").load(base)
    return decoded(files.select(part(1).alias("zoom"), part(2).alias("col"), part(3).alias("row"), F.col("content").alias("mvt")))


@query("""WITH s AS (SELECT p_partkey AS id, p_size AS a, 1 + p_partkey % 9 AS b FROM part)
SELECT id, (a * b)::DOUBLE AS area, 2.0 * (a + b) AS length, 5 AS n_points, 'polygon' AS kind, a / 2.0 AS cx, b / 2.0 AS cy, a > 1 AND b > 1 AS holds, true AS meets,
  true AS valid, false AS empty, 'POINT (' || a || ' ' || b || ')' AS corner, round(111319.49079327358::DOUBLE * a, 3) AS x,
  '{"type": "Point", "coordinates": [' || a || '.0, ' || b || '.0]}' AS json, 2 AS n_simple FROM s""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Geometry functions by their SQL names, on rectangles of all parts."""
    udfs.register(spark)
    spread(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("a"), (F.col("p_partkey") % 9 + 1).cast("int").alias("b")).createOrReplaceTempView("terrachron_sides")
    df = spark.sql("""SELECT *, st_geomfromwkb(st_geomfromtext(format_string('POLYGON ((0 0, %d 0, %d %d, 0 %d, 0 0))', a, a, b, b))) AS g,
      st_makepoint(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS p, st_geomfromtext('POINT (1 1)') AS one, st_geomfromtext(format_string('LINESTRING (0 0, %d 0, %d 0)', a, 2 * a)) AS l FROM terrachron_sides""")
    df.createOrReplaceTempView("terrachron_shapes")
    return spark.sql("""SELECT id, st_area(g) AS area, st_length(g) AS length, st_numpoints(g) AS n_points, st_geometrytype(g) AS kind, st_x(st_centroid(g)) AS cx,
      st_y(st_centroid(g)) AS cy, st_contains(g, one) AND a > 1 AND b > 1 AS holds, st_intersects(g, one) AS meets, st_isvalid(g) AS valid, st_isempty(g) AS empty,
      st_astext(p) AS corner, round(st_x(st_reproject(p, 'EPSG:4326', 'EPSG:3857')), 3) AS x, st_asgeojson(p) AS json,
      st_numpoints(st_simplify(l, 0.5D)) AS n_simple FROM terrachron_shapes""")


@query(f"""WITH {NODES_SQL}, f AS (SELECT id, version, visible, changeset FROM nh)
SELECT 'orc' AS format, id, version, visible, changeset FROM f UNION ALL SELECT 'parquet', id, version, visible, changeset FROM f""")
def history_formats(spark: SparkSession, d: str) -> DataFrame:
    """A node history written and read as ORC and as Parquet."""
    nodes, base = derive.node_history(spark, d), scratch(spark)
    out = []
    for kind, path in (("orc", f"{base}/h.orc"), ("parquet", f"{base}/h.parquet")):
        nodes.write.format(kind).save(path)
        out.append(read_history(spark, path).select(F.lit(kind).alias("format"), "id", "version", "visible", "changeset"))
    return out[0].unionByName(out[1])


@query("""SELECT s_suppkey AS id, 'node' AS type, 'name=' || s_name AS tags, s_nationkey / 8.0 AS lat, (s_suppkey % 180)::DOUBLE AS lon, NULL AS refs, s_suppkey + 5 AS changeset FROM supplier
UNION ALL SELECT s_suppkey + 1000000, 'way', '', NULL, NULL, s_suppkey || ',' || (s_suppkey + 1), s_suppkey + 5 FROM supplier""")
def osm_xml(spark: SparkSession, d: str) -> DataFrame:
    """Elements of all suppliers written as XML and read back."""
    k = F.col("s_suppkey")
    more = _text('" version="1" changeset="', k + 5, '" timestamp="2020-01-01T00:00:00Z" user="u" uid="1" visible="true"')
    node = _text('<node id="', k, more, ' lat="', F.col("s_nationkey") / 8.0, '" lon="', k % 180, '"><tag k="name" v="', F.col("s_name"), '"/></node>')
    way = _text('<way id="', k + 1_000_000, more, '><nd ref="', k, '"/><nd ref="', k + 1, '"/></way>')
    base = scratch(spark) + "/xml"
    # A document a part, as extracts come.
    docs = table(spark, d, "supplier").groupBy((k % 4).alias("part")).agg(F.concat(F.lit("<osm>"), F.array_join(F.collect_list(_text(node, "\n", way)), "\n"), F.lit("</osm>")))
    docs.write.partitionBy("part").text(base)
    df = read_osm_xml(spark, f"{base}/*")
    refs = F.array_join(F.transform("nds", lambda n: n["ref"].cast("string")), ",")
    return df.select("id", "type", derive.tags_text("tags").alias("tags"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), refs.alias("refs"), "changeset")
