"""Element histories derived from the star-schema tables, and the same derivation in DuckDB SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: list[tempfile.TemporaryDirectory] = []


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads again, below ``spark.checkpoint.dir``.

    Only where that is unset and all executors are in this process, a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="scratch-"))
            atexit.register(_OWN[0].cleanup)
        base = _OWN[0].name
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A narrow table over all tasks of a shuffle: its file may be one split, and what is made of its rows takes long."""
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), key)


def _map(*pairs: tuple[str, str]) -> Column:
    if not pairs:
        return F.expr("cast(map() as map<string,string>)")
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
NODE_TAGS = ((("highway", "crossing"),), (("source", "survey"),), (("amenity", "cafe"), ("created_by", "x")), ())
WAY_TAGS = ((("building", "yes"),), (("highway", "service"),), (("highway", "path"), ("note", "a")), (("waterway", "stream"),), ())


def _chosen(n: Column, tags: tuple) -> Column:
    out = None
    for k, t in enumerate(tags[:-1]):
        out = F.when(n == k, _map(*t)) if out is None else out.when(n == k, _map(*t))
    return out.otherwise(_map(*tags[-1]))


def node_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of nodes from line items: one node a part."""
    w = Window.partitionBy("l_partkey").orderBy(*ORDER)
    li = table(spark, sf_dir, "lineitem").withColumn("version", F.row_number().over(w).cast("long"))
    visible = ~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("version") > 1))
    li = li.withColumn("visible", visible)
    step = F.when(F.col("l_quantity").cast("long") % 2 == 0, F.lit(0.0)).otherwise(F.col("version") * 0.001)
    lon = (F.col("l_partkey") * 37 % 3600) / 10 - 180 + step
    lat = (F.col("l_partkey") * 53 % 1700) / 10 - 85 + step
    tags = F.when(F.col("visible"), _chosen(F.col("l_partkey") % 4, NODE_TAGS)).otherwise(_map())
    return li.select(
        F.col("l_partkey").alias("id"), F.lit("node").alias("type"), tags.alias("tags"), F.when(F.col("visible"), lat).alias("lat"),
        F.when(F.col("visible"), lon).alias("lon"), F.col("l_orderkey").alias("changeset"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.col("l_suppkey").alias("uid"), F.lit("u").alias("user"), "version",
        "visible",
    )


def way_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of ways from orders: one way a customer, the parts of an order its nodes."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(*[c for c in ORDER if c != "l_orderkey"], "l_partkey"))), lambda s: s["l_partkey"]).alias("refs")
    )
    od = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    od = od.withColumn("version", F.row_number().over(w).cast("long"))
    od = od.withColumn("visible", ~((F.col("o_orderkey") % 7 == 0) & (F.col("version") > 1)))
    refs = F.when(F.col("o_orderkey") % 3 == 0, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs"))
    tags = F.when(F.col("visible"), _chosen(F.col("o_custkey") % 5, WAY_TAGS)).otherwise(_map())
    return od.select(
        F.col("o_custkey").alias("id"), F.lit("way").alias("type"), tags.alias("tags"),
        F.when(F.col("visible"), F.transform(refs, lambda r: F.struct(r.alias("ref")))).alias("nds"), F.col("o_orderkey").alias("changeset"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_custkey").alias("uid"), F.lit("u").alias("user"), "version",
        "visible",
    )


def relation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a relation for each nation, growing by a third of its customers each."""
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("v"))
    role = F.when(F.col("c_mktsegment") == "BUILDING", "outer").when(F.col("c_mktsegment") == "MACHINERY", "inner").when(F.col("c_mktsegment") == "FURNITURE", "label").otherwise("")
    members = F.transform(
        F.sort_array(F.collect_list(F.struct("c_custkey", role.alias("role")))),
        lambda m: F.struct(F.lit("way").alias("type"), m["c_custkey"].alias("ref"), m["role"].alias("role")),
    )
    rows = cu.where(F.col("c_custkey") % 3 < F.col("v")).groupBy("c_nationkey", "v").agg(members.alias("members"))
    kind = F.element_at(F.array(*map(F.lit, ("multipolygon", "boundary", "route"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return rows.select(
        F.col("c_nationkey").cast("long").alias("id"), F.lit("relation").alias("type"), F.create_map(F.lit("type"), kind).alias("tags"),
        "members", (F.lit(10_000_000) + F.col("c_nationkey") * 10 + F.col("v")).cast("long").alias("changeset"),
        F.make_timestamp(F.lit(1995) + F.col("v"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("timestamp"),
        F.lit(1).cast("long").alias("uid"), F.lit("u").alias("user"), F.col("v").cast("long").alias("version"), F.lit(True).alias("visible"),
    )


def time_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def tags_text(c: str | Column) -> Column:
    """A tag map as sorted k=v."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


# --------------------------------------------------------------------------- the same in SQL


def _case(n: str, tags: tuple) -> str:
    arms = " ".join(f"WHEN {k} THEN '{','.join(sorted(f'{a}={b}' for a, b in t))}'" for k, t in enumerate(tags))
    return f"(CASE {n} {arms} END)"


NODES_SQL = f"""
n0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(ORDER)}) AS version FROM lineitem
), n1 AS (
  SELECT *, NOT (l_returnflag = 'R' AND l_linestatus = 'F' AND version > 1) AS visible,
         CASE WHEN l_quantity::BIGINT % 2 = 0 THEN 0.0::DOUBLE ELSE version::DOUBLE * 0.001::DOUBLE END AS step FROM n0
), nh AS (
  SELECT l_partkey AS id, version, visible, l_orderkey AS changeset, l_shipdate AS ts, l_suppkey AS uid,
         CASE WHEN visible THEN {_case('(l_partkey % 4)', NODE_TAGS)} ELSE '' END AS tags0,
         CASE WHEN visible THEN (l_partkey * 37 % 3600)::DOUBLE / 10::DOUBLE - 180 + step ELSE 'nan'::DOUBLE END AS lon0,
         CASE WHEN visible THEN (l_partkey * 53 % 1700)::DOUBLE / 10::DOUBLE - 85 + step ELSE 'nan'::DOUBLE END AS lat0 FROM n1
), np AS (
  SELECT id, version, visible, changeset, ts, lead(ts) OVER w AS until,
         CASE WHEN NOT visible AND lag(tags0) OVER w IS NOT NULL THEN lag(tags0) OVER w ELSE tags0 END AS tags,
         CASE WHEN NOT visible THEN lag(lat0) OVER w ELSE lat0 END AS lat,
         CASE WHEN NOT visible THEN lag(lon0) OVER w ELSE lon0 END AS lon,
         NOT (lag(lat0) OVER w IS NOT DISTINCT FROM lat0 AND lag(lon0) OVER w IS NOT DISTINCT FROM lon0) AS changed
  FROM nh WINDOW w AS (PARTITION BY id ORDER BY version)
)"""

WAYS_SQL = f"""
w0 AS (
  SELECT l_orderkey, list(l_partkey ORDER BY {', '.join(c for c in ORDER if c != 'l_orderkey')}, l_partkey) AS refs FROM lineitem GROUP BY 1
), w1 AS (
  SELECT o.*, refs, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version
  FROM orders o JOIN w0 ON o_orderkey = l_orderkey
), wh AS (
  SELECT o_custkey AS id, version, o_orderkey AS changeset, o_orderdate AS ts, NOT (o_orderkey % 7 = 0 AND version > 1) AS visible,
         CASE WHEN NOT (o_orderkey % 7 = 0 AND version > 1)
              THEN CASE WHEN o_orderkey % 3 = 0 THEN list_append(refs, refs[1]) ELSE refs END END AS nds0,
         CASE WHEN NOT (o_orderkey % 7 = 0 AND version > 1) THEN {_case('(o_custkey % 5)', WAY_TAGS)} ELSE '' END AS tags0
  FROM w1
), wp AS (
  SELECT id, version, changeset, ts, visible, lead(ts) OVER w AS until,
         CASE WHEN NOT visible THEN lag(nds0) OVER w ELSE nds0 END AS nds,
         CASE WHEN NOT visible AND lag(tags0) OVER w IS NOT NULL THEN lag(tags0) OVER w ELSE tags0 END AS tags,
         NOT (lag(nds0) OVER w IS NOT DISTINCT FROM nds0) AS changed
  FROM wh WINDOW w AS (PARTITION BY id ORDER BY version)
)"""

TIMELINE_SQL = f"""{NODES_SQL}, {WAYS_SQL},
nm AS (
  SELECT id, changeset, ts, lat, lon, lead(ts) OVER (PARTITION BY id ORDER BY version) AS until FROM np WHERE changed
), nw AS (
  SELECT unnest(nds) AS node, id, version, ts, until FROM wp
), wt AS (
  SELECT changeset, id, max(version)::INTEGER AS version, max(updated) AS updated FROM (
    SELECT m.changeset, nw.id, nw.version, m.ts AS updated FROM nm AS m JOIN nw ON m.id = nw.node
    WHERE nw.ts <= m.ts AND m.ts < coalesce(nw.until, now()::TIMESTAMP)
    UNION ALL SELECT changeset, id, version, ts FROM wp
  ) GROUP BY 1, 2
)"""

VERTICES_SQL = f"""{TIMELINE_SQL},
wv AS (
  SELECT r.changeset, r.id, r.version, r.updated, r.idx, m.lon, m.lat, r.tags FROM (
    SELECT wt.*, wp.tags, unnest(nds) AS node, generate_subscripts(nds, 1) - 1 AS idx FROM wt JOIN wp ON wt.id = wp.id AND wt.version = wp.version
  ) AS r JOIN nm AS m ON r.node = m.id WHERE m.ts <= r.updated AND r.updated < coalesce(m.until, now()::TIMESTAMP)
)"""

RELATIONS_SQL = """
rh AS (
  SELECT c_nationkey::BIGINT AS id, v::BIGINT AS version, (10000000 + c_nationkey * 10 + v)::BIGINT AS changeset,
         make_timestamp(1995 + v, 1, 1, 0, 0, 0.0) AS ts, ['multipolygon', 'boundary', 'route'][c_nationkey % 3 + 1] AS kind,
         list({'ref': c_custkey, 'role': CASE c_mktsegment WHEN 'BUILDING' THEN 'outer' WHEN 'MACHINERY' THEN 'inner'
               WHEN 'FURNITURE' THEN 'label' ELSE '' END} ORDER BY c_custkey) AS members
  FROM customer, (VALUES (1), (2), (3)) AS t(v) WHERE c_custkey % 3 < v GROUP BY c_nationkey, v
), rp AS (
  SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY version) AS until FROM rh
)"""


def time_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
