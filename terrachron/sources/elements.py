"""Element tables: ORC or Parquet histories, and OSM XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ELEMENT_COLUMNS, schema_of

_XML = (
    "_id BIGINT, _lat DOUBLE, _lon DOUBLE, _changeset BIGINT, _timestamp STRING, _uid BIGINT, _user STRING, _version BIGINT, "
    "_visible BOOLEAN, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>, nd ARRAY<STRUCT<_ref: BIGINT>>, "
    "member ARRAY<STRUCT<_type: STRING, _ref: BIGINT, _role: STRING>>"
)


def read_history(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """An element history in ORC (the default) or Parquet; filters and columns reach the scan."""
    file_format = file_format or ("parquet" if path.rstrip("/").endswith(".parquet") else "orc")
    return spark.read.format(file_format).load(path)


def read_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """Elements of OSM XML files, each kind read by its own tag."""
    out = None
    for kind in ("node", "way", "relation"):
        raw = spark.read.format("xml").option("rowTag", kind).schema(schema_of(_XML)).load(path)
        tags = F.coalesce(
            F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.expr("cast(map() as map<string,string>)")
        )
        df = raw.select(
            F.col("_id").alias("id"), F.lit(kind).alias("type"), tags.alias("tags"),
            F.col("_lat").cast("decimal(9,7)").alias("lat"), F.col("_lon").cast("decimal(10,7)").alias("lon"),
            F.transform("nd", lambda n: F.struct(n["_ref"].alias("ref"))).alias("nds"),
            F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))).alias("members"),
            F.col("_changeset").alias("changeset"), F.to_timestamp("_timestamp").alias("timestamp"), F.col("_uid").alias("uid"),
            F.col("_user").alias("user"), F.col("_version").alias("version"), F.coalesce("_visible", F.lit(True)).alias("visible"),
        )
        out = df if out is None else out.unionByName(df)
    return out.select(*ELEMENT_COLUMNS)
