"""Entry points: geometries of a history, snapshots, user metadata."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.tags import remove_uninteresting_tags
from .operators.history import (
    construct_point_geometries,
    preprocess_nodes,
    reconstruct_relation_geometries,
    reconstruct_way_geometries,
)
from .schema import GEOMETRY_COLUMNS, require


def to_geometry(history: DataFrame, persist: bool = True) -> DataFrame:
    """Geometries of all elements of a history, one row a changeset that changed them.

    Points of tagged nodes, lines and polygons of tagged ways, polygons and routes of
    relations. Way geometries serve three branches; ``persist`` keeps them on the executors'
    disks meanwhile (lost parts are computed anew).
    """
    elements = history.withColumn("tags", remove_uninteresting_tags("tags"))
    nodes = preprocess_nodes(elements)
    points = construct_point_geometries(nodes).withColumn("minorVersion", F.lit(0))
    ways = reconstruct_way_geometries(elements, nodes)
    if persist:
        ways = ways.persist(StorageLevel.DISK_ONLY)
    relations = reconstruct_relation_geometries(elements, ways)
    tagged = ways.where(F.size("tags") > 0)
    out = [df.select(*GEOMETRY_COLUMNS) for df in (points, tagged, relations)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def snapshot(df: DataFrame, at: dt.datetime | Column | None = None) -> DataFrame:
    """Rows valid at a time (now by default); rows that are still valid end tomorrow."""
    require(df, "updated", "validUntil")
    t = F.current_timestamp() if at is None else at if isinstance(at, Column) else F.lit(at)
    return df.where((F.col("updated") <= t) & (t < F.coalesce("validUntil", F.date_add(F.current_timestamp(), 1))))


def add_user_metadata(geoms: DataFrame, changesets: DataFrame) -> DataFrame:
    """Geometries with uid and user of their changeset; those of unknown changesets drop out."""
    return geoms.join(changesets.select(F.col("id").alias("changeset"), "uid", "user"), "changeset")
