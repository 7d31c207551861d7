"""Element histories: validity, carried-over values of deletions, and geometries over time.

Joins are merge joins (hints): sizes after an explode are guessed far too low, and a side
taken for small would go through the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.maps import as_double
from ..functions.tags import ensure_compressed_members, is_area, is_multipolygon, is_route, merge_tags, remove_semi_interesting_tags
from ..geometry import assemble
from ..geometry.udfs import build_way, st_makepoint
from ..geometry.wkb import to_wkb
from ..schema import GEOMETRY_COLUMNS, NODE, RELATION, WAY, require
from .relationtime import assembled
from .waytime import way_geometries


def _by_version() -> WindowSpec:
    return Window.partitionBy("id").orderBy("version")


def _by_updated(*within: str) -> WindowSpec:
    """Equal times are told apart by changeset, so that results don't depend on the plan."""
    return Window.partitionBy("id", *within).orderBy("updated", "changeset")


def _covers(since: Column | str, until: Column | str, at: Column | str) -> Column:
    """Whether [since, until) holds a time; an open end is now."""
    since, until, at = (F.col(c) if isinstance(c, str) else c for c in (since, until, at))
    return (since <= at) & (at < F.coalesce(until, F.current_timestamp()))


def _last_tags() -> Column:
    """Tags, or for a deletion those of the version before."""
    before = F.lag("tags").over(_by_version())
    return F.when(~F.col("visible") & before.isNotNull(), before).otherwise(F.col("tags")).alias("tags")


def _last(name: str, value: Column | str | None = None) -> Column:
    """A column, or for a deletion its value in the version before."""
    v = F.col(name) if value is None else value
    return F.when(~F.col("visible"), F.lag(v).over(_by_version())).otherwise(v).alias(name)


def _until() -> Column:
    return F.lead("timestamp").over(_by_version()).alias("validUntil")


def preprocess_nodes(history: DataFrame, extent: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Node versions with validUntil and geometryChanged; deletions carry the tags and place before them.

    ``extent`` (xmin, ymin, xmax, ymax) keeps nodes strictly inside. Nodes that were
    preprocessed before (they have validUntil) are only filtered.
    """
    if extent is not None:
        xmin, ymin, xmax, ymax = extent
        history = history.where((F.col("lat") > ymin) & (F.col("lat") < ymax) & (F.col("lon") > xmin) & (F.col("lon") < xmax))
    if "validUntil" in history.columns:
        return history
    require(history, "id", "type", "tags", "lat", "lon", "changeset", "timestamp", "version", "visible")
    nodes = history.where(F.col("type") == "node").withColumns({"lat": as_double("lat"), "lon": as_double("lon")})
    stays = F.lag("lat").over(_by_version()).eqNullSafe(F.col("lat")) & F.lag("lon").over(_by_version()).eqNullSafe(F.col("lon"))
    return nodes.select(
        "id", _last_tags(), _last("lat"), _last("lon"), "changeset", "timestamp", _until(), "uid", "user", "version", "visible",
        (~stays).alias("geometryChanged"),
    )


def preprocess_ways(history: DataFrame) -> DataFrame:
    """Way versions with validUntil and geometryChanged; deletions carry the tags and nodes before them; nds are ids."""
    if "validUntil" in history.columns:
        return history
    require(history, "id", "type", "tags", "nds", "changeset", "timestamp", "version", "visible")
    stays = F.lag("nds").over(_by_version()).eqNullSafe(F.col("nds"))
    return history.where(F.col("type") == "way").select(
        "id", _last_tags(), _last("nds", F.col("nds.ref")), "changeset", "timestamp", _until(), "uid", "user", "version", "visible",
        (~stays).alias("geometryChanged"),
    )


def preprocess_relations(history: DataFrame) -> DataFrame:
    """Relation versions with validUntil; deletions carry the tags and members before them; member types are codes."""
    if "validUntil" in history.columns:
        return history
    require(history, "id", "type", "tags", "members", "changeset", "timestamp", "version", "visible")
    return ensure_compressed_members(history.where(F.col("type") == "relation")).select(
        "id", _last_tags(), _last("members"), "changeset", "timestamp", _until(), "uid", "user", "version", "visible"
    )


def latest_points(nodes: DataFrame) -> DataFrame:
    """Nodes with tags of interest, one row a changeset and node: the last version there, without a geometry yet."""
    rows = preprocess_nodes(nodes).where(F.size(remove_semi_interesting_tags("tags")) > 0)
    # The last version's row comes along in the aggregate, which spares a join back to the versions.
    last = F.max_by(F.struct("tags", "lon", "lat", "validUntil", "visible"), "version").alias("last")
    rows = rows.groupBy("changeset", "id").agg(
        F.max("version").cast("int").alias("version"), F.max("timestamp").alias("updated"), last
    )
    return rows.select("id", "last.lon", "last.lat", "last.tags", "changeset", "updated", "last.validUntil", "last.visible", "version")


def construct_point_geometries(nodes: DataFrame) -> DataFrame:
    """Points of nodes with tags of interest, one row a changeset and node."""
    return latest_points(nodes).select(
        F.lit(NODE).cast("byte").alias("_type"), "id", st_makepoint("lon", "lat").alias("geom"), "tags", "changeset", "updated",
        "validUntil", "visible", "version",
    )


def moved_nodes(nodes: DataFrame) -> DataFrame:
    """Node versions that changed place, valid until the next such version."""
    rows = preprocess_nodes(nodes).drop("validUntil").where("geometryChanged").drop("geometryChanged")
    return rows.withColumn("validUntil", F.lead("timestamp").over(_by_version()))


def nodes_to_ways(ways: DataFrame) -> DataFrame:
    """Lookup table from node ids to the way versions that hold them."""
    return preprocess_ways(ways).select(F.explode("nds").alias("id"), F.col("id").alias("wayId"), "version", "timestamp", "validUntil")


def way_timeline(ways: DataFrame, nodes: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """One row a changeset that touched a way or a node of it: changeset, id, version, updated.

    ``ways`` are preprocessed, ``nodes`` moved ones.
    """
    lookup = lookup if lookup is not None else nodes_to_ways(ways)
    by_node = nodes.select("changeset", "id", F.col("timestamp").alias("updated")).join(lookup.hint("merge"), "id")
    by_node = by_node.where(_covers("timestamp", "validUntil", "updated")).select("changeset", F.col("wayId").alias("id"), "version", "updated")
    own = ways.select("changeset", "id", "version", F.col("timestamp").alias("updated"))
    # One shuffle on the way serves the aggregate and joins of its rows with other rows of the way.
    rows = by_node.unionByName(own).repartition("id")
    return rows.groupBy("changeset", "id").agg(F.max("version").cast("int").alias("version"), F.max("updated").alias("updated"))


def way_vertices(timeline: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertices of each row of the timeline: where its nodes were at that time. Unknown nodes are left out."""
    nds = ways.select("id", "version", "nds", is_area("tags").alias("isArea"))
    refs = timeline.join(nds.hint("merge"), ["id", "version"]).select("changeset", "id", "version", "updated", "isArea", F.posexplode("nds").alias("idx", "ref"))
    places = nodes.select(F.col("id").alias("ref"), "timestamp", "validUntil", "lat", "lon")
    return refs.join(places.hint("merge"), "ref").where(_covers("timestamp", "validUntil", "updated")).drop("timestamp", "validUntil", "ref")


def reconstruct_way_geometries(ways: DataFrame, nodes: DataFrame, nodes_to_ways: DataFrame | None = None) -> DataFrame:
    """Way geometries, one row a changeset that changed the way or a node of it, with minor versions and validity.

    All rows of a way meet in one shuffle. A lookup table of one's own decides which nodes'
    moves count; then the timeline and the vertices are joined step by step.
    """
    moved, rows = moved_nodes(nodes), preprocess_ways(ways)
    if nodes_to_ways is None:
        return way_geometries(rows, moved).select(F.lit(WAY).cast("byte").alias("_type"), *GEOMETRY_COLUMNS[1:], "geometryChanged")
    vertices = way_vertices(way_timeline(rows, moved, nodes_to_ways), rows, moved)
    lines = vertices.groupBy("changeset", "id", "version", "updated").agg(
        F.first("isArea").alias("isArea"), F.sort_array(F.collect_list(F.struct("idx", "lon", "lat"))).alias("vertices")
    )
    geom = build_way(F.col("vertices.lon"), F.col("vertices.lat"), "isArea").alias("geom")
    geoms = lines.select("changeset", "id", "version", "updated", geom)
    timed = geoms.withColumns(
        {
            "validUntil": F.lead("updated").over(_by_updated()),
            "minorVersion": F.row_number().over(_by_updated("version")) - 1,
            "geometryChanged": ~F.lag("geom").over(_by_updated()).eqNullSafe(F.col("geom")),
        }
    )
    return timed.join(rows.select("id", "version", "tags", "visible").hint("merge"), ["id", "version"]).select(
        F.lit(WAY).cast("byte").alias("_type"), *GEOMETRY_COLUMNS[1:], "geometryChanged"
    )


def relation_timeline(relations: DataFrame, geoms: DataFrame) -> DataFrame:
    """One row a changeset that touched a relation or a way of it, with minorVersion and validUntil.

    ``relations`` are preprocessed, ``geoms`` way geometries with geometryChanged. Rows are
    narrow: members stay with their version (``version_members``), so that the windows over a
    relation with many changesets sort keys and times alone.
    """
    ways = F.filter("members", lambda m: m["type"] == WAY)
    refs = F.array_distinct(F.transform(ways, lambda m: m["ref"]))
    lookup = relations.select(F.explode(refs).alias("id"), F.col("id").alias("relationId"), "version", "timestamp", "validUntil")
    by_way = geoms.where("geometryChanged").select("changeset", "id", "updated").join(lookup.hint("merge"), "id")
    by_way = by_way.where(_covers("timestamp", "validUntil", "updated")).select("changeset", F.col("relationId").alias("id"), "version", "updated")
    own = relations.select("changeset", "id", "version", F.col("timestamp").alias("updated"))
    rows = by_way.unionByName(own).groupBy("changeset", "id").agg(F.max("version").cast("int").alias("version"), F.max("updated").alias("updated"))
    return rows.withColumns(
        {"validUntil": F.lead("updated").over(_by_updated()), "minorVersion": F.row_number().over(_by_updated("version")) - 1}
    )


KEYS = ["changeset", "id", "version", "minorVersion", "updated", "validUntil"]


def version_members(relations: DataFrame) -> DataFrame:
    """Distinct members of each relation version, with their first place among them (a version without any has one null row)."""
    rows = relations.select("id", "version", F.posexplode_outer("members").alias("pos", "m"))
    rows = rows.select("id", "version", "pos", F.col("m.type").alias("type"), F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))
    return rows.groupBy("id", "version", "type", "ref", "role").agg(F.min("pos").alias("pos"))


def relation_members(timeline: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct members of each row of the timeline, with their first place among them."""
    return timeline.select(*KEYS).join(version_members(relations).hint("merge"), ["id", "version"]).select(*KEYS, "type", "ref", "role", "pos")


def with_member_geometries(members: DataFrame, geoms: DataFrame) -> DataFrame:
    """Members with the geometry they had at that time.

    A member that is no known way stays with a null geometry; one whose way is known, but at
    no version for that time, is dropped.
    """
    ways = geoms.select(
        F.lit(WAY).cast("byte").alias("type"), F.col("id").alias("ref"), F.col("updated").alias("since"), F.col("validUntil").alias("until"), "geom"
    )
    unmatched = F.col("since").isNull() & F.col("until").isNull() & F.col("geom").isNull()
    return members.join(ways.hint("merge"), ["type", "ref"], "left").where(unmatched | _covers("since", "until", "updated")).drop("since", "until")


def _multipolygon(*members: list) -> list[tuple[str, bytes | None]]:
    return [("", to_wkb(assemble.multipolygon(*members)))]


def _routes(*members: list) -> list[tuple[str, bytes | None]]:
    got = assemble.routes(*members)
    return [("", None)] if got is None else [(role, to_wkb(g)) for role, g in got]


def reconstruct_multipolygons(relations: DataFrame, geoms: DataFrame) -> DataFrame:
    """Polygons of relations of type multipolygon or boundary; null where they can't be assembled."""
    rows = preprocess_relations(relations).where(is_multipolygon("tags"))
    members = version_members(rows).where(F.col("role").isin("", "outer", "inner"))
    built = assembled(relation_timeline(rows, geoms), members, geoms, _multipolygon)
    return built.join(rows.select("id", "version", "tags", "visible").hint("merge"), ["id", "version"]).select(
        F.lit(RELATION).cast("byte").alias("_type"), *GEOMETRY_COLUMNS[1:]
    )


def reconstruct_routes(relations: DataFrame, geoms: DataFrame) -> DataFrame:
    """Lines of relations of type route, one row a role (which joins the tags); one null row where a way is unknown."""
    rows = preprocess_relations(relations).where(is_route("tags"))
    built = assembled(relation_timeline(rows, geoms), version_members(rows), geoms, _routes)
    role = F.when(F.col("role") != "", F.create_map(F.lit("role"), F.col("role"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    built = built.select(*KEYS, "geom", role.alias("extra"))
    joined = built.join(rows.select("id", "version", F.col("tags").alias("own"), "visible").hint("merge"), ["id", "version"])
    return joined.withColumn("tags", merge_tags("own", "extra")).select(F.lit(RELATION).cast("byte").alias("_type"), *GEOMETRY_COLUMNS[1:])


def reconstruct_relation_geometries(relations: DataFrame, geoms: DataFrame) -> DataFrame:
    """Multipolygons and routes; a relation that is both is in both."""
    rows = preprocess_relations(relations)
    return reconstruct_multipolygons(rows, geoms).unionByName(reconstruct_routes(rows, geoms))
