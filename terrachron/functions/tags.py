"""Predicates and clean-up of tag maps, as built-in column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StructType

from .maps import _col, array_intersects

TRUTHY, FALSY = ("yes", "true", "1"), ("no", "false", "0")
MULTIPOLYGON_TYPES = ("multipolygon", "boundary")
WATERWAYS = "river riverbank canal stream stream_end brook drain ditch dam weir waterfall pressurised".split()
POI_KEYS = "amenity shop craft office leisure aeroway".split()

#: Keys that make a closed way an area, and the values with which they don't.
AREA_KEYS: dict[str, list[str]] = {
    k: v.split()
    for k, v in {
        "addr:*": "", "advertising": "billboard",
        "aerialway": "cable_car chair_lift drag_lift gondola goods magic_carpet mixed_lift platter rope_tow t-bar",
        "aeroway": "runway taxiway", "allotments": "", "amenity": "bench", "area:highway": "",
        "attraction": "dark_ride river_rafting summer_toboggan train water_slide", "bridge:support": "", "building": "",
        "camp_site": "", "club": "", "craft": "", "emergency": "designated destination no official private yes",
        "golf": "hole lateral_water_hazard water_hazard", "healthcare": "", "historic": "", "industrial": "",
        "internet_access": "", "junction": "circular roundabout", "landuse": "", "leisure": "slipway track",
        "man_made": "breakwater crane cutline embankment groyne pier pipeline", "military": "",
        "natural": "cliff coastline ridge tree_row", "office": "",
        "piste:type": "downhill hike ice_skate nordic skitour sled sleigh", "place": "",
        "playground": "balancebeam slide zipwire", "power": "cable line minor_line", "public_transport": "platform",
        "residential": "", "seamark:type": "", "shop": "", "tourism": "artwork",
        "traffic_calming": "bump cushion dip hump rumble_strip",
        "waterway": "canal dam ditch drain river stream weir",
    }.items()
}

UNINTERESTING_KEYS = (
    "created_by source comment _id clc odbl origen converted_by todo import_tools id importuuid attribution curve_geometry "
    "memphis_fixup importance description=ru-mos-325 stamväg _fid_ 1 _description_ ccpr dfg source_ref ref:urbis "
    "accuracy:meters sub_sea:type waterway:type statscan:rbuid ref:ruian:addr ref:ruian building:ruian:type dibavod:id "
    "uir_adr:adresa_kod gst:feat_id maaamet:etak ref:fr:fantoir 3dshapes:ggmodelk and_nosr_r oppdaterin addr:city:simc "
    "addr:street:sym_ul building:usage:pl building:use:pl teryt:simc raba:id dcgis:gis_id nycdoitt:bin chicago:building_id "
    "lojic:bgnum massgis:way_id objtype sk53_bulk:load"
).split()
UNINTERESTING_PREFIXES = (
    "clc tiger sby navibot nps hoot error project geobase canvec osak kms ngbe it:fvg ksj2 yh linz2osm linz wroclawgis "
    "naptap gnis nhd mvdgis"
).split()

_HASHTAG = r"#([^ -⁯⸀-⹿\s\\'!\"#$%()*,./;<=>?@\[\]^{|}~]+)"
_SUBSTANTIVE = r"[\p{L}\x{1F000}-\x{10FFFF}]"


def split_delimited_values(c: Column | str, default: str = "") -> Column:
    """Lower-cased values of a ``;`` list, each trimmed; a null is the default."""
    c = F.coalesce(_col(c), F.lit(default))
    return F.split(F.lower(F.regexp_replace(F.trim(c), r"\s*;\s*", ";")), ";")


def _value(tags: Column | str, key: str) -> Column:
    return F.element_at(_col(tags), key)


def _any(tags: Column | str, key: str, values: list[str] | tuple[str, ...]) -> Column:
    return array_intersects(split_delimited_values(_value(tags, key)), F.array(*map(F.lit, values)))


def is_tagged(tags: Column | str) -> Column:
    return F.coalesce(F.size(_col(tags)) > 0, F.lit(False))


def is_multipolygon(tags: Column | str) -> Column:
    """``type`` lists multipolygon or boundary."""
    return _any(tags, "type", MULTIPOLYGON_TYPES)


def is_route(tags: Column | str) -> Column:
    return _any(tags, "type", ("route",))


def is_new(version: Column | str, minor_version: Column | str) -> Column:
    return _col(version).eqNullSafe(1) & _col(minor_version).eqNullSafe(0)


def is_building(tags: Column | str) -> Column:
    return ~F.lower(F.coalesce(_value(tags, "building"), F.lit("no"))).isin("no", "false", "0")


def is_poi(tags: Column | str) -> Column:
    """One of the keys of points of interest is there; false for null tags."""
    return array_intersects(F.map_keys(_col(tags)), F.array(*map(F.lit, POI_KEYS)))


def is_road(tags: Column | str) -> Column:
    return _value(tags, "highway").isNotNull()


def is_coastline(tags: Column | str) -> Column:
    return _any(tags, "natural", ("coastline",))


def is_waterway(tags: Column | str) -> Column:
    return _any(tags, "waterway", WATERWAYS)


def is_area(tags: Column | str) -> Column:
    """Whether tags describe an area.

    A true or false value of ``area`` decides (true wins); else some area key must have a value
    that isn't one of its line values. False for null tags.
    """
    tags = _col(tags)
    area = split_delimited_values(_value(tags, "area"))
    truthy = array_intersects(area, F.array(*map(F.lit, TRUTHY)))
    falsy = array_intersects(area, F.array(*map(F.lit, FALSY)))
    lines = F.create_map(*[x for k, v in AREA_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    by_key = F.exists(
        F.map_entries(F.map_filter(tags, lambda k, v: k.isin(*AREA_KEYS))),
        lambda e: F.size(F.array_except(split_delimited_values(e["value"]), F.element_at(lines, e["key"]))) > 0,
    )
    return F.when(truthy | falsy, truthy).otherwise(F.coalesce(by_key, F.lit(False)))


def hashtags(comment: Column | str) -> Column:
    """Distinct lower-cased hashtags of a comment, in order; one trailing colon is cut, and a letter or emoji is needed."""
    found = F.regexp_extract_all(F.coalesce(_col(comment), F.lit("")), F.lit(_HASHTAG), 1)
    cut = F.transform(F.filter(found, lambda x: x.rlike(_SUBSTANTIVE)), lambda x: F.regexp_replace(F.lower(x), ":$", ""))
    return F.array_distinct(cut)


def merge_tags(a: Column | str, b: Column | str) -> Column:
    """Per key the distinct values of both maps, joined by ``;``; a null map is empty."""
    a, b = _col(a), _col(b)
    both = F.map_zip_with(a, b, lambda k, x, y: F.array_join(F.array_distinct(F.filter(F.array(x, y), lambda v: v.isNotNull())), ";"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def reduce_tags(c: Column | str) -> Column:
    """Per key the distinct values of an array of maps, joined by ``;``."""
    maps = F.filter(_col(c), lambda m: m.isNotNull())
    zero = F.expr("cast(map() as map<string,array<string>>)")
    step = lambda acc, m: F.map_zip_with(
        acc,
        F.transform_values(m, lambda k, v: F.split(v, ";")),
        lambda k, x, y: F.array_union(F.coalesce(x, y), F.coalesce(y, x)),
    )
    return F.aggregate(maps, zero, step, lambda acc: F.transform_values(acc, lambda k, v: F.array_join(v, ";")))


def remove_uninteresting_tags(tags: Column | str) -> Column:
    """The map less keys that describe no feature, and less a colour that stands alone."""
    tags = _col(tags)

    def dull(k: Column) -> Column:
        low = F.lower(k)
        out = low.isin(*UNINTERESTING_KEYS) | k.contains("=") | k.contains(" ")
        return out | low.rlike("^(?:" + "|".join(p.replace(":", "\\:") for p in UNINTERESTING_PREFIXES) + "):")

    kept = F.map_filter(tags, lambda k, v: ~dull(k))
    alone = (F.size(tags) == 1) & F.map_contains_key(tags, "colour")
    return F.when(alone, F.map_filter(tags, lambda k, v: F.lit(False))).otherwise(kept)


def remove_semi_interesting_tags(tags: Column | str) -> Column:
    """The map less ``source`` and ``source:…``."""
    return F.map_filter(_col(tags), lambda k, v: ~(F.lower(k) == "source") & ~F.lower(k).startswith("source:"))


# --------------------------------------------------------------------------- members


def has_compressed_members(df: DataFrame) -> bool:
    """Whether ``members`` has its types as codes."""
    t = df.schema["members"].dataType
    return isinstance(t, ArrayType) and isinstance(t.elementType, StructType) and isinstance(t.elementType["type"].dataType, ByteType)


def compress_members(members: Column | str) -> Column:
    """Member types as codes: node 1, way 2, relation 3, other 0."""
    code = lambda t: F.when(t == "node", 1).when(t == "way", 2).when(t == "relation", 3).otherwise(0).cast("byte")
    return F.transform(
        _col(members), lambda m: F.struct(code(m["type"]).alias("type"), m["ref"].cast("long").alias("ref"), m["role"].alias("role"))
    )


def ensure_compressed_members(df: DataFrame) -> DataFrame:
    return df if has_compressed_members(df) else df.withColumn("members", compress_members("members"))


def elaborate_members(members: Column | str) -> Column:
    """Member types as words; a null array stays null."""
    word = lambda t: F.when(t == 1, "node").when(t == 2, "way").when(t == 3, "relation")
    return F.transform(_col(members), lambda m: F.struct(word(m["type"]).alias("type"), m["ref"].alias("ref"), m["role"].alias("role")))
