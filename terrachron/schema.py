"""Schemas of the data model and checks at the API's border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

NODE, WAY, RELATION = 1, 2, 3
TYPE_CODES = {"node": NODE, "way": WAY, "relation": RELATION}

ELEMENT_DDL = (
    "id BIGINT, type STRING, tags MAP<STRING,STRING>, lat DECIMAL(9,7), lon DECIMAL(10,7), nds ARRAY<STRUCT<ref: BIGINT>>, "
    "members ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>, changeset BIGINT, timestamp TIMESTAMP, uid BIGINT, "
    "user STRING, version BIGINT, visible BOOLEAN"
)
COMPRESSED_MEMBERS_DDL = "ARRAY<STRUCT<type: TINYINT, ref: BIGINT, role: STRING>>"
GEOMETRY_DDL = (
    "_type TINYINT, id BIGINT, geom BINARY, tags MAP<STRING,STRING>, changeset BIGINT, updated TIMESTAMP, "
    "validUntil TIMESTAMP, visible BOOLEAN, version INT, minorVersion INT"
)
CHANGE_DDL = (
    "id BIGINT, type STRING, tags MAP<STRING,STRING>, lat DOUBLE, lon DOUBLE, nds ARRAY<STRUCT<ref: BIGINT>>, "
    f"members {COMPRESSED_MEMBERS_DDL}, changeset BIGINT, timestamp TIMESTAMP, uid BIGINT, user STRING, version BIGINT, "
    "visible BOOLEAN, sequence INT"
)
CHANGESET_DDL = (
    "id BIGINT, tags MAP<STRING,STRING>, createdAt TIMESTAMP, open BOOLEAN, closedAt TIMESTAMP, commentsCount INT, "
    "minLat DOUBLE, maxLat DOUBLE, minLon DOUBLE, maxLon DOUBLE, numChanges INT, uid BIGINT, user STRING, "
    "comments ARRAY<STRUCT<date: TIMESTAMP, user: STRING, uid: BIGINT, body: STRING>>, sequence INT"
)
AUGMENTED_DIFF_DDL = (
    "sequence INT, type TINYINT, id BIGINT, prevGeom BINARY, geom BINARY, prevTags MAP<STRING,STRING>, "
    "tags MAP<STRING,STRING>, prevNds ARRAY<BIGINT>, nds ARRAY<BIGINT>, prevChangeset BIGINT, changeset BIGINT, "
    "prevUid BIGINT, uid BIGINT, prevUser STRING, user STRING, prevUpdated TIMESTAMP, updated TIMESTAMP, "
    "prevVisible BOOLEAN, visible BOOLEAN, prevVersion INT, version INT, minorVersion BOOLEAN"
)


def names_of(ddl: str) -> list[str]:
    """Column names of a DDL string (nested fields left out)."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


ELEMENT_COLUMNS = names_of(ELEMENT_DDL)
GEOMETRY_COLUMNS = names_of(GEOMETRY_DDL)


def schema_of(ddl: str) -> StructType:
    """A DDL string as a schema; needs a session."""
    return StructType.fromDDL(ddl)


def require(df: DataFrame, *names: str) -> None:
    """ValueError unless all columns are there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
