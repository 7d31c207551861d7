"""Registered queries and their SQL, and what queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def real(c: str | Column, digits: int = 6) -> Column:
    """Rounded; NaN as null, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))


def real_sql(c: str, digits: int = 6) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN round({c}, {digits}) + 0.0 END"


def text_of(*parts: object) -> Column:
    """Columns and strings, joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def decoded(tiles: DataFrame) -> DataFrame:
    """Layers and their numbers of features, read back from the tiles."""
    from ..tiles import mvt

    @F.pandas_udf("array<struct<layer:string,n:int>>")
    def layers(s):
        import pandas as pd

        return pd.Series([[{"layer": k, "n": n} for k, n in mvt.counts(bytes(b)).items()] for b in s], dtype=object)

    return tiles.select("zoom", "col", "row", F.explode(layers("mvt")).alias("l")).select("zoom", "col", "row", "l.layer", "l.n")
