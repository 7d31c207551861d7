"""Helpers on maps and arrays, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: Column | str) -> Column:
    """As double; null becomes NaN."""
    return F.coalesce(_col(c).cast("double"), F.lit(float("nan")))


def as_float(c: Column | str) -> Column:
    """As float; null becomes NaN."""
    return F.coalesce(_col(c).cast("float"), F.lit(float("nan")).cast("float"))


def flatten(c: Column | str) -> Column:
    return F.flatten(_col(c))


def flatten_set(c: Column | str) -> Column:
    """Distinct values of an array of arrays, in order of first sight."""
    return F.array_distinct(F.flatten(_col(c)))


def merge_sets(a: Column | str, b: Column | str) -> Column:
    """Union of two arrays without repeats; a null array is empty."""
    a, b = _col(a), _col(b)
    return F.array_distinct(F.coalesce(F.array_union(a, b), a, b, F.array().cast("array<string>")))


def without(c: Column | str, value: Column | object) -> Column:
    """The array less all elements equal to ``value`` (null too)."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.filter(_col(c), lambda x: ~x.eqNullSafe(v))


def array_intersects(a: Column | str, b: Column | str) -> Column:
    """Whether two arrays share a value; false, not null, where that isn't known."""
    return F.coalesce(F.arrays_overlap(_col(a), _col(b)), F.lit(False))


def count_values(c: Column | str) -> Column:
    """Map from each distinct value of an array to how often it occurs."""
    c = _col(c)
    keys = F.filter(F.array_distinct(c), lambda x: x.isNotNull())
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(c, lambda x: x == k))))


def merge_counts(a: Column | str, b: Column | str) -> Column:
    """Sum of two count maps; a null map has no counts."""
    a, b = _col(a), _col(b)
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def sum_counts(c: Column | str) -> Column:
    """Sum of an array of count maps; an empty array gives an empty map."""
    zero = F.expr("cast(map() as map<string,int>)")
    return F.aggregate(
        F.filter(_col(c), lambda m: m.isNotNull()),
        zero,
        lambda acc, m: F.map_zip_with(acc, m, lambda k, x, y: (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).cast("int")),
    )


def merge_maps(a: Column | str, b: Column | str, f) -> Column:
    """Union of two maps; ``f(x, y)`` where both have the key."""
    return F.map_zip_with(_col(a), _col(b), lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(f(x, y)))
