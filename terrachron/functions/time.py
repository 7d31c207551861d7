"""Sequence numbers of minutely diffs and their times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maps import _col

EPOCH = 1347432900


def sequence_of(ts: dt.datetime) -> int:
    """The sequence at a time (a naive one is UTC), toward zero."""
    ts = ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)
    return int((int(ts.timestamp()) - EPOCH) / 60)


def time_of(sequence: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(sequence * 60 + EPOCH, dt.timezone.utc)


def sequence_of_column(c: Column | str) -> Column:
    return F.floor((F.unix_timestamp(_col(c)) - EPOCH) / 60).cast("int")


def time_of_column(c: Column | str) -> Column:
    return F.timestamp_seconds(_col(c).cast("long") * 60 + EPOCH)
