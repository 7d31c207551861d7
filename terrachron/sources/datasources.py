"""The feeds as Spark data sources, batch and streaming: changes, changesets, augmented-diffs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import AUGMENTED_DIFF_DDL, CHANGE_DDL, CHANGESET_DDL, names_of
from ..streaming.feeds import FeedStreamReader
from . import feeds
from .partitions import FeedOptions, Sequences, fetched
from .replication import END_SEQUENCE, PARTITION_COUNT, START_SEQUENCE


class FeedReader(DataSourceReader, FeedOptions):
    """Sequences from start (the current one by default) to before end (to the current one by default)."""

    def __init__(self, feed: str, options: dict[str, str], partitions: int) -> None:
        self.feed, self.default_partitions = feed, partitions
        self.read_options(options)

    def partitions(self) -> list[InputPartition]:
        start, end = self.number(START_SEQUENCE), self.number(END_SEQUENCE)
        start = start if start is not None else self.current()
        if start is None:
            raise ValueError("Could not determine start sequence.")
        last = end - 1 if end is not None else self.current()
        if last is None:
            raise ValueError("Could not determine end sequence.")
        numbers = list(range(start, last + 1))
        count = max(1, min(self.number(PARTITION_COUNT) or self.default_partitions, len(numbers)))
        # Strides, so that busy hours spread over the tasks.
        return [Sequences(numbers[k::count]) for k in range(count)] if numbers else [Sequences([])]

    def read(self, partition: Sequences) -> Iterator[tuple]:
        yield from fetched(self.feed, self.base, partition.numbers, self.options)


class _Feed(DataSource):
    ddl: str

    def schema(self) -> str:
        return self.ddl

    def _partitions(self) -> int:
        session = SparkSession.getActiveSession()
        return int(session.conf.get("spark.sql.shuffle.partitions", "200")) if session else 200

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.name(), dict(self.options), self._partitions())

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        if schema.names != names_of(self.ddl):
            raise ValueError(f"{self.name()} has a schema of its own")
        return FeedStreamReader(self.name(), dict(self.options), self._partitions())


class ChangeSource(_Feed):
    """OsmChange minutely diffs."""

    ddl = CHANGE_DDL

    @classmethod
    def name(cls) -> str:
        return feeds.CHANGES


class ChangesetSource(_Feed):
    """Changeset metadata."""

    ddl = CHANGESET_DDL

    @classmethod
    def name(cls) -> str:
        return feeds.CHANGESETS


class AugmentedDiffSource(_Feed):
    """Changes with the geometries before and after."""

    ddl = AUGMENTED_DIFF_DDL

    @classmethod
    def name(cls) -> str:
        return feeds.AUGMENTED_DIFFS


def register(spark: SparkSession) -> None:
    """Make the feeds known to a session."""
    for source in (ChangeSource, ChangesetSource, AugmentedDiffSource):
        spark.dataSource.register(source)
