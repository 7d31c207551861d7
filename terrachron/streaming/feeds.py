"""A feed as a stream of sequences, with offsets and checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from ..sources.partitions import FeedOptions, Sequences, fetched
from ..sources.replication import BATCH_SIZE, DB_URI, END_SEQUENCE, PROC_NAME, START_SEQUENCE, Checkpoints


class FeedStreamReader(DataSourceStreamReader, FeedOptions):
    """A stream of sequences, at most ``batch_size`` a batch; ``end_sequence`` is the last one.

    Offsets hold the last sequence done. Without a checkpoint of Spark's own, a stream begins
    after the one stored under ``proc_name`` in ``db_uri``, at ``start_sequence``, or at the
    current one.
    """

    def __init__(self, feed: str, options: dict[str, str], batch: int) -> None:
        self.feed, self.default_batch = feed, batch
        self.read_options(options)
        self.name, self.store = self.options.get(PROC_NAME), self.options.get(DB_URI)
        if self.store and not self.name:
            raise ValueError(f"{PROC_NAME} is required with {DB_URI}")
        self.cursor: int | None = None

    def initialOffset(self) -> dict:
        done = Checkpoints(self.store).get(self.name) if self.store else None
        if done is None:
            start = self.number(START_SEQUENCE)
            if start is None:
                start = self.current()
            if start is None:
                raise ValueError("Could not determine start sequence.")
            done = start - 1
        if self.cursor is None:
            self.cursor = done
        return {"sequence": done}

    def latestOffset(self) -> dict:
        if self.cursor is None:
            self.cursor = self.initialOffset()["sequence"]
        now, end = self.current(), self.number(END_SEQUENCE)
        limit = end if now is None and end is not None else now if end is None else min(now, end) if now is not None else None
        if limit is not None and limit > self.cursor:
            self.cursor = min(limit, self.cursor + (self.number(BATCH_SIZE) or self.default_batch))
        return {"sequence": self.cursor}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.cursor = max(self.cursor or 0, end["sequence"])
        return [Sequences([n]) for n in range(start["sequence"] + 1, end["sequence"] + 1)]

    def read(self, partition: Sequences) -> Iterator[tuple]:
        yield from fetched(self.feed, self.base, partition.numbers, self.options)

    def commit(self, end: dict) -> None:
        if self.store:
            Checkpoints(self.store).put(self.name, end["sequence"])
