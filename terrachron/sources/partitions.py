"""Sequences of a feed as partitions, and what batch and streaming readers share."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition

from . import feeds
from .replication import BASE_URI, ERROR_HANDLER, RETRIES, RETRY_DELAY

FETCHES_PER_TASK = 8


@dataclass
class Sequences(InputPartition):
    numbers: list[int]


def fetched(feed: str, base: str, numbers: list[int], options: dict[str, str]) -> Iterator[tuple]:
    """Rows of sequences, in their order: a few files are fetched ahead, rows are made only of the one that is read."""
    retries, delay = int(options.get(RETRIES, "4")), float(options.get(RETRY_DELAY, "15"))
    handler = feeds.load_handler(options.get(ERROR_HANDLER), dict(options))
    with ThreadPoolExecutor(FETCHES_PER_TASK) as pool:
        ahead = []
        left = iter(numbers)
        for n in left:
            ahead.append((n, pool.submit(feeds.opened, feed, base, n, retries, delay)))
            if len(ahead) == FETCHES_PER_TASK:
                n, f = ahead.pop(0)
                yield from feeds.rows_of(feed, f.result(), n, handler)
        for n, f in ahead:
            yield from feeds.rows_of(feed, f.result(), n, handler)


class FeedOptions:
    feed: str

    def read_options(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.base = self.options.get(BASE_URI) or feeds.DEFAULT_BASES.get(self.feed)
        if not self.base:
            raise ValueError(f"{BASE_URI} is required for {self.feed}")

    def number(self, key: str) -> int | None:
        return int(self.options[key]) if self.options.get(key) else None

    def current(self) -> int | None:
        return feeds.current_sequence(self.feed, self.base)
