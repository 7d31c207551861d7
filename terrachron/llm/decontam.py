"""Benchmark decontamination with an FM-index per training shard.

The words of a shard become symbols; a Burrows-Wheeler transform with a wavelet
matrix answers rank queries, every test phrase is searched backward, occurrences are
located from sampled suffix positions, and covered words merge into removal spans.

Before a shard is indexed, words that cannot lie in an occurrence are left out: an
occurrence of a window is a stretch in which each pair of neighbours is a pair of
neighbours in some test phrase. Longest such stretches that are at least as long as
the shortest window are indexed, all others cannot hold one, so that this is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import by_bytes, drop_path, id_text, map_arrow, written

#: A-Z to a-z; bytes of no word (0x00-0x2F, 0x3A-0x60, 0x7B-0x7F) to a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, lower-cased in A-Z only; null has none."""
    return raw.translate(_TABLE).split() if raw else []


class WaveletMatrix:
    """Rank over integers in ``bits`` binary levels, vectorised over queries."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        cur = symbols
        for b in range(bits - 1, -1, -1):
            one = (cur >> b) & 1
            ranks = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(one, out=ranks[1:])
            self.levels.append(ranks)
            self.zeros.append(len(cur) - int(ranks[-1]))
            cur = np.concatenate([cur[one == 0], cur[one == 1]])

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``pos``."""
        lo, hi = np.zeros_like(pos), pos.copy()
        for level, (ranks, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            rl, rh = ranks[lo].astype(np.int64), ranks[hi].astype(np.int64)
            lo = np.where(one, zeros + rl, lo - rl)
            hi = np.where(one, zeros + rh, hi - rh)
        return hi - lo

    def access(self, pos: np.ndarray) -> np.ndarray:
        """The symbols at ``pos``."""
        out = np.zeros_like(pos)
        at = pos.copy()
        for ranks, zeros in zip(self.levels, self.zeros):
            before = ranks[at].astype(np.int64)
            one = ranks[at + 1] > ranks[at]
            at = np.where(one, zeros + before, at - before)
            out = out * 2 + one
        return out


class FMIndex:
    """FM-index of an integer sequence that ends in a unique least symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16) -> None:
        n = len(symbols)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, int(sigma - 1).bit_length()))
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma), out=self.before[1:])
        marked = sa % sample == 0
        self.marked, self.mark_rank = marked, np.concatenate([[0], np.cumsum(marked)])
        self.samples, self.n = sa[marked], n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns, one per row."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j].astype(np.int64)
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled position."""
        out, at = np.zeros_like(rows), rows.copy()
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            known = self.marked[at]
            out[todo[known]] = self.samples[self.mark_rank[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                c = self.wavelet.access(at)
                at = self.before[c] + self.wavelet.rank(c, at)
                steps += 1
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol is unique and least."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        s = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if new[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = new[k:] + 1
        rank = new * (n + 1) + second
        order = np.argsort(rank, kind="stable")
        k *= 2


class Phrases:
    """Windows of the test items, as symbols, and what is needed to find candidates."""

    def __init__(self, items: list[tuple[int, str | None]], window: int) -> None:
        ids: dict[bytes, int] = {}
        by_window: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            s = [ids.setdefault(w, len(ids) + 2) for w in words(text.encode() if text else None)]
            for i in range(max(1, len(s) - window + 1) if s else 0):
                by_window.setdefault(tuple(s[i : i + window]), set()).add(str(item))
        self.ids, self.sigma = ids, len(ids) + 2
        self.windows = list(by_window)
        self.items = [by_window[w] for w in self.windows]
        self.shortest = min(map(len, self.windows), default=0)
        self.pairs = np.array(sorted({a * self.sigma + b for w in self.windows for a, b in zip(w, w[1:])}), np.int64)
        self.by_length: dict[int, np.ndarray] = {}
        for n in sorted({len(w) for w in self.windows}):
            self.by_length[n] = np.array([i for i, w in enumerate(self.windows) if len(w) == n])

    def stretches(self, s: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the longest stretches of known neighbours that may hold a window."""
        if not self.windows or len(s) < self.shortest:
            return []
        known = s > 0
        if np.count_nonzero(known) < self.shortest:
            return []
        join = known[1:] & known[:-1]
        if len(self.pairs):
            at = np.flatnonzero(join)
            code = s[at] * self.sigma + s[at + 1]
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
            join[at[~found]] = False
        else:
            join[:] = False
        cut = np.flatnonzero(~join) + 1
        starts = np.concatenate([[0], cut])
        ends = np.concatenate([cut, [len(s)]])
        keep = (ends - starts >= self.shortest) & known[starts]
        return list(zip(starts[keep].tolist(), ends[keep].tolist()))


class Shard:
    """Candidate stretches of some documents, indexed and searched at once."""

    def __init__(self, phrases: Phrases) -> None:
        self.p, self.symbols, self.docs, self.places, self.size = phrases, [], [], [], 0

    def add(self, doc: int, s: np.ndarray, stretches: list[tuple[int, int]]) -> None:
        for a, b in stretches:
            self.symbols += [s[a:b], np.array([1])]
            self.docs.append(np.full(b - a + 1, doc))
            self.places.append(np.append(np.arange(a, b), -1))
            self.size += b - a + 1

    def hits(self) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For each document with a hit: places of the words hit (ascending), and the items."""
        if not self.symbols:
            return {}
        p = self.p
        text = np.concatenate([*self.symbols, [0]]).astype(np.int64)
        docs, places = np.concatenate([*self.docs, [-1]]), np.concatenate([*self.places, [-1]])
        index = FMIndex(text, p.sigma)
        cover = np.zeros(len(text) + 1, np.int64)
        found: list[np.ndarray] = []
        for n, which in p.by_length.items():
            lo, hi = index.search(np.array([p.windows[i] for i in which]))
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            count = (hi - lo)[some]
            first = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            at = index.locate(first + np.arange(count.sum()))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            found.append(np.unique(np.stack([docs[at], np.repeat(which[some], count)]), axis=1))
        covered = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        order = covered[np.lexsort((places[covered], docs[covered]))]
        if len(order):
            d = docs[order]
            for part in np.split(order, np.flatnonzero(np.diff(d)) + 1):
                out[int(docs[part[0]])] = (places[part], set())
        for pairs in found:
            for doc, window in pairs.T.tolist():
                out[doc][1].update(p.items[window])
        return out


def word_spans(raw: bytes, places: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the words at ``places``; neighbouring words merge to one span."""
    bounds = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    return [(bounds[int(p[0])][0], bounds[int(p[-1])][1]) for p in np.split(places, cut) if len(p)]


def code_points(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as spans of code points."""
    if not spans:
        return []
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[a]), int(chars[b])) for a, b in spans]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less some spans (sorted, disjoint)."""
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


class Searcher:
    """Feeds documents to shards of bounded size and gives the hits of each shard."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, shard_symbols: int) -> None:
        self.phrases, self.most = Phrases(items, window), shard_symbols
        self.shard, self.rows, self.kept = Shard(self.phrases), [], 0

    def add(self, raw: bytes | None, keep: bool, *more: object) -> None:
        p, w = self.phrases, words(raw)
        found = []
        if len(w) >= p.shortest > 0:
            s = np.fromiter(map(p.ids.get, w, repeat(0)), np.int64, len(w))
            if found := p.stretches(s):
                self.shard.add(len(self.rows), s, found)
        kept = raw if found or keep else None
        self.rows.append((len(w), kept, more))
        self.kept += len(kept) if kept else 0

    def full(self) -> bool:
        return self.shard.size >= self.most or len(self.rows) >= 50_000 or self.kept > 8 << 20

    def flush(self) -> Iterator[tuple[int, bytes | None, tuple, np.ndarray, set[str]]]:
        """(number of words, text where kept, what came with it, places hit, items) of each row."""
        hits, none = self.shard.hits(), (np.empty(0, np.int64), set())
        for k, (n, raw, more) in enumerate(self.rows):
            yield n, raw, more, *hits.get(k, none)
        self.shard, self.rows, self.kept = Shard(self.phrases), [], 0

    def cleaned(self, raw: bytes, places: np.ndarray) -> bytes:
        """The text less its hits, searched again until no window is left."""
        while len(places):
            raw = without(raw, word_spans(raw, places))
            s = np.fromiter(map(self.phrases.ids.get, words(raw), repeat(0)), np.int64)
            shard = Shard(self.phrases)
            shard.add(0, s, self.phrases.stretches(s))
            places = shard.hits().get(0, ((), set()))[0]
        return raw


SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"
)


def _overlapping(w: list[bytes], window: int, most: int) -> Iterator[bytes]:
    """The words as texts of about ``most`` bytes, each window whole in one of them."""
    at = 0
    while at < len(w):
        end, size = min(len(w), at + window), sum(len(x) + 1 for x in w[at : at + window])
        while end < len(w) and size + len(w[end]) < most:
            size += len(w[end]) + 1
            end += 1
        yield b" ".join(w[at:end])
        if end == len(w):
            return
        at = end - window + 1


def _parts(benchmark: DataFrame, window: int, most: int, keep: list[str]) -> list[DataFrame]:
    """The items (item_id, text) in parts of at most ``most`` bytes of text: one, unless the benchmark is larger.

    Long items of a larger one are cut into pieces that share all but one word of a window.
    """
    bench = id_text(benchmark, "item_id", "text").withColumnRenamed("doc_id", "item_id")
    size = bench.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= most:
        return [bench]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 4 << 20):
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for piece in _overlapping(words(raw), window, max(1, most // 8)):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([piece.decode()], pa.string())], names=["item_id", "text"])

    cut_up = written(map_arrow(bench, cut, "item_id long, text string").distinct(), keep)
    n, pieces = 2, cut_up.count()
    part = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while n <= 4 * pieces:
        largest = cut_up.groupBy(part(n).alias("part")).agg(F.sum(F.octet_length("text")).alias("size")).agg(F.max("size")).first()[0]
        if largest <= most:
            break
        n *= 2
    return [cut_up.where(part(n) == p) for p in range(n)]


def _shared(part: DataFrame) -> Broadcast:
    """A part of the items (of a size that :func:`_parts` bounds), sent to the workers."""
    return part.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.toLocalIterator()])


def _marked(rows: DataFrame, parts: list[DataFrame], window: int, shard_symbols: int, batch_bytes: int, keep: list[str]) -> DataFrame:
    """``rows`` (c0, ..., one of them ``text``) with places (of words hit) and items, over all parts of a large benchmark.

    A part is searched in each scan; what it finds joins what the parts before found.
    """
    at = rows.columns.index("text")
    rows = rows.withColumns({"places": F.expr("cast(array() as array<int>)"), "items": F.expr("cast(array() as array<string>)")})
    for part in parts:
        shared = _shared(part)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            found = Searcher(shared.value, window, shard_symbols)
            for b in by_bytes(batches, batch_bytes):
                places, items = (b.column(b.num_columns - k).to_pylist() for k in (2, 1))

                def take() -> None:
                    for _, _, (k,), more, names in found.flush():
                        if len(more):
                            places[k] = sorted({*places[k], *more.tolist()})
                            items[k] = sorted({*items[k], *names})

                for k, raw in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
                    found.add(raw, False, k)
                    if found.full():
                        take()
                take()
                new = [pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *new], names=b.schema.names)

        before = rows
        rows = written(map_arrow(before, run, before.schema), keep)
        shared.unpersist()
    return rows


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    shard_symbols: int = 500_000,
    max_benchmark_bytes: int = 64 << 20,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Occurrences of benchmark windows in documents, one row per document row.

    Words are stretches of ``[0-9A-Za-z]`` and characters from U+0080 on, lower-cased in
    A-Z. A window is ``window`` consecutive words of an item; a shorter item is one
    window. Returns doc_id, n_words, n_hit (words inside any occurrence), n_items,
    items (sorted as strings) and spans (code points, end exclusive; touching hit words
    are one span).

    Null or empty texts and texts without words have no words and no hit; long texts are
    searched whole. Repeated rows are each answered. Equal item ids with other texts count
    as one item; items without words have no window; an empty benchmark contaminates
    nothing, an empty table of documents gives no rows. Other columns of either table are
    ignored.

    One scan of the documents, no shuffle, while the benchmark's texts take at most
    ``max_benchmark_bytes``, which is counted before they are sent to the workers; a larger
    one is sent in parts of that size, with a scan of the documents for each. Each task
    indexes its documents in shards of about ``shard_symbols`` candidate words.
    """
    types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"]

    def row(doc: int, n: int, raw: bytes | None, places: np.ndarray, items: list[str]) -> tuple:
        spans = code_points(raw, word_spans(raw, places)) if len(places) else []
        return doc, n, len(places), len(items), items, [{"start": a, "end": b} for a, b in spans]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    keep: list[str] = []
    parts = _parts(benchmark, window, max_benchmark_bytes, keep)
    texts = id_text(docs, id_col, text_col)
    if len(parts) > 1:

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, batch_bytes):
                cols = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
                yield batch([row(doc, len(words(raw)), raw, np.array(p, np.int64), items) for doc, raw, p, items in zip(*cols)])

        marked = _marked(texts, parts, window, shard_symbols, batch_bytes, keep)
        for path in keep[:-1]:
            drop_path(docs.sparkSession, path)
        return map_arrow(marked, finish, SCHEMA)
    shared = _shared(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Searcher(shared.value, window, shard_symbols)
        for b in by_bytes(batches, batch_bytes):
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found.add(raw, False, doc)
                if found.full():
                    yield batch([row(doc, n, raw, places, sorted(items)) for n, raw, (doc,), places, items in found.flush()])
        yield batch([row(doc, n, raw, places, sorted(items)) for n, raw, (doc,), places, items in found.flush()])

    return map_arrow(texts, run, SCHEMA)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shard_symbols: int = 500_000,
    max_benchmark_bytes: int = 64 << 20,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """The documents with benchmark passages cut out of their texts; all columns and rows stay.

    Needs the column ``text``; a text without hit (null and empty ones included) stays as it
    is, long texts are searched whole, repeated rows are each cut, an empty table stays
    empty. A cut text is searched again, so that no window arises where it was joined. A
    column ``n_chars``, if there is one, is counted anew for texts that were cut. The texts
    are cut in the scan that finds the passages: nothing is joined or shuffled. A benchmark
    of more than ``max_benchmark_bytes`` is searched in parts, a scan of the texts for each,
    until no text has a hit.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else -1
    safe = [f"c{i}" if i != at else "text" for i in range(len(names))]
    to = StructType([StructField(c, f.dataType) for c, f in zip(safe, schema)])

    def with_texts(b: pa.RecordBatch, texts: list[bytes | None], new: dict[int, bytes]) -> list[pa.Array]:
        """The columns of the documents, some texts (by row) replaced."""
        cols = list(b.columns[: len(safe)])
        if new:
            cols[at] = pa.array([new.get(k, raw) for k, raw in enumerate(texts)], pa.binary()).cast(cols[at].type)
            if count >= 0:
                old = cols[count].to_pylist()
                cols[count] = pa.array([len(new[k].decode()) if k in new else v for k, v in enumerate(old)], cols[count].type)
        return cols

    keep: list[str] = []
    parts = _parts(benchmark, window, max_benchmark_bytes, keep)
    if len(parts) > 1:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, batch_bytes):
                texts = b.column(at).cast(pa.binary()).to_pylist()
                places = b.column(len(safe)).to_pylist()
                new = {k: without(raw, word_spans(raw, np.array(p, np.int64))) for k, (raw, p) in enumerate(zip(texts, places))}
                yield pa.RecordBatch.from_arrays(with_texts(b, texts, new), names=safe)

        done, todo = None, docs.toDF(*safe)
        while True:
            marked = _marked(todo, parts, window, shard_symbols, batch_bytes, keep)
            clean, hit = marked.where("size(places) = 0").select(*safe), marked.where("size(places) > 0")
            done = clean if done is None else done.unionByName(clean)
            if hit.isEmpty():
                return done.toDF(*names)
            todo = written(map_arrow(hit, cut, to), keep)
    shared = _shared(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Searcher(shared.value, window, shard_symbols)
        for b in by_bytes(batches, batch_bytes):
            new: dict[int, bytes] = {}
            texts = b.column(at).cast(pa.binary()).to_pylist()
            for k, raw in enumerate(texts):
                found.add(raw, False, k)
                if found.full() or k + 1 == len(texts):
                    new |= {j: found.cleaned(own, places) for _, own, (j,), places, _ in list(found.flush()) if len(places)}
            yield pa.RecordBatch.from_arrays(with_texts(b, texts, new), names=safe)

    return map_arrow(docs.toDF(*safe), run, to).toDF(*names)
