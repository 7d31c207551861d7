"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language are summed in the cluster; the matrix of log-probabilities
(languages x buckets, of fixed size) is broadcast, and batches are scored in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, id_text, map_arrow, sampled

ORDERS = (2, 3)
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, with spaces before each text, and where each begins.

    There are so many spaces that no n-gram reaches from one text into the next.
    """
    gap = " " * (max(ORDERS) - 1)
    joined = gap.join(["", *texts.to_pylist()])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + len(gap), out=at[1:])
    return _folding()[np.minimum(points, 0x10FFFF)], at


def buckets(points: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each place (the last places see spaces)."""
    padded = np.append(points, np.full(max(ORDERS), 32, np.uint32))
    n = len(points)
    for order in ORDERS:
        h = np.full(n, order, np.uint32)
        for k in range(order):
            h = (h ^ padded[k : k + n]) * _MULTIPLY[k]
            h ^= h >> np.uint32(15)
        yield (h * _MULTIPLY[2]) >> np.uint32(32 - bits)


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    bits: int = 16,
    max_docs: int = 50_000,
    smoothing: float = 0.5,
) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-probabilities [language, bucket].

    Rows with a null text or language are left out. At most about ``max_docs`` labelled
    rows, chosen by a hash of the id, are counted, each whole. Counted are the n-grams that
    begin at a letter. Priors are equal; repeated rows count again; from an empty table no
    language is learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = sampled(rows, id_col, max_docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in by_bytes(batches, 4 << 20):
            points, at = folded(b.column(1))
            letters = points != 32
            langs = b.column(0).to_pylist()
            for h in buckets(points, bits):
                for k, lang in enumerate(langs):
                    if lang not in sums:
                        sums[lang] = np.zeros(1 << bits, np.int64)
                    # n-grams that begin at a letter, as in scoring
                    part = h[at[k] : at[k + 1]][letters[at[k] : at[k + 1]]]
                    if len(part) > 1 << 12:
                        sums[lang] += np.bincount(part, minlength=1 << bits)
                    else:
                        np.add.at(sums[lang], part, 1)
        for lang, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(s[some])],
                names=["lang", "bucket", "n"],
            )

    counts = map_arrow(rows, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    table = np.full((len(langs), 1 << bits), smoothing)
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        row = np.array([place[x] for x in got["lang"].to_pylist()])
        np.add.at(table, (row, got["bucket"].to_numpy()), got["n"].to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(
    docs: DataFrame,
    langs: list[str],
    table: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """doc_id, lang_pred and score of each document row.

    The score is the posterior of the language, from the mean log-probability of an n-gram
    times the square root of their number, so that long texts don't saturate at once. A null
    text and one without a letter are ``und`` with score 0, as all are if no language was
    learned. Equal scores go to the language that sorts first. Texts are read whole, however
    long; repeated rows are each answered; other columns are ignored; an empty table gives no
    rows. One scan, no shuffle.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        bits = int(logs.shape[1]).bit_length() - 1
        for b in by_bytes(batches, batch_bytes):
            points, at = folded(b.column(1))
            letters = points != 32
            n = np.add.reduceat(np.append(letters, False).astype(np.int64), at[:-1])
            totals = np.zeros((len(names), b.num_rows), np.float64)
            for h in buckets(points, bits):
                for k in range(len(names)):
                    got = logs[k][h]
                    got[~letters] = 0
                    totals[k] += np.add.reduceat(np.append(got, np.float32(0)), at[:-1], dtype=np.float64)
            known = (n > 0) & (len(names) > 0)
            if len(names):
                x = totals / np.sqrt(np.maximum(n, 1)) / len(ORDERS)
                best = x.argmax(axis=0)
                score = 1 / np.exp(x - x.max(axis=0)).sum(axis=0)
            else:
                best, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            pred = [names[j] if ok else "und" for j, ok in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, learn: Column, max_docs: int = 50_000) -> DataFrame:
    """Learn from the rows where ``learn`` holds, then identify the language of every row."""
    langs, table = train(docs.where(learn), max_docs=max_docs)
    return identify(docs, langs, table)
