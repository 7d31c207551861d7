"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of three words, weighted by how often each
occurs. For every element, hashed darts fall as a Poisson process on a plane of weights and
ranks, in cells of area one; those within the region below the element's weight count. A
dart belongs to one of k coordinates by its hash, and each coordinate keeps its earliest
dart, by rank. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, drop_path, flat_bytes, id_text, map_arrow, written

#: Coordinates; coordinates of a band. Bands are cut from the coordinates in two orders.
K, ROWS = 256, 4
_ORDERS = (np.arange(K), np.random.default_rng(7).permutation(K))
BANDS = 2 * (K // ROWS)
#: Members of a bucket that are compared with each other, or with as many others, in one go.
BLOCK = 1024
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_R = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a fresh array)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return lower, word


#: Powers that a worker keeps; longer texts make their own and drop them.
_KEPT = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n (at least) of an odd number modulo 2**64, and of its inverse."""

    def make(n: int) -> tuple[np.ndarray, ...]:
        out = []
        for base in (_R, pow(_R, -1, 1 << 64)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a, out=a))
        return tuple(out)

    if n > _KEPT:
        return make(n)
    if not _POWERS:
        _POWERS.extend(make(_KEPT))
    return _POWERS[0], _POWERS[1]


def elements(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of the different shingles of the documents in a buffer, sorted by document.

    A shingle's weight is how often it occurs. Documents of one or two words have one
    shingle; those without words have none.
    """
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float64)
    lower, is_word = _tables()
    n = len(data)
    if not n:
        return none
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[at[:-1]] = True
    edge[n] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    if not len(starts):
        return none
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[data] + np.uint64(1)) * power[:n], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    doc = np.searchsorted(at, starts, "right") - 1
    m = len(words)
    pad = np.concatenate([words, np.zeros(2, np.uint64)])
    pad_doc = np.concatenate([doc, [-1, -1]])
    one, two = pad_doc[1 : m + 1] == doc, pad_doc[2:] == doc
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = two | first
    h = words * np.uint64(0x9FB21C651E98DF25)
    h += np.where(one, pad[1 : m + 1], np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h += np.where(two, pad[2:], np.uint64(2)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h, doc = _mix(h[keep]), doc[keep]
    order = np.argsort(h ^ _mix(doc.astype(np.uint64) + np.uint64(0x1234567)))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    weight = np.diff(np.append(first, len(h))).astype(np.float64)
    h, doc = h[first], doc[first]
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order], weight[order]


#: P(a cell of area one holds at most n darts).
_POISSON = np.exp(-1) * np.cumsum([1 / float(np.prod(np.arange(1, n + 1, dtype=float))) for n in range(16)])


def _throw(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, reach: np.ndarray, out: np.ndarray) -> None:
    """Throw the darts of the elements' regions (weights below ``weight``, ranks below ``reach``); keep the earliest of each coordinate."""
    k = out.shape[1]
    # Columns of cells, one for each begun unit of weight: part of the last one is above the weight.
    columns = np.ceil(weight).astype(np.int64)
    unit = np.repeat(np.arange(len(h)), columns)
    column = np.arange(len(unit)) - np.repeat(np.cumsum(columns) - columns, columns)
    doc, reach, part = doc[unit], reach[unit], weight[unit] - column
    h = _mix(h[unit] + column.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    whole = bool((part >= 1).all())
    cells = np.ceil(reach).astype(np.int64)
    piece = 1 << 18
    total = np.concatenate([[0], np.cumsum(cells)])
    a = 0
    while a < len(h):
        b = max(a + 1, int(np.searchsorted(total, total[a] + piece, "right")) - 1)
        which = np.repeat(np.arange(a, b), cells[a:b])
        cell = np.arange(total[b] - total[a]) - (total[which] - total[a])
        c = _mix(h[which] + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        darts = np.searchsorted(_POISSON, (c >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
        many = np.repeat(np.arange(len(c)), darts)
        nth = np.arange(len(many)) - np.repeat(np.concatenate([[0], np.cumsum(darts)[:-1]]), darts)
        d = _mix(c[many] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))
        rank = cell[many] + (d >> np.uint64(32)).astype(np.float64) * 2.0**-32
        ok = rank < reach[which[many]]
        if not whole:
            ok &= (d & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < part[which[many]]
        d, rank, row = _mix(d[ok]), rank[ok], doc[which[many[ok]]]
        place = row * k + ((d >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
        value = ((rank * 2.0**32).astype(np.uint64) << np.uint64(16)) | (d & np.uint64(0xFFFF))
        np.minimum.at(out.reshape(-1), place, value)
        a = b


def signatures(data: np.ndarray, at: np.ndarray, k: int = K) -> np.ndarray:
    """[document, k] 16-bit prints of the earliest darts; rows of documents without words are zero.

    Ranks up to (ln k + 3) k / weight leave few coordinates without a dart; documents with
    such a coordinate are thrown again, twice as far, until there is none. Ranks end at
    60,000, the most that a key holds: an element of weight one has so many darts there that
    no coordinate is left without one.
    """
    n = len(at) - 1
    doc, h, own = elements(data, at)
    weight = np.bincount(doc, weights=own, minlength=n)
    best = np.full((n, k), _NONE)
    todo, far = np.ones(len(doc), bool), (np.log(k) + 3) * k
    while todo.any():
        _throw(doc[todo], h[todo], own[todo], np.minimum(far / weight[doc[todo]], 60_000.0), best)
        todo &= (best == _NONE).any(axis=1)[doc]
        far *= 2
    return (np.where(best == _NONE, np.uint64(0), best) & np.uint64(0xFFFF)).astype("<u2")


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """[document, band] hashes of the bands of signatures; the band's number is in the low eight bits."""
    out = []
    for order in _ORDERS:
        lanes = sig[:, order[: K // ROWS * ROWS]].astype(np.uint64).reshape(len(sig), -1, ROWS)
        h = np.zeros(lanes.shape[:2], np.uint64)
        for k in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + lanes[:, :, k] + np.uint64(1))
        out.append(h)
    band = np.arange(BANDS, dtype=np.uint64)
    h = _mix(np.concatenate(out, axis=1) + band * np.uint64(0xD1342543DE82EF95))
    return ((h & ~np.uint64(0xFF)) | band).astype(np.int64)


def first_bands(same: np.ndarray) -> np.ndarray:
    """The first band that each row of [pair, coordinate] agreements has in common (BANDS: none)."""
    n = len(same)
    whole = [same[:, order[: K // ROWS * ROWS]].reshape(n, K // ROWS, ROWS).all(axis=2) for order in _ORDERS]
    return np.concatenate([*whole, np.ones((n, 1), bool)], axis=1).argmax(axis=1)


def text_key(text: Column, doc_id: Column) -> Column:
    """16 bytes that equal texts share; a null or empty text has its document's own."""
    return F.unhex(F.md5(F.when(F.length(text) > 0, text).otherwise(F.concat(F.lit("\x00"), F.coalesce(doc_id.cast("string"), F.lit(""))))))


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 19) -> DataFrame:
    """doc_id, key of the text, sig (null where there are no words) of each document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, batch_bytes):
            data, at = flat_bytes(b.column(1))
            sig = signatures(data, at)
            some = sig.any(axis=1).tolist()
            col = pa.array([s.tobytes() if ok else None for s, ok in zip(sig, some)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), col], names=["doc_id", "key", "sig"])

    rows = id_text(docs, id_col, text_col).withColumn("key", text_key(F.col("text"), F.col("doc_id")))
    return map_arrow(rows, run, "doc_id long, key binary, sig binary")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows that are equal in the first ``keys`` columns, and where runs start and end."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        cut = np.flatnonzero(new)
        if len(cut):
            held.append(b.slice(0, cut[-1]))
            yield _cut(held, keys)
            held = []
            b = b.slice(cut[-1])
        held.append(b)
    if held:
        yield _cut(held, keys)


def _cut(held: list[pa.RecordBatch], keys: int) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    new = np.any([np.diff(t.column(k).to_numpy()) != 0 for k in range(keys)], axis=0)
    return t, np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])


def _sets(texts: DataFrame) -> DataFrame:
    """(bucket, nodes): the different sets of two texts or more that meet in a bucket, each with its bucket of the first band."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                hashes = band_hashes(np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, K))
                node = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.ravel()), pa.array(node)], names=["bucket", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _runs(batches, 1):
            n = np.diff(at)
            many = n > 1
            if many.any():
                bucket, node = t.column(0).to_numpy()[at[:-1][many]], t.column(1).to_numpy()[np.repeat(many, n)]
                nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[many])]).astype(np.int32)), pa.array(node))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), nodes], names=["bucket", "nodes"])

    members = map_arrow(texts.select("node", "sig"), bands, "bucket long, node long")
    found = map_arrow(members.repartition("bucket").sortWithinPartitions("bucket", "node"), meet, "bucket long, nodes array<long>")
    first = F.min(F.struct((F.col("bucket").bitwiseAND(F.lit(0xFF))).alias("band"), "bucket")).alias("first")
    return found.groupBy("nodes").agg(first).select("first.bucket", "nodes")


def _compare(t: pa.Table, at: np.ndarray, threshold: float) -> pa.RecordBatch:
    """(node, n, sim, low) of the members of whole blocks (rows: bucket, i, j, node, block, sig) that have links counted there."""
    bucket, i, j, node, block = (t.column(k).to_numpy() for k in range(5))
    sig = np.frombuffer(b"".join(t.column(5).to_pylist()), "<u2").reshape(-1, K)
    least = int(np.ceil(threshold * K - 1e-9))
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def judge(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            same = sig[x] == sig[y]
            n = np.count_nonzero(same, axis=1)
            ok = n >= least
            x, y, n, same = x[ok], y[ok], n[ok], same[ok]
            # A pair that meets in several sets counts in that of its first common band only.
            own = first_bands(same) == (bucket[x] & 0xFF)
            links.append((x[own], y[own], n[own]))

    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    size = 0
    for s, e in zip(at[:-1], at[1:]):
        if i[s] == j[s]:
            a, b = np.triu_indices(e - s, 1)
            a, b = a + s, b + s
        else:
            one, two = np.flatnonzero(block[s:e] == i[s]) + s, np.flatnonzero(block[s:e] == j[s]) + s
            a, b = np.repeat(one, len(two)), np.tile(two, len(one))
        left.append(a)
        right.append(b)
        size += len(a)
        if size > 1 << 17:
            judge(np.concatenate(left), np.concatenate(right))
            left, right, size = [], [], 0
    if left:
        judge(np.concatenate(left), np.concatenate(right))
    a, b, n = (np.concatenate([x[k] for x in links]) if links else np.empty(0, np.int64) for k in range(3))
    count = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
    best = np.zeros(len(node), np.int64)
    np.maximum.at(best, a, n)
    np.maximum.at(best, b, n)
    # Rows of a block are in the order of nodes, so the least row of a connected part is its least node.
    low = np.arange(len(node))
    while True:
        least_of = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least_of)
        np.minimum.at(new, b, least_of)
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = count > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(node[some]), pa.array(count[some]), pa.array(best[some] / K), pa.array(node[low[some]])], names=["node", "n", "sim", "low"]
    )


def _links(texts: DataFrame, threshold: float, keep: list[str]) -> DataFrame:
    """(node, n, sim, low): links of different texts (node, sig) that share a band and agree in ``threshold`` of the coordinates.

    All pairs of a bucket's members are compared, in blocks of ``BLOCK`` by ``BLOCK`` members
    that tasks share out, so that large buckets spread. Buckets with the same members are
    compared once, and a pair counts in one bucket only. Pairs aren't listed: a row says how
    many links (n) a node has in a block, the best share (sim) and the least node (low) that it
    is joined to there. A node has a row for each block in which it has links.
    """
    sets = written(_sets(texts), keep)
    rows = sets.select("bucket", F.size("nodes").alias("size"), F.posexplode("nodes").alias("pos", "node"))
    block = (F.col("pos") / BLOCK).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / BLOCK).cast("int"))))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
    rows = rows.join(texts.select("node", "sig"), "node").select("bucket", "i", "j", "node", "block", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _runs(batches, 3):
            yield _compare(t, at, threshold)

    return map_arrow(rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node"), run, "node long, n long, sim double, low long")


def components(links: DataFrame, keep: list[str]) -> DataFrame:
    """(node, root) of every node of the links (a, b): the least node that it is joined to.

    Each round takes the least root among neighbours, then the root's root; rounds grow with
    the logarithm of the longest chain, and each is written, so that no lineage builds up.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), keep)
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), keep)
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        step = written(step, keep)
        up = step.select(F.col("node").alias("next"), F.col("next").alias("top"))
        jumped = written(step.join(up, "next").select("node", "root", F.least("next", "top").alias("to")), keep)
        if jumped.where(F.col("to") != F.col("root")).isEmpty():
            return roots
        roots = jumped.select("node", F.col("to").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.45) -> DataFrame:
    """Near-duplicate classes: doc_id, key, root, n_links, n_copies, sim for each document row.

    ``key`` names the text, ``root`` the class. ``n_links`` counts the different texts that the
    row's text is joined to (at least ``threshold`` of the coordinates agree), ``n_copies`` the
    rows that have just this text, ``sim`` is the best link's share (null without a link).

    Exact copies share a class and are signed once; repeated rows are copies. Null or empty
    texts stand alone (rows of one id with such texts are copies of each other). Texts
    without words are joined to exact copies only. Texts are signed whole, however long; an
    empty table gives no rows. Ties go to the lesser key. Other columns are ignored. Exact copies shrink before each shuffle; all pairs that share a band are
    compared, but not listed. Tables in between are written to the shared folder.
    """
    spark = docs.sparkSession
    keep: list[str] = []
    big: list[str] = []
    signed = written(sign(docs, id_col, text_col), big)
    rows = written(signed.select("doc_id", "key"), keep)
    # Written, so that the numbers of the texts stay as they are.
    texts = signed.groupBy("key").agg(F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), keep)
    drop_path(spark, big[0])
    links = written(_links(texts.where(F.col("sig").isNotNull()), threshold, keep), keep)
    ends = links.groupBy("node").agg(F.sum("n").alias("n_links"), F.max("sim").alias("sim"))
    joined = links.where("low != node").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    info = texts.select("key", "node", "n_copies").join(components(joined, keep), "node", "left").join(ends, "node", "left")
    info = info.select("key", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "sim")
    out = written(rows.join(info, "key"))
    for path in keep:
        drop_path(spark, path)
    return out


def with_class_ids(found: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links, n_copies of each row."""
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "root").select("doc_id", "class_id", "n_links", "n_copies")


def deduplicate(docs: DataFrame, threshold: float = 0.45, broadcast_rows: int = 200_000) -> DataFrame:
    """One document of each class, that of the least doc_id (ties: the lesser text key); all columns stay.

    Needs the columns doc_id and text. The rows to drop are broadcast if there are at most
    ``broadcast_rows``, which is counted; else the documents are joined to the rows that
    stay by a shuffle. Of rows that repeat id and text, one stays. Null and empty texts stay
    (one for each id), null ids are an id of their own; an empty table stays empty.
    """
    found = classes(docs, threshold=threshold)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("best"))
    rows = found.join(best, "root").select("doc_id", "key", (F.struct("doc_id", "key") == F.col("best")).alias("stays"))
    tally = written(rows.groupBy("doc_id", "key", "stays").count())
    own, theirs, theirs_id = ("__" + "_" * max(map(len, docs.columns)) + x for x in ("text", "key", "id"))
    marked = docs.withColumn(own, text_key(F.col("text"), F.col("doc_id")))
    match = F.col("doc_id").eqNullSafe(F.col(theirs_id)) & (F.col(own) == F.col(theirs))
    ids = [F.col("doc_id").alias(theirs_id), F.col("key").alias(theirs)]
    drop = tally.where("not stays").select(*ids)
    if drop.count() <= broadcast_rows:
        kept = marked.join(F.broadcast(drop), match, "left_anti")
    else:
        kept = marked.join(tally.where("stays").select(*ids), match, "left_semi")
    if not tally.where("stays and count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)
