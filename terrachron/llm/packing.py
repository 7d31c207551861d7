"""Best-fit packing of token sequences by bin completion.

Pieces of equal length can stand for each other, so bins are planned on the histogram of
lengths, which has at most as many entries as a bin has tokens: around the largest piece
left, undominated fillings are tried in turn, with backtracking, pruned by what waste the
best known packing allows, and the best-fit packing is the first incumbent. The plan (bin patterns with
their counts, of bounded size) is broadcast; pieces find their place by rank among equals.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, id_text, map_arrow, written

# --------------------------------------------------------------------------- planning

Pattern = tuple[tuple[int, int], ...]  #: (length, how many), by falling length


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The least number of bins: for each k, pieces over half a bin, and what of the smaller ones (from k) they leave over."""
    size = np.array(sorted(s for s, n in counts.items() if n), np.int64)
    if not len(size):
        return 0
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    upto, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    half = int(np.searchsorted(size, capacity // 2, "right"))  # those from here on take more than half a bin
    k = size[:half]
    fits = np.maximum(np.searchsorted(size, capacity - k, "right"), half)  # the larger ones that leave room for k
    small = sums[half] - sums[: len(k)]
    room = (upto[fits] - upto[half]) * capacity - (sums[fits] - sums[half])
    with_k = upto[-1] - upto[half] + np.maximum(0, -(-(small - room) // capacity))
    return max(-(-int(sums[-1]) // capacity), int(upto[-1] - upto[half]), int(with_k.max(initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are kept and filled together."""
    rooms: dict[int, dict[Pattern, int]] = {}
    order: list[int] = []  # rooms left over, ascending
    done: dict[Pattern, int] = {}

    def put(pattern: Pattern, n: int, room: int) -> None:
        if not room:
            done[pattern] = done.get(pattern, 0) + n
            return
        if room not in rooms:
            rooms[room] = {}
            order.insert(bisect_right(order, room), room)
        rooms[room][pattern] = rooms[room].get(pattern, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(order, size - 1)
            if at == len(order):
                each = min(capacity // size, left)
                bins = left // each
                put(((size, each),), bins, capacity - size * each)
                left -= bins * each
                continue
            room = order[at]
            pattern, n = rooms[room].popitem()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // size, left)
            bins = min(n, left // each)
            if bins < n:
                put(pattern, n - bins, room)
            put((*pattern, (size, each)), bins, room - size * each)
            left -= bins * each
    for patterns in rooms.values():
        for p, n in patterns.items():
            done[p] = done.get(p, 0) + n
    return list(done.items())


def _fillings(sizes: list[int], have: dict[int, int], room: int, slack: int, steps: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(waste, filling) of the undominated fillings of ``room`` by ``sizes`` (falling) that waste at most ``slack``; first those without waste.

    A filling is dominated if a further piece fits, or if a left piece can take the place of
    a smaller one, or of two, of the filling. ``steps`` counts down; the search ends at 0.
    """
    rest = [0] * (len(sizes) + 1)  # what all pieces from a place on can fill
    for i in range(len(sizes) - 1, -1, -1):
        rest[i] = rest[i + 1] + sizes[i] * have[sizes[i]]

    def dominated(chosen: list[tuple[int, int]], left: int) -> bool:
        used = dict(chosen)
        spare = [s for s in sizes if have[s] > used.get(s, 0)]  # falling

        def replaces(s: int) -> bool:  # a left piece of more than s, but no more than s and the room
            at = bisect_left(spare, -(s + left), key=lambda x: -x)
            return at < len(spare) and s < spare[at]

        if not left:
            return False
        if spare and spare[-1] <= left or any(replaces(s) for s in used):
            return True
        twos = [s + t for i, (s, c) in enumerate(chosen) for t in [*([s] if c > 1 else []), *(t for t, _ in chosen[i + 1 :])]]
        return any(replaces(s) or s in have and have[s] > used.get(s, 0) for s in twos)

    def go(i: int, room: int, low: int, high: int, chosen: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        steps[0] -= 1
        if low <= room <= high and not dominated(chosen, room):
            yield room, list(chosen)
        j = bisect_left(sizes, -room, i, key=lambda x: -x)  # the first that still fits
        while j < len(sizes) and steps[0] > 0 and rest[j] >= room - high:
            s = sizes[j]
            for c in range(min(room // s, have[s]), 0, -1):
                chosen.append((s, c))
                yield from go(j + 1, room - s * c, low, high, chosen)
                chosen.pop()
            j += 1

    yield from go(0, room, 0, 0, [])
    if slack > 0:
        yield from go(0, room, 1, slack, [])


def complete(counts: dict[int, int], capacity: int, budget: int = 500_000) -> list[tuple[Pattern, int]]:
    """Patterns and their counts that hold all pieces in few bins: bin completion, branch and bound.

    Best fit is the first incumbent. Depth first, the largest piece left gets each of its
    undominated fillings in turn, as often as pieces last, then once; a branch is given up once
    its waste exceeds what one bin less than the incumbent can waste, or once the bins used and
    the lower bound of the rest reach the incumbent. The search ends at the lower bound, when
    all branches are done (both: the plan is optimal), or after ``budget`` steps.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    held, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    have = dict(counts)
    plan: list[tuple[dict[int, int], int, int]] = []
    waste, bins, steps = 0, 0, [budget]

    def moves() -> Iterator[tuple[dict[int, int], int, int]]:
        """(pieces, how many bins, waste a bin) for the largest piece left."""
        sizes = sorted((s for s, n in have.items() if n), reverse=True)
        big, left = sizes[0], {s: have[s] for s in sizes}
        left[big] -= 1
        fit = [s for s in sizes if left[s] and s <= capacity - big]
        for lost, filling in _fillings(fit, left, capacity - big, (held - 1) * capacity - total - waste, steps):
            own = {big: 1}
            for s, c in filling:
                own[s] = own.get(s, 0) + c
            n = min((left[s] + (s == big)) // c for s, c in own.items())
            if lost:
                n = max(1, min(n, ((held - 1) * capacity - total - waste) // lost))
            yield own, n, lost
            if n > 1:
                yield own, 1, lost

    def apply(own: dict[int, int], n: int, lost: int, sign: int) -> None:
        nonlocal waste, bins
        for s, c in own.items():
            have[s] -= sign * n * c
        waste, bins = waste + sign * n * lost, bins + sign * n

    open_moves = [moves()] if held > bound else []
    while open_moves and held > bound and steps[0] > 0:
        move = next(open_moves[-1], None)
        if move is None:
            open_moves.pop()
            if plan:
                apply(*plan.pop(), -1)
            continue
        apply(*move, 1)
        if waste <= (held - 1) * capacity - total:
            rest = lower_bound(have, capacity)
            if not rest:
                plan.append(move)
                best, held = [(tuple(sorted(own.items(), reverse=True)), n) for own, n, _ in plan], bins
                plan.pop()
            elif bins + rest < held:
                plan.append(move)
                open_moves.append(moves())
                continue
        apply(*move, -1)
    return best


# --------------------------------------------------------------------------- tokens


class _Words(dict):
    """Ids by word, made when a word is first asked for; words not asked for lately are forgotten."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.before.get(word) or self.make(word)
        return out

    def age(self, most: int) -> None:
        """Begin anew once there are ``most`` words; those so far are kept until the next time."""
        if len(self) >= most:
            self.before = dict(self)
            self.clear()


class ByteLevel:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian 32-bit bytes.

    Words of plain text (characters below U+0250) are cut as the file's own pattern cuts
    them and encoded once per worker; any other text, and one that holds an added token's
    string, is encoded whole by the library.
    """

    MEMORY = 150_000
    _L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    _N = "0-9²³¹¼-¾"
    _S = r" \t\n\r\x0b\x0c\x85\xa0"

    def __init__(self, path: str) -> None:
        import json
        import re

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.tokenize = self.model.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and not (spec["model"].get("dropout"))
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]

        def cut(l: str, n: str, s: str) -> Callable[[str], list[str]]:  # noqa: E741
            return re.compile(rf" ?[{l}]+| ?[{n}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall

        # Small character classes are matched faster.
        self.cut = cut(self._L, self._N, self._S)
        self.cut_latin = cut(self._L.replace("ɏ", "ÿ"), self._N, self._S)
        # The model itself takes words in the alphabet that stands for bytes, in its known order.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in seen)}
        probes = [" the", "Ab", "é", "12", " #!", "\n\t", "\x7f\xad\x00"]
        self.direct = all(self.word(w) == self.whole(w) for w in probes)
        self.ids = _Words(self.word if self.direct else self.whole)

    def word(self, word: str) -> bytes:
        """Ids of one word by the model alone."""
        simple = word.isascii() and word.isprintable()
        made = self.tokenize(word.replace(" ", "Ġ") if simple else word.encode().decode("latin-1").translate(self.bytes))
        return array("I", [t.id for t in made]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ways(self, texts: list[str]) -> list[Callable[[str], list[str]] | None]:
        """How each text is cut to words; None where it must be encoded whole."""
        if not self.plain:
            return [None] * len(texts)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([0, *map(len, texts)])
        odd, wide = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) > 0 for x in ((points > 0x24F) | (points >= 0x1C) & (points < 0x20), points > 0xFF))
        if any(t in joined for t in self.added):
            odd |= np.array([any(t in x for t in self.added) for x in texts])
        return [None if o else self.cut if w else self.cut_latin for o, w in zip(odd.tolist(), wide.tolist())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.ids.age(self.MEMORY)
        get = self.ids.__getitem__
        return [self.whole(t) if cut is None else b"".join(map(get, cut(t))) for t, cut in zip(texts, self.ways(texts))]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevel:
    return ByteLevel(path)


def pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document row.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into pieces of
    ``capacity`` ids, of which the first may be shorter.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in by_bytes(batches, batch_bytes):
            rows: list[list] = [[] for _ in names]
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    for col, v in zip(rows, (doc, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]))):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return map_arrow(
        id_text(docs, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


# --------------------------------------------------------------------------- places


def _slots(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its ranks begin in each pattern, and bin, slots a bin and offset there."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    bins = 0
    for pattern, n in plan:
        offset = 0
        for s, c in pattern:
            rank = at.get(s, 0)
            rows.setdefault(s, []).append((rank, bins, c, offset))
            at[s] = rank + n * c
            offset += s * c
        bins += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}


def place(sized: DataFrame, capacity: int = 2048, group_rows: int = 200_000, budget: int = 500_000) -> DataFrame:
    """``sized`` (any columns, among them length) with sequence_id and offset: bins of ``capacity`` without gaps.

    Pieces of one length are spread over groups of about ``group_rows`` by a hash, ranked
    within each group, and ranks shifted by the groups before: no length is ever sorted in
    one task, however many pieces share it. ``sized`` must give the same rows each time it
    is read (a written table).
    """
    spark = sized.sparkSession
    n = sized.count()
    groups = max(1, -(-n // group_rows))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64(*sized.columns), F.lit(groups)).cast("int"))
    tally = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = spark.sparkContext.broadcast(_slots(complete(counts, capacity, budget)))
    before = tally.select(
        "length",
        "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("length", "salt").orderBy(*sized.columns)
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select(*sized.columns, (F.col("r") + F.col("before")).alias("rank"))
    names = [*sized.columns, "sequence_id", "offset"]
    size_at = sized.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        for b in batches:
            size, rank = b.column(size_at).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                first, base, each, start = slots[s]
                p = np.searchsorted(first, rank[rows], "right") - 1
                r = rank[rows] - first[p]
                bins[rows], offset[rows] = base[p] + r // each[p], start[p] + r % each[p] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bins), pa.array(offset)], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)
    return map_arrow(ranked, run, f"{ddl}, sequence_id long, offset long")


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", budget: int = 500_000
) -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row a piece. A null
    or empty text is its end id alone; repeated rows are packed each; an empty table gives no
    rows; other columns are ignored. Long texts are encoded whole; only documents longer than
    ``capacity`` are cut. Pieces of one length are ranked by all their columns, and equal rows
    are interchangeable. ``budget`` bounds the steps of the plan's search, not what is packed.
    """
    return place(written(pieces(docs, path, capacity, end_id, id_col, text_col)), capacity, budget=budget)
