"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Texts are folded first: case, homoglyphs, and digits or signs that stand for letters;
whole words without accents in the lexicon match accented forms too. Hits of the lexicon
(words, or stems that take any ending) count by weight, less those in exception phrases,
and are set against the length of the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import by_bytes, drop_path, id_text, map_arrow, sampled, written

_HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһкмнтвгпзуАВЕКМНОРСТУХІЈЅαβεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhkmhtbrn3yabekmhopctyxijsabeikvoptuxwabezhikmnoptyx",
    )
)
#: l and i (and 1, |) are one letter after folding, in texts and lexicon alike.
_DIGITS = dict(zip("013457l", "oieasti"))
_SIGNS = dict(zip("@$!|", "asii"))
_SIGN_IN_WORD = re.compile(r"[@$!|]+(?=[^\W_])")


class _Folding(dict):
    """What each character becomes: a letter, a digit, a space, or nothing."""

    def __missing__(self, c: int) -> str | None:
        x = chr(c)
        if unicodedata.category(x) in ("Cf", "Mn"):
            out = None
        else:
            y = unicodedata.normalize("NFKC", x)[:1] or x
            y = _HOMOGLYPHS.get(y, y).lower()[:1]
            y = _HOMOGLYPHS.get(y, y)
            out = _DIGITS.get(y, y) if y.isalnum() else " "
        self[c] = out
        return out


class _Bare(dict):
    """Letters without their accents; a character stays one character."""

    def __missing__(self, c: int) -> str:
        out = self[c] = unicodedata.normalize("NFKD", chr(c))[:1] or chr(c)
        return out


_FOLDING, _BARE = _Folding(), _Bare()


def fold(text: str) -> str:
    """Letters, digits and spaces only; every other character is a space or nothing."""
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGN_IN_WORD.sub(lambda m: "".join(_SIGNS[c] for c in m[0]), text)
    return text.translate(_FOLDING)


@dataclass
class Lexicon:
    """Folded terms with weights (a trailing ``*``: any ending), exception phrases, and the score's logistic."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = -2.0
    by_count: float = 1.5
    by_density: float = 1.0
    automata: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "automata": []}

    def matchers(self) -> list:
        """For folded texts; for texts without accents (None if no term matches there)."""
        if not self.automata:
            import ahocorasick

            for bare in (False, True):
                a = ahocorasick.Automaton()
                entries: dict[str, list] = defaultdict(list)
                for t, w in self.weights.items():
                    if not bare or t.isascii() and not t.endswith("*"):
                        entries[" " + t.rstrip("*") + ("" if t.endswith("*") else " ")].append((w, t))
                for p in self.exceptions:
                    entries[" " + p + " "].append((None, p))
                for k, v in entries.items():
                    a.add_word(k, (len(k), v))
                if entries:
                    a.make_automaton()
                self.automata.append(a if entries else None)
        return self.automata

    def hits(self, folded: str) -> list[tuple[float, str]]:
        """(weight, term) of every word that a term matches, one per word, but for those in exceptions."""
        if not self.weights:
            return []
        words: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for a, text in zip(self.matchers(), (folded, "" if folded.isascii() else folded.translate(_BARE))):
            for end, (n, found) in a.iter(" " + text + " ") if a is not None and text else ():
                for w, t in found:
                    start = end - n + 1
                    if w is None:
                        spared.append((start, end))
                    elif start not in words or w > words[start][0]:
                        words[start] = (w, t)
        return [x for at, x in words.items() if not any(a <= at < e for a, e in spared)]

    def features(self, folded: str) -> tuple[float, float, int]:
        """Log of the summed weights, their share of the length in words (1 from a fiftieth on), words hit."""
        hits = self.hits(folded)
        total = sum(w for w, _ in hits)
        return math.log1p(total), min(1.0, 50 * total / (1 + folded.count(" "))) if total else 0.0, len(hits)

    def score(self, folded: str) -> tuple[float, int]:
        """The score, and the number of words hit."""
        a, b, n = self.features(folded)
        z = self.bias + self.by_count * a + self.by_density * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), n


def default_lexicon() -> Lexicon:
    """A few English terms, for use where there are no labels."""
    terms = "idiot* moron* stupid scum trash worthless pathetic disgusting loser* clown* hateful vermin".split()
    return Lexicon({fold(t.rstrip("*")) + "*" * t.endswith("*"): 1.0 for t in terms}, (fold("trash can"), fold("trash bin")))


def _terms(folded: str, least: int = 3, most: int = 8, one_in: int = 200) -> set[str]:
    """Words (marked by a trailing space) and beginnings of ``least`` to ``most`` letters that at least one word in ``one_in`` has.

    A stem that turns up by chance is rarer than that in all but short texts.
    """
    words = Counter(folded.split())
    counts: Counter = Counter()
    for w, n in words.items():
        counts[w + " "] = n
        for k in range(least, min(most, len(w)) + 1):
            counts[w[:k]] += n
    total = sum(words.values())
    return {t for t, n in counts.items() if n * one_in >= total}


def _counted(rows: DataFrame, made, least_toxic: int) -> dict[str, tuple[int, int]]:
    """(toxic, other) texts with each term that ``made`` gives, terms of few toxic texts left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=["term", "toxic", "other"])

        for b in by_bytes(batches, 2 << 20):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[toxic == 0].update(made(fold(text)))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
        yield flush()

    sums = map_arrow(rows, run, "term string, toxic long, other long").groupBy("term")
    sums = sums.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where(F.col("t") + F.col("o") >= least_toxic)
    # Only terms that lean to toxic texts go to the driver; rows are bounded by the sample.
    return sums


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    max_labelled: int = 20_000,
    least_texts: int = 4,
    least_odds: float = 6.0,
) -> Lexicon:
    """A lexicon from labelled documents (``labels``: id, toxic 0 or 1).

    At most about ``max_labelled`` labelled rows, chosen by a hash of the id, are used, each
    distinct text once; null texts and labels, and ids without a text, are left out. Terms
    are words and beginnings of words that at least ``least_odds`` times as many of the toxic
    texts hold (as one word in 200 or more), by more than chance; words that only ride along
    in near copies of one text stay out. A word that is toxic but harmless after or before a certain word gives an exception
    phrase. Without labels of both kinds, the default lexicon is returned.
    """
    marked = sampled(labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, "toxic"), id_col, max_labelled)
    marked = marked.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    # The sample is bounded, so it is sent to the documents, whose texts don't move.
    rows = (
        docs.select(id_col, F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(marked), id_col)
        .select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("key"))
    )
    keep: list[str] = []
    rows = written(rows.dropDuplicates(["key"]), keep)  # bounded by the sample, read several times
    try:
        return _learned(rows, least_texts, least_odds)
    finally:
        drop_path(docs.sparkSession, keep[0])


def _learned(rows: DataFrame, least_texts: int, least_odds: float) -> Lexicon:
    """The lexicon of (text, toxic) rows."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return default_lexicon()
    ratio = totals[1] / totals[0]
    counts = _counted(rows, _terms, least_texts)
    lean = counts.where((F.col("t") >= least_texts) & ((F.col("t") + 0.5) / (F.col("o") + 0.5) >= least_odds * ratio))
    strong = {r["term"]: (r["t"], r["o"]) for r in lean.toLocalIterator()}

    # Which toxic texts hold which strong terms: ids of terms, a row a text.
    known = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(strong)})

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2 << 20):
            made = [fold(x) for x in b.column(0).to_pylist()]
            held = [sorted({known.value[t] for t in _terms(x) if t in known.value}) for x in made]
            cols = [pa.array(held, pa.list_(pa.int32())), pa.array([_sketch(x) for x in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["held", "sketch"])

    toxic = map_arrow(rows.where("toxic = 1").select("text"), incidence, "held array<int>, sketch array<long>")
    names = list(strong)
    texts = [([names[i] for i in r["held"]], frozenset(r["sketch"])) for r in toxic.toLocalIterator() if r["held"]]
    picked = _pick(strong, texts, totals[1] / (totals[0] + totals[1]), max(1, counts.count()), least_texts)
    if not picked:
        return default_lexicon()
    weights = {}
    for t in picked:
        weights[t.rstrip(" ") + ("" if t.endswith(" ") else "*")] = _weight(*strong[t], ratio)
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(rows, lexicon, ratio)
    return _fitted(rows, lexicon)


def _sketch(folded: str, size: int = 24) -> list[int]:
    """The least hashes of a text's words: like texts share most of them."""
    return sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in folded.split()})[:size]


def _spread(sketches: list[frozenset[int]], most: int = 40) -> int:
    """How many unlike texts there are (at most ``most``); texts that share half of their sketch count as one."""
    leaders: list[frozenset[int]] = []
    for own in sketches:
        if all(2 * len(own & x) < len(own | x) for x in leaders):
            leaders.append(own)
            if len(leaders) >= most:
                break
    return len(leaders)


def _weight(toxic: int, other: int, ratio: float) -> float:
    """Weight of a term from its log-odds."""
    return min(2.0, max(0.25, math.log((toxic + 0.5) / (other + 0.5) / ratio) / 5))


def _pick(
    strong: dict[str, tuple[int, int]], texts: list[tuple[list[str], frozenset[int]]], toxic_share: float, tested: int, least: int
) -> list[str]:
    """Terms that lean to toxic texts by more than chance among ``tested`` terms, as words or as stems.

    Words that only ride along in near copies of one text count once and fall out.
    """
    holds: dict[str, list[int]] = defaultdict(list)
    for k, (held, _) in enumerate(texts):
        for t in held:
            holds[t].append(k)
    families: dict[str, list[str]] = defaultdict(list)
    for t, (a, o) in strong.items():
        alike = _spread([texts[k][1] for k in holds[t]])
        a = min(a, alike) if alike < 40 else a
        n = a + o
        gain = a * math.log(a / (n * toxic_share)) + (o * math.log(o / (n * (1 - toxic_share))) if o else 0.0) if a else 0.0
        if a >= least and gain > math.log(tested) + 3:
            families[t[:3]].append(t)
    ratio = toxic_share / (1 - toxic_share)
    weight = {t: _weight(*strong[t], ratio) for terms in families.values() for t in terms}
    picked = []
    for terms in families.values():
        left = {t: set(holds[t]) for t in terms}
        while left:
            t = max(left, key=lambda x: (len(left[x]) * weight[x], -len(x), x))
            if len(left[t]) < least:
                break
            done = left[t]
            # A stem is as long as it can be without losing texts: a whole word if it takes no endings.
            while not t.endswith(" ") and (nearly := [u for u in terms if u != t and u.startswith(t) and len(u) > len(t) and len(holds[u]) >= 0.97 * len(holds[t])]):
                t = max(nearly, key=lambda u: (len(holds[u]), -len(u), u))
            picked.append(t)
            left = {u: s - done for u, s in left.items()}
    return picked


def _exceptions(rows: DataFrame, lexicon: Lexicon, ratio: float, least: int = 4) -> tuple[str, ...]:
    """Two-word phrases with a term that other texts hold and toxic texts hardly do."""

    def phrases(folded: str) -> Iterable[str]:
        words, out = folded.split(), set()
        for k, w in enumerate(words):
            if w in lexicon.weights or any(w[:n] + "*" in lexicon.weights for n in range(3, 9)):
                out.update(" ".join(words[a : a + 2]) for a in (k - 1, k) if 0 <= a < len(words) - 1)
        return out

    found = _counted(rows, phrases, least)
    found = found.where((F.col("o") >= least) & ((F.col("t") + 0.5) / (F.col("o") + 0.5) <= 0.1 * ratio))
    return tuple(sorted(r["term"] for r in found.toLocalIterator()))


def _fitted(rows: DataFrame, lexicon: Lexicon, steps: int = 60) -> Lexicon:
    """The logistic of the score, by Newton's method with a small ridge, on counts of rounded features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2 << 20):
            f = [lexicon.features(fold(t)) for t in b.column(0).to_pylist()]
            cols = [pa.array([round(x[k], 2) for x in f], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, b.column(1)], names=["a", "b", "toxic"])

    got = map_arrow(rows.select("text", "toxic"), run, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().toArrow()
    x = np.column_stack([np.ones(got.num_rows), got["a"].to_numpy(), got["b"].to_numpy()])
    y, n = got["toxic"].to_numpy().astype(float), got["count"].to_numpy().astype(float)
    w, ridge = np.zeros(3), np.array([0.1, 1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    lexicon.bias, lexicon.by_count, lexicon.by_density = float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))
    return lexicon


def score_toxicity(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20
) -> DataFrame:
    """doc_id, score (0 to 1) and n_terms (words hit) of each document row.

    A null or empty text has no hits and the score of a harmless text; texts are read whole,
    however long; repeated rows are each answered; other columns are ignored; an empty table
    gives no rows. Of the terms that a word matches, the one of most weight counts (equal
    ones are alike). One scan, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in by_bytes(batches, batch_bytes):
            made = [lex.score(fold(t)) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([x[0] for x in made], pa.float64()), pa.array([x[1] for x in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "n_terms"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, score double, n_terms long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, batch_bytes: int = 4 << 20) -> DataFrame:
    """The documents whose score is under ``threshold``; all columns stay. Needs the column ``text``.

    A null text is as harmless as an empty one; texts are read whole, however long; repeated
    rows are each judged; an empty table stays empty. One scan, no shuffle.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    safe = [f"c{i}" for i in range(len(names))]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in by_bytes(batches, batch_bytes, safe[at]):
            yield b.filter(pa.array([lex.score(fold(t or ""))[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    to = StructType([StructField(c, f.dataType) for c, f in zip(safe, schema)])
    return map_arrow(docs.toDF(*safe), run, to).toDF(*names)
