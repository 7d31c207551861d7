"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Strict patterns give base spans. Loose candidates (obfuscated addresses, national phone
numbers, other cards, bank accounts, names) are voted on by regex, checksum, gazetteer,
context and shape labelers. Expectation-maximisation over the counts of vote patterns of
the whole corpus estimates how reliable each labeler is; its posteriors train a logistic
span classifier, which adds spans to the base ones. Only counts of patterns, of which there
is a fixed number, leave the workers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat_bytes, id_text, map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "name")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Email, ip, card and phone spans by strict patterns, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# --------------------------------------------------------------------------- candidates and labelers

_LOOSE = {
    "email": re.compile(r"(?i)(?<![\w.@-])[\w.+-]{1,64}\s?[\[({ ]\s?at\s?[\])} ]\s?[a-z0-9-]{1,63}(?:\s?[\[({ ]\s?dot\s?[\])} ]\s?[a-z0-9-]{2,63}){1,3}(?![\w@-])"),
    "phone": re.compile(r"(?<![\w+.(-])(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){3,4})(?![\w-])"),
    "card": re.compile(r"(?<![\w-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])"),
    "iban": re.compile(r"(?<![\w-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "name": re.compile(r"(?:(?<=\bMr )|(?<=\bMr\. )|(?<=\bMrs )|(?<=\bMrs\. )|(?<=\bMs )|(?<=\bMs\. )|(?<=\bDr )|(?<=\bDr\. )|(?<=\bHerr )|(?<=\bFrau )|(?<=\bMme )|(?<=\bSra\. )|(?<=\bSr\. )|(?<=\bname is )|(?<=\bm'appelle )|(?<=\bheiße )|(?<=\bme llamo ))[A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+){0,2}"),
}
#: Rows that can hold a loose candidate without a digit (RE2).
_WORDY = r"(?i:[\[({ ]dot[\])} ])|\b(?:Mrs?|Ms|Dr|Herr|Frau|Mme|Sra?)\.? [A-ZÀ-Þ]|\bname is [A-ZÀ-Þ]|\b(?:m'appelle|heiße|me llamo) [A-ZÀ-Þ]"
_CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|mail|contact|write|address|kontakt|correo|courriel|adresse"),
    "phone": re.compile(r"(?i)phone|\btel\b|\btel\.|telefon|teléfono|call|mobile|fax|whatsapp|handy|appele[rz]"),
    "card": re.compile(r"(?i)card|credit|visa|amex|karte|tarjeta|carte|payment"),
    "iban": re.compile(r"(?i)iban|bank|account|konto|cuenta|compte"),
    "ssn": re.compile(r"(?i)ssn|social security"),
    "name": re.compile(r"(?i)name|mr|mrs|ms|dr|herr|frau|mme|sra?|patient|customer|dear|m'appelle|heiße|llamo"),
}
_AGAINST = re.compile(r"(?i)version|isbn|issn|order|invoice|part|model|item|page|section|\bid\b|seq|build|rev|=|#")
_FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas "
    "sarah charles karen daniel lisa matthew nancy anthony betty mark margaret paul sandra andrew ashley peter anna maria hans "
    "klaus jürgen wolfgang heike sabine ursula monika petra jean pierre michel philippe nathalie isabelle sophie camille jose "
    "juan antonio carmen luis ana carlos lucia javier elena pablo marta emma noah liam olivia sophia lucas leon mia".split()
)
_TLDS = frozenset("com org net edu gov io de fr es uk info eu ch at it nl co".split())
_CODES = frozenset("1 7 20 27 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 55 61 81 86 91".split())


def _gazetteer(kind: str, s: str) -> int:
    if kind == "name":
        return 1 if s.split()[0].lower() in _FIRST_NAMES else 0
    if kind == "email":
        return 1 if re.split(r"\W+", s.rstrip(" )]}").lower())[-1] in _TLDS else -1
    if kind == "phone":
        d = re.sub(r"[^0-9]", "", s)
        if d.startswith("00"):
            return 1 if any(d[2 : 2 + n] in _CODES for n in (1, 2)) else -1
        return 1 if d[0] in "23456789" and d[3] in "23456789" else -1
    if kind == "card":
        return 1 if s[:2] in ("34", "37") else 0
    return 0


def _checked(kind: str, s: str) -> int:
    d = re.sub(r"[^0-9A-Z]", "", s)
    if kind == "card":
        return 1 if luhn(d) else -1
    if kind == "iban":
        return 1 if 15 <= len(d) <= 34 and int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return 1 if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else -1
    return 0


#: Stricter forms of the loose candidates: what a person would write.
_FORM = {
    "email": re.compile(r"(?i)[\w.+-]+ ?[\[({]\s?at\s?[\])}] ?[a-z0-9-]+(?: ?[\[({]\s?dot\s?[\])}] ?[a-z0-9-]+)+|[\w.+-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)+"),
    "phone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|00[1-9][0-9]{0,2}(?: [0-9]{2,4}){3,4}"),
    "card": re.compile(r"[0-9]{15}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "name": re.compile(r"\w+(?: \w+){0,2}"),
}
_MORE_DIGITS = re.compile(r"[0-9][./:-]?$")


def _formed(kind: str, text: str, a: int, e: int) -> int:
    """The regex labeler on a loose candidate: against it where digits go on beside it, for it where its form is one that people write."""
    if kind not in ("email", "name") and (_MORE_DIGITS.search(text[max(0, a - 2) : a]) or _MORE_DIGITS.search(text[e : e + 2][::-1])):
        return -1
    return 1 if _FORM[kind].fullmatch(text[a:e]) else 0


def _votes(kind: str, text: str, a: int, e: int, strict: bool) -> tuple[int, ...]:
    """Votes (1 personal, -1 not, 0 none) of the regex, checksum, gazetteer, context and shape labelers."""
    s, before = text[a:e], text[max(0, a - 40) : a]
    digits = [c for c in s if c.isdigit()]
    shape = -1 if digits and len(set(digits)) <= 2 else 0
    context = 1 if kind in _CONTEXT and _CONTEXT[kind].search(before) else -1 if _AGAINST.search(before[-16:]) else 0
    if strict:
        return 1, 1 if kind in ("card", "ip") else 0, 0 if kind == "ip" else _gazetteer(kind, s) if kind == "email" else 0, context, shape
    return _formed(kind, text, a, e), _checked(kind, s), _gazetteer(kind, s), context, shape


def _features(kind: str, s: str) -> tuple[int, int, int]:
    """Length, separators and digits in a few steps each."""
    return min(len(s) // 6, 7), min(sum(not c.isalnum() for c in s), 5), min(sum(c.isdigit() for c in s) // 4, 5)


def candidates(text: str, base: list[tuple[str, int, int]], digits: bool) -> Iterator[tuple[str, int, int]]:
    """Loose candidates that overlap no base span, nor an earlier candidate."""
    taken = sorted((a, e) for _, a, e in base)
    for kind in ("email", "iban", "card", "ssn", "phone", "name"):
        if kind not in ("email", "name") and not digits:
            continue
        for m in _LOOSE[kind].finditer(text):
            if all(m.end() <= a or e <= m.start() for a, e in taken):
                taken.append((m.start(), m.end()))
                yield kind, m.start(), m.end()


def wanted(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a digit or an at sign; rows that hold words of a loose candidate."""
    data, at = flat_bytes(col)
    hit = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 0x40) | (data >= 0x30) & (data <= 0x39), out=hit[1:])
    signs = hit[at[1:]] > hit[at[:-1]]
    return signs, pa.compute.match_substring_regex(col, _WORDY).fill_null(False).to_numpy(zero_copy_only=False)


# --------------------------------------------------------------------------- learning

Pattern = tuple[str, tuple[int, ...], tuple[int, int, int]]


@dataclass
class Model:
    """Weights of the span classifier, and the labelers' reliabilities that trained it."""

    weights: np.ndarray
    reliability: dict[str, float]

    def probability(self, p: Pattern) -> float:
        return float(1 / (1 + np.exp(-np.clip(_row(p) @ self.weights, -30, 30))))


def _row(p: Pattern) -> np.ndarray:
    """One-hot votes and features of a pattern, with a constant."""
    kind, votes, feats = p
    x = np.zeros(1 + len(KINDS) + 3 * len(votes) + 8 + 6 + 6)
    x[0] = x[1 + KINDS.index(kind)] = 1
    at = 1 + len(KINDS)
    for k, v in enumerate(votes):
        x[at + 3 * k + v + 1] = 1
    at += 3 * len(votes)
    for f, n in zip(feats, (8, 6, 6)):
        x[at + f] = 1
        at += n
    return x


def _expectation_maximisation(patterns: list[Pattern], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[str, float]]:
    """Posterior of each pattern, and each labeler's chance to be right where it votes.

    Begins at the majority of votes. Labelers are independent given the truth; the prior
    belongs to the kind. Counts are smoothed, so that few data keep close to that belief.
    """
    votes = np.array([p[1] for p in patterns]) + 1
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    # A vote is believed right nine times in ten at first.
    belief = np.array([[9.0, 5.0, 1.0], [1.0, 5.0, 9.0]])
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = np.array([(1 + (w[1] * (kinds == k)).sum()) / (2 + (counts * (kinds == k)).sum()) for k in range(len(KINDS))])
        prior = np.clip(prior, 0.05, 0.95)
        table = np.zeros((votes.shape[1], 2, 3))
        for j in range(votes.shape[1]):
            for y in (0, 1):
                table[j, y] = belief[y] + np.bincount(votes[:, j], weights=w[y], minlength=3)
        table /= table.sum(axis=2, keepdims=True)
        like = [np.log(table[np.arange(votes.shape[1])[None], y, votes]).sum(axis=1) for y in (0, 1)]
        z = like[1] - like[0] + np.log(prior / (1 - prior))[kinds]
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    names = ("regex", "checksum", "gazetteer", "context", "shape")
    right = {n: float(table[j, 1, 2] / (table[j, 1, 2] + table[j, 0, 2])) for j, n in enumerate(names)}
    return post, right


def fit(counted: Counter) -> Model:
    """EM on pattern counts, then a ridge logistic on its posteriors."""
    patterns = list(counted)
    x = np.zeros((0, len(_row(("email", (0,) * 5, (0, 0, 0))))))
    if not patterns:
        w = np.zeros(x.shape[1])
        w[0] = -10.0
        return Model(w, {})
    counts = np.array([counted[p] for p in patterns], float)
    y, right = _expectation_maximisation(patterns, counts)
    x = np.array([_row(p) for p in patterns])
    n = counts / counts.sum() * min(counts.sum(), 10_000.0)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - 0.05 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Model(w, right)


def _read(b: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Row, text, base spans and loose candidates of the rows that can hold any."""
    signs, wordy = wanted(b.column(1))
    for k in np.flatnonzero(signs | wordy).tolist():
        text = b.column(1)[k].as_py()
        base = base_spans(text)
        yield k, text, base, list(candidates(text, base, bool(signs[k])))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> Model:
    """Labelers' reliabilities and the span classifier, from the vote patterns of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in by_bytes(batches, batch_bytes):
            for _, text, base, loose in _read(b):
                for spans, strict in ((base, True), (loose, False)):
                    for kind, a, e in spans:
                        counts[kind, *_votes(kind, text, a, e, strict), *_features(kind, text[a:e])] += 1
        rows = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["|".join(map(str, r)) for r in rows], pa.string()), pa.array([counts[r] for r in rows], pa.int64())],
            names=["pattern", "n"],
        )

    sums = map_arrow(id_text(docs, id_col, text_col), run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counted: Counter = Counter()
    for r in sums.toLocalIterator():
        kind, *rest = r["pattern"].split("|")
        v = tuple(map(int, rest))
        counted[kind, v[:5], v[5:]] = r["n"]
    return fit(counted)


def find_personal_data(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, batch_bytes: int = 8 << 20
) -> DataFrame:
    """doc_id, kinds, starts, ends and strict (base span or not) of each document row, by kind, then start.

    Base spans always stay; the classifier adds candidates that it gives at least
    ``threshold``. Spans are code points, end exclusive. A null or empty text has none; texts
    are read whole, however long; of overlapping candidates the first kind's stays; repeated
    rows are each answered; other columns are ignored; an empty table gives no rows. One
    scan, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[Pattern, float] = {}
        for b in by_bytes(batches, batch_bytes):
            found: list[list] = [[] for _ in range(b.num_rows)]
            for k, text, base, loose in _read(b):
                spans = [(*s, True) for s in base]
                for kind, a, e in loose:
                    p = (kind, _votes(kind, text, a, e, False), _features(kind, text[a:e]))
                    if p not in known:
                        known[p] = shared.value.probability(p)
                    if known[p] >= threshold:
                        spans.append((kind, a, e, False))
                found[k] = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
            types = (pa.string(), pa.int32(), pa.int32(), pa.bool_())
            cols = [pa.array([[s[j] for s in f] for f in found], pa.list_(t)) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "kinds", "starts", "ends", "strict"])

    return map_arrow(
        id_text(docs, id_col, text_col), run, "doc_id long, kinds array<string>, starts array<int>, ends array<int>, strict array<boolean>"
    )
