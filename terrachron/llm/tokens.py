"""Token counts by sentencepiece or tokenizers models, in Arrow batches, lengths only.

A text is cut at boundaries that no token can cross; each distinct piece is encoded once
per worker, in batches, and lengths add up. Long texts are cut the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, id_text, map_arrow

#: Distinct pieces whose counts a worker remembers; beyond, it starts anew.
MEMORY = 400_000


class PieceCounter:
    """Token counts of a sentencepiece model, without begin and end tokens.

    No token of such a model crosses the place before a space mark, around a line end or
    (where the vocabulary shows it) before a punctuation mark that follows another
    character; a text falls into pieces there. A text with a character that breaks the
    rule for its vocabulary is encoded whole, as are all texts if probes disagree.
    """

    _PROBES = ["", " ", "a", " a", "a ", "a  bc\t d\r\ne", "\n a\n\n", "ﬁ Å ", "1,2 34.5", "<s>a</s> <unk>", "\x00 \u3000x", "(a.b.) e.g.! -x"]

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        before = {c: set() for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}
        for t in tokens:
            for a, c in zip(t, t[1:]):
                if c in before:
                    before[c].add(a)
        marks = {c for c, s in before.items() if not any(a.isalpha() or a in "0123456789" for a in s)}
        odd = set().union(*(before[c] for c in marks)) - marks - {"▁"}
        c = "".join(map(re.escape, sorted(marks))) or "\x00"
        self._cut = re.compile(rf" +(?:[{c}][^ \n]*|[^ \n{c}]*)|\n|[{c}][^ \n]*|[^ \n{c}]+").findall
        self._odd = re.compile("[▁" + "".join(map(re.escape, sorted(odd))) + "]").search
        self.counts: dict[str, int] = {}
        self.safe = not any("▁" in t.lstrip("▁") or "\n" in t for t in tokens)
        self.safe = self.safe and self(self._PROBES) == [len(m.encode(t)) for t in self._PROBES]

    def __call__(self, texts: list[str]) -> list[int]:
        encode = self.model.encode
        if not self.safe:
            return [len(x) for x in encode(texts, num_threads=1)]
        whole = [self._odd(t) is not None for t in texts]
        cut = [self._cut(" " + t) if t and not w else [] for t, w in zip(texts, whole)]
        known = self.counts
        if len(known) > MEMORY:
            known.clear()
        new = list(set().union(*cut).difference(known))
        # The model puts a space mark before what it encodes: it stands for one space, or goes
        # with a line end before the piece, neither of which is counted.
        for w, ids in zip(new, encode([w[1:] if w[0] == " " else "\n" + w for w in new], num_threads=1)):
            known[w] = len(ids) - 2 * (w[0] != " ")
        known[" "] = known["\n"] = 1
        get = known.__getitem__
        out = [sum(map(get, c)) for c in cut]
        for k, w in enumerate(whole):
            if w:
                out[k] = len(encode(texts[k]))
        return out


class TextCounter:
    """Token counts of a tokenizers model, special strings read as the library reads them by default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | TextCounter:
    return PieceCounter(path) if path.endswith(".model") else TextCounter(path)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20
) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each document row.

    ``path`` names a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file that every
    worker can read. A null or empty text has no bytes and no tokens; repeated rows are
    each answered; other columns are ignored; an empty table gives no rows. Texts are counted
    whole, however long. Batches hold about ``batch_bytes`` of text, or one text. One scan, no
    shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in by_bytes(batches, batch_bytes):
            n = pa.array(count(b.column(1).to_pylist()), pa.int64())
            size = pa.compute.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
