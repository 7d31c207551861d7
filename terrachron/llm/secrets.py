"""Secret scans: candidates by pattern, confirmed by their structure.

Base64 and hexadecimal candidates of 20 characters or more are decoded; private keys are
parsed as DER (nested lengths must add up) or as OpenSSH key files, signed tokens by their
JSON header and payload. Decoded text, of one line or more, is scanned for keys, tokens and
plain secrets in turn. An encrypted key's header lines must name its cipher. Plain assignments, access keys and long hexadecimal strings are base spans.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .common import by_bytes, flat_bytes, id_text, map_arrow

#: Order of kinds; the first three are base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh", "encoded")

_ASSIGN = re.compile(
    r"[pPsStTaA](?:(?<=[pP])[aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|(?<=[sS])[eE][cC][rR][eE][tT]"
    r"|(?<=[tT])[oO][kK][eE][nN]|(?<=[aA])[pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----\s*+"
    r"((?:[A-Za-z0-9-]++:[^\n]*+\n(?:[ \t]++[^\n]*+\n)*+)*+)"
    r"([A-Za-z0-9+/=\s]++)-----END ([A-Z0-9]+ )*PRIVATE KEY-----"
)
_DEK = re.compile(r"^DEK-Info:\s*[A-Za-z0-9-]+\s*,\s*[0-9A-Fa-f]{16,}\s*$", re.M)
_BREAKS = str.maketrans("", "", "\t\r\n")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]+")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_RUN_CHARS = _table(_LETTERS + "+/_-.")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Assignments, access keys and hexadecimal strings, in no order."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def decoded(s: str) -> bytes | None:
    """The bytes of a base64 string (either alphabet, padding optional), if it is one."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def der_parts(b: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill ``b``; None unless all lengths add up."""
    out, at = [], 0
    while at < len(b):
        if at + 2 > len(b):
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(b):
                return None
            n, at = int.from_bytes(b[at : at + k]), at + k
        if at + n > len(b):
            return None
        body, at = b[at : at + n], at + n
        if tag in (0x30, 0x31) and (depth > 16 or der_parts(body, depth + 1) is None):
            return None
        out.append((tag, body))
    return out


def is_der_key(b: bytes) -> bool:
    """A private key: PKCS#1 or DSA, SEC1, PKCS#8 or encrypted PKCS#8."""
    top = der_parts(b) if b[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    parts = der_parts(top[0][1]) or []
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and len(parts[0][1]) == 1:
        return len(tags) >= 6 and set(tags) == {0x02} or tags[1:2] == [0x04] or tags[1:3] == [0x30, 0x04]
    if tags == [0x30, 0x04]:
        first = der_parts(parts[0][1]) or []
        return bool(first) and first[0][0] == 0x06 and len(first) == 2 and first[1][0] == 0x30
    return False


def is_openssh_key(b: bytes) -> bool:
    """An OpenSSH private key file: its magic, then length-prefixed parts that fill it."""
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return False
    at = len(magic)

    def part() -> bytes | None:
        nonlocal at
        n = int.from_bytes(b[at : at + 4])
        if at + 4 + n > len(b):
            return None
        at += 4 + n
        return b[at - n : at]

    if any(part() is None for _ in range(3)):
        return False
    keys, at = int.from_bytes(b[at : at + 4]), at + 4
    return 1 <= keys <= 16 and all(part() is not None for _ in range(keys + 1)) and at == len(b)


def _json(s: str) -> dict | None:
    b = decoded(s)
    try:
        x = json.loads(b) if b and b.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def is_signed_token(s: str) -> bool:
    """Three base64url parts: a header with an algorithm, a JSON payload, a signature unless it is ``none``."""
    head, payload, sign = s.split(".")[:3]
    h = _json(head)
    if not h or not isinstance(h.get("alg"), str) or _json(payload) is None:
        return False
    return h["alg"].lower() == "none" or bool(sign) and decoded(sign) is not None


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Private keys in PEM form, plain, or encrypted as RFC 1421 header lines say (then whole cipher blocks)."""
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            b = decoded("".join(m[3].split()))
            if b and (is_der_key(b) or is_openssh_key(b) or len(b) % 8 == 0 and _DEK.search(m[2])):
                out.append((m.start(), m.end()))
    return out


def _kind_of(b: bytes) -> str | None:
    """What decoded bytes are."""
    if is_der_key(b):
        return "der"
    if is_openssh_key(b):
        return "openssh"
    if b.isascii() and (t := b.decode()).translate(_BREAKS).isprintable():
        if pem_spans(t) or any(k != "hex" for k, _, _ in base_spans(t)) or t.count(".") >= 2 and any(
            is_signed_token(m[0]) for m in _JWT.finditer(t)
        ):
            return "encoded"
    return None


def _wrapped(s: str) -> tuple[str, int] | None:
    """What base64 in lines of one length, but for a shorter last one, decodes to, and where it ends."""
    lines = s.split("\n")
    width = len(lines[0].rstrip("\r"))
    n = 1
    while n < len(lines) and len(lines[n].rstrip("\r")) == width:
        n += 1
    for k in (n + 1, n):
        if 2 <= k <= len(lines) and len(lines[k - 1].rstrip("\r")) <= width:
            part = "\n".join(lines[:k])
            if (b := decoded("".join(part.split()))) and (kind := _kind_of(b)):
                return kind, len(part.rstrip("\r"))
    return None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose structure confirms them."""
    out = []
    if "." in text:
        out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    pem = pem_spans(text)
    out += [("pem", a, e) for a, e in pem]
    for m in _LINES.finditer(text):
        if not any(a <= m.start() < e for a, e in pem) and (wrapped := _wrapped(m[0])):
            out.append((wrapped[0], m.start(), m.start() + wrapped[1]))
            pem.append((m.start(), m.start() + wrapped[1]))
    for m in _RUN.finditer(text):
        if any(a <= m.start() < e for a, e in pem):
            continue
        s = m[0]
        if _ANY_HEX.fullmatch(s) and len(s) % 2 == 0 and (kind := _kind_of(bytes.fromhex(s))):
            out.append((kind, m.start(), m.end()))
        elif (b := decoded(s)) and (kind := _kind_of(b)):
            out.append((kind, m.start(), m.end()))
    return out


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(col: pa.Array) -> np.ndarray:
    """Rows that can hold a span at all: a long run of key characters, or an assignment's sign.

    Every kind needs a run of 16 key characters, but for an assignment (8 after ``:`` or ``=``).
    """
    data, at = flat_bytes(col)
    n = len(at) - 1
    out = np.zeros(n, bool)
    if not len(data):
        return out
    gaps = np.flatnonzero(~_RUN_CHARS[data])
    edges = np.concatenate([[-1], gaps, [len(data)]])
    starts = edges[:-1][np.diff(edges) > 16] + 1
    signs = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    # A run may begin in the rows before: each row that it touches counts.
    ends = edges[1:][np.diff(edges) > 16]
    first, last = np.searchsorted(at, starts, "right") - 1, np.searchsorted(at, ends - 1, "right") - 1
    hit = np.zeros(n + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, last + 1, -1)
    out |= np.cumsum(hit)[:n] > 0
    out[np.searchsorted(at, signs, "right") - 1] = True
    return out


SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """Spans of secrets (code points, end exclusive), one row per document row.

    Returns doc_id, kinds, starts and ends, by start, then kind. A null or empty text has
    no spans; repeated rows are each answered; other columns are ignored. Texts are read
    whole, however long. An empty table gives no rows. One scan, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, batch_bytes):
            found: list[list] = [[] for _ in range(b.num_rows)]
            for k in np.flatnonzero(candidates(b.column(1))).tolist():
                found[k] = spans_of(b.column(1)[k].as_py())
            cols = [pa.array([[s[j] for s in f] for f in found], pa.list_(t)) for j, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "kinds", "starts", "ends"])

    return map_arrow(id_text(docs, id_col, text_col), run, SCHEMA)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "<removed>") -> str:
    """The text with overlapping spans merged and each replaced by ``mark``."""
    out, at = [], 0
    for _, a, e in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """The documents with every secret replaced by ``<removed>``; all columns and rows stay.

    Needs the column ``text``; a null text stays null. A column ``n_chars``, if there is
    one, is counted anew for texts that were changed. Scanning the result again finds
    nothing: a text is redacted until it has no span.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else -1
    safe = [f"c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, batch_bytes, safe[at]):
            cols, new = list(b.columns), {}
            for k in np.flatnonzero(candidates(cols[at])).tolist():
                text = cols[at][k].as_py()
                while spans := spans_of(text):
                    text = new[k] = redacted(text, spans)
            if new:
                cols[at] = pa.array([new.get(k, v) for k, v in enumerate(cols[at].to_pylist())], cols[at].type)
                if count >= 0:
                    old = cols[count].to_pylist()
                    cols[count] = pa.array([len(new[k]) if k in new else v for k, v in enumerate(old)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=safe)

    to = StructType([StructField(c, f.dataType) for c, f in zip(safe, schema)])
    return map_arrow(docs.toDF(*safe), run, to).toDF(*names)
