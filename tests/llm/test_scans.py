"""Decontamination, secrets, personal data, tokens: brute force, round trips and odd inputs."""

import base64
import json
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa

from terrachron.llm import decontam, packing, pii, secrets, tokens

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "é" * 10), (4, "é" * 10), (None, "x y z"), (5, "a " * 60_000)]


# --------------------------------------------------------------------------- decontamination


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_contamination(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        s = words(t)
        n = min(window, len(s))
        wins = {tuple(s[i : i + n]) for i in range(len(s) - n + 1)} if s else set()
        for i in range(len(w) - n + 1):
            if s and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_against_brute_force(spark, docs_of):
    rng = random.Random(1)
    vocabulary = ["a", "b", "C", "d-e", "é1", "F."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 12, 25]))) for k in range(100, 112)] + [(9, None), (10, " - "), (100, text(14))]
    docs = [(1000 + k, text(rng.randint(0, 60)) + (" " + items[k % 12][1] if k % 3 == 0 else "")) for k in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (50, 500_000):
        got = decontam.find_contamination(docs_of(docs), bench, window=10, shard_symbols=shard).collect()
        want = sorted(((k, *brute_contamination(t, items)) for k, t in docs), key=str)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    cut = decontam.decontaminate(docs_of(docs), bench).collect()
    assert len(cut) == len(docs) and all(brute_contamination(r.text, items)[1] == 0 for r in cut)
    clean = {k: t for k, t in docs if brute_contamination(t, items)[1] == 0}
    assert all(r.text == clean[r.doc_id] for r in cut if r.doc_id in clean)
    assert all(r.n_chars == len(r.text) for r in cut if r.text is not None)


def test_benchmark_in_parts(spark, docs_of):
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 10, 14, 400])))) for k in range(12)] + [(3, "ab cd " * 8), (50, None), (51, "...")]
    rows = [(k, " ".join(word() for _ in range(rng.choice([0, 5, 60])))) for k in range(60)] + [(70, None), (70, None)]
    rows += [(100 + k, f"x {t} y") for k, t in items[:6]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    keep = []
    assert len(decontam._parts(bench, 10, 1500, keep)) > 1
    whole, parts = (sorted(map(tuple, decontam.find_contamination(docs_of(rows), bench, max_benchmark_bytes=n).collect()), key=repr) for n in (1 << 20, 1500))
    assert whole == parts and any(r[2] for r in whole)
    df = docs_of(rows)
    cleaned = decontam.decontaminate(df, bench, max_benchmark_bytes=1500)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    assert decontam.find_contamination(cleaned, bench).where("n_hit > 0").count() == 0
    assert cleaned.where("text is not null and n_chars <> length(text)").count() == 0


def test_decontaminate_in_small_shards(spark, docs_of):
    rng = random.Random(12)
    word = lambda: rng.choice("ab cd ef gh".split())
    bench = spark.createDataFrame([(k, " ".join(word() for _ in range(12))) for k in range(20)], "item_id long, text string")
    rows = [(k, " ".join(word() for _ in range(rng.choice([5, 80])))) for k in range(80)] + [(100 + r.item_id, f"gh {r.text} ef") for r in bench.collect()]
    one, many = (sorted((r.doc_id, r.text) for r in decontam.decontaminate(docs_of(rows), bench, **more).collect()) for more in ({}, {"shard_symbols": 50, "batch_bytes": 900}))
    assert one == many and one != sorted(rows)
    assert decontam.decontaminate(docs_of([]), bench).count() == 0


def test_contamination_of_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontam.find_contamination(docs_of(ODD), none).collect())
    assert decontam.find_contamination(docs_of([]), none).count() == 0
    big = spark.createDataFrame([(1, "word " * 100)], "item_id long, text string")
    same = [sorted(map(tuple, decontam.find_contamination(docs_of([(1, "a " + "word " * 30), (2, "word")]), big, max_benchmark_bytes=n).collect())) for n in (1 << 20, 200)]
    assert same[0] == same[1] and same[0][0][2] == 30


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    s = np.append(rng.integers(1, 4, 300), 0)
    index = decontam.FMIndex(s, 5, sample=8)
    for n in (1, 2, 4):
        for _ in range(20):
            p = rng.integers(1, 4, n)
            lo, hi = index.search(p[None])
            want = [i for i in range(300 - n + 1) if (s[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_spans_are_code_points(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    (r,) = decontam.find_contamination(docs_of([(1, "é, One  TWO three! x")]), bench).collect()
    assert [(s.start, s.end) for s in r.spans] == [(3, 17)]


# --------------------------------------------------------------------------- secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute_secrets(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_base_secrets_against_brute_force():
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdef12", ".", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "ß", "\n", "ſecret"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert secrets.base_spans(t) == brute_secrets(t)
        assert not secrets.spans_of(t) or secrets.candidates(pa.array([t]))[0]


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + head + body


def integer(n, size=1):
    return der(2, n.to_bytes(size))


RSA = der(0x30, integer(0) + b"".join(integer(255, 40) for _ in range(8)))
PKCS8 = der(0x30, integer(0) + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))


def token(header, payload):
    b = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{b(header)}.{b(payload)}.{base64.urlsafe_b64encode(b'signature').decode().rstrip('=')}"


def test_structure_confirms():
    kinds = lambda t: [k for k, _, _ in secrets.spans_of(t)]
    good = token({"alg": "HS256"}, {"sub": 1})
    assert secrets.spans_of(f"a {good} b") == [("jwt", 2, 2 + len(good))]
    assert kinds(token({"typ": "x"}, {"sub": 1})) == []
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----"
    assert kinds(pem) == ["pem"]
    assert kinds(pem.replace("M", "N", 1)) == [] or "pem" not in kinds(pem.replace("M", "N", 1))
    assert kinds(base64.b64encode(PKCS8).decode()) == ["der"]
    assert kinds(base64.b64encode(PKCS8[:-3]).decode()) == []
    assert "der" in kinds(PKCS8.hex())
    part = lambda b: len(b).to_bytes(4) + b
    ssh = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4) + part(b"public") + part(b"private" * 9)
    assert kinds(base64.b64encode(ssh).decode()) == ["openssh"] and kinds(base64.b64encode(ssh + b"x").decode()) == []
    assert kinds(base64.b64encode(b"my password=hunter2hunter2 and more text").decode()) == ["encoded"]


def test_decoded_texts_are_scanned():
    spans = lambda t: secrets.spans_of(t)
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----\n"
    locked = pem.replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n", 1)
    locked = locked.replace(base64.encodebytes(RSA).decode(), base64.encodebytes(bytes(range(7, 247))).decode())
    assert [k for k, _, _ in spans(f"x {locked} y")] == ["pem"]
    assert spans(locked.replace("DEK-Info", "Info")) == []
    for secret in ("password=hunter2hunter2", pem, locked, "HOST=x\r\n\tPORT=1\r\nPASSWORD=abcdefgh1\r\n"):
        code = base64.b64encode(secret.encode()).decode()
        assert spans(f"a {code} b") == [("encoded", 2, 2 + len(code))]
        if len(code) > 76:
            lines = base64.encodebytes(secret.encode()).decode().strip()
            assert spans(f"a\n{lines}\nmore text") == [("encoded", 2, 2 + len(lines))]
    assert spans("a " + base64.b64encode(b"line one\nline two\n").decode()) == []


def test_secrets_in_spark(spark, docs_of):
    rows = [*ODD, (7, "é token = \"" + "a1" * 20 + "\" z"), (8, "x" * 100_000 + " password=abcdefgh1")]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_of(rows)).collect()}
    assert list(zip(got[7].kinds, got[7].starts, got[7].ends)) == [("assign", 2, 51), ("hex", 11, 51)]
    assert got[8].kinds == ["assign"] and all(got[k].kinds == [] for k in (1, 2, 3, 4, 5))
    clean = {r.doc_id: r for r in secrets.redact_secrets(docs_of(rows)).collect()}
    assert clean[7].text == "é <removed>\" z" and clean[7].n_chars == len(clean[7].text) and clean[1].text is None
    assert all(secrets.spans_of(r.text or "") == [] for r in clean.values()) and clean[5].text == "a " * 60_000
    assert secrets.find_secrets(docs_of([])).count() == 0


# --------------------------------------------------------------------------- personal data


def brute_personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (2 if i % 2 else 1)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_personal_against_brute_force():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "x@y.com", "1", "22", "255", "256", "007", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+", "(", ")", " ", "  ", "٣", "+1 (654) 555-9716", "\n"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == brute_personal(t)


def test_long_runs_are_fast():
    import time

    start = time.time()
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000):
        pii.base_spans(t)
        secrets.spans_of(t)
    assert time.time() - start < 20


def test_labelers_add_spans(spark, docs_of):
    rows = [(k, f"text {k} +1 (654) 555-971{k % 10} and a{k}@mail.example.com") for k in range(40)]
    rows += [(100, "please call my phone 654-555-9716 now"), (101, "order # 111-111-1111"), (102, "My name is James Miller"), *ODD]
    df = docs_of(rows)
    model = pii.learn(df)
    assert model.reliability["regex"] > 0.8
    got = {r.doc_id: r for r in pii.find_personal_data(df, model).collect()}
    assert got[100].kinds == ["phone"] and (got[100].starts, got[100].ends, got[100].strict) == ([21], [33], [False])
    assert got[101].kinds == [] and got[102].kinds == ["name"] and got[3].strict == []
    assert got[0].kinds == ["email", "phone"] and got[0].strict == [True, True]
    assert pii.find_personal_data(docs_of([]), pii.learn(docs_of([]))).count() == 0


# --------------------------------------------------------------------------- tokens


def test_personal_data_row_by_row(spark, docs_of):
    rng = random.Random(21)
    made = ["call (212) 555-0182 now", "order 212-555-0182-77", "ssn 123-45-6789", "id 000-12-3456", "jo [at] mail [dot] com", "my name is Anna Schmidt", "Dr. Xyz",
            "iban DE89 3704 0044 0532 0130 00", "part DE89 3704 0044 0532 0130 01", "x@y.org", "10.0.0.1", "3782 822463 10005", "0049 30 1234 5678", "v 1.2.3.4"]
    rows = [(k, " ".join(rng.choice(made) for _ in range(rng.randint(0, 5)))) for k in range(120)]
    model = pii.learn(docs_of(rows))
    counted = pii.Counter()
    for _, t in rows:
        base = pii.base_spans(t)
        for kind, a, e, strict in [*((*x, True) for x in base), *((*x, False) for x in pii.candidates(t, base, any(c.isdigit() for c in t)))]:
            counted[kind, pii._votes(kind, t, a, e, strict), pii._features(kind, t[a:e])] += 1
    again = pii.fit(counted)
    assert np.allclose(model.weights, again.weights, atol=1e-6) and set(model.reliability) == {"regex", "checksum", "gazetteer", "context", "shape"}
    got = {r.doc_id: list(zip(r.kinds, r.starts, r.ends, r.strict)) for r in pii.find_personal_data(docs_of(rows), model, batch_bytes=500).collect()}
    for k, t in rows:
        base = pii.base_spans(t)
        want = [(*x, True) for x in base]
        for kind, a, e in pii.candidates(t, base, any(c.isdigit() for c in t)):
            if model.probability((kind, pii._votes(kind, t, a, e, False), pii._features(kind, t[a:e]))) >= 0.9:
                want.append((kind, a, e, False))
        assert got[k] == sorted(want, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    assert pii.find_personal_data(docs_of([]), model).count() == 0
    votes = lambda kind, t, s: pii._votes(kind, t, t.index(s), t.index(s) + len(s), False)[0]
    assert votes("phone", "a (212) 555-0182", "(212) 555-0182") == 1 and votes("ssn", "7.123-45-6789", "123-45-6789") == -1


def test_expectation_maximisation_by_rows():
    rng = random.Random(5)
    patterns = [("phone", tuple(rng.choice([-1, 0, 1]) for _ in range(5)), (k, 0, 0)) for k in range(6)]
    counts = np.array([rng.randint(1, 9) for _ in patterns], float)
    post, right = pii._expectation_maximisation(patterns, counts)
    rows = [p for p, n in zip(patterns, counts) for _ in range(int(n))]
    by_row, same = pii._expectation_maximisation(rows, np.ones(len(rows)))
    assert np.allclose(np.repeat(post, counts.astype(int)), by_row, atol=1e-6) and all(abs(right[k] - same[k]) < 1e-6 for k in right)


def odd_texts():
    rng = random.Random(4)
    parts = [" ", "\n", "\t", "\r", "ab", "é", "'s", "'ll", "1²½ª", "<|endoftext|>", "<s>", "▁", "'", ".", "\x85", "\xa0", "\x1c", "　", "😀", "ß", "  ", "Ǆ", "\xad", "１", "ﬁ", "−", ", "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]


def test_piece_counts_equal_the_library():
    count = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert count.safe
    assert count(odd_texts()) == [len(x) for x in count.model.encode(odd_texts())]


def test_token_counts(spark, docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    count = tokens.PieceCounter(path)
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokens.count_tokens(docs_of(ODD), path, batch_bytes=100).collect()}
    assert got == {(i, len((t or "").encode())): len(count.model.encode(t or "")) for i, t in ODD}
    assert tokens.count_tokens(docs_of([]), path).count() == 0
    json_path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.count_tokens(docs_of([(1, "a<|endoftext|>b")]), json_path).first().n_tokens == 3


def test_packing_ids_equal_the_library():
    encode = packing.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode.plain and encode.direct
    want = [np.array(encode.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd_texts()]
    assert encode(odd_texts()) == want
