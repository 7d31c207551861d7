"""Packing, near-duplicates, top-k, toxicity, language, pages, and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrachron.llm import html, langid, neardup, packing, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(901, None), (902, ""), (903, "   \n"), (904, "..."), (904, "..."), (905, "a " * 20_000)]


# --------------------------------------------------------------------------- packing


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(40, 60), 100]) for _ in range(rng.choice([1, 30, 400])))
    plan = packing.complete(counts, 100, budget=20_000)
    held = Counter()
    for pattern, n in plan:
        assert sum(s * c for s, c in pattern) <= 100 and n > 0
        for s, c in pattern:
            held[s] += n * c
    bins = sum(n for _, n in plan)
    assert held == counts and bins <= sum(n for _, n in packing.best_fit(counts, 100))
    assert packing.lower_bound(counts, 100) <= bins


def test_bin_completion_beats_best_fit():
    counts = Counter([6, 5, 5, 4, 4, 3, 3])  # best fit leaves gaps that completion avoids
    assert sum(n for _, n in packing.complete(counts, 10)) == 3
    assert packing.complete({}, 10) == []


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(*rng.choice([(1, 30), (20, 60)])) for _ in range(9)), reverse=True)

    def least(k, rooms, held):
        if len(rooms) >= held:
            return held
        if k == len(sizes):
            return len(rooms)
        for room in set(rooms):
            if room >= sizes[k]:
                left = list(rooms)
                left.remove(room)
                held = least(k + 1, [*left, room - sizes[k]], held)
        return least(k + 1, [*rooms, 60 - sizes[k]], held)

    assert sum(n for _, n in packing.complete(Counter(sizes), 60)) == least(0, [], len(sizes))


def test_bin_completion_backtracks():
    rng = random.Random(9)
    better = 0
    for _ in range(8):
        counts = Counter(rng.choice([rng.randint(1, 100), rng.randint(40, 60), rng.randint(25, 50)]) for _ in range(60))
        bins = sum(n for _, n in packing.complete(counts, 100, budget=30_000))
        better += bins < sum(n for _, n in packing.best_fit(counts, 100))
        assert packing.lower_bound(counts, 100) <= bins
    assert better


def test_packed_documents(spark, docs_of):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["alpha", "b", "gamma ray"]) for _ in range(rng.choice([3, 40, 900])))) for k in range(60)] + ODD
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.ByteLevel(path)
    got = packing.pack(docs_of(rows), path, capacity=256, budget=20_000).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[n for _, n in b]])[:-1].tolist() and sum(n for _, n in b) <= 256
    want = Counter()
    for i, t in rows:
        ids = encode.whole(t or "") + b"\0\0\0\0"
        n = len(ids) // 4
        cuts = [0, *range((n - 1) % 256 + 1, n + 1, 256)] if n > 256 else [0, n]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(bins) <= packing.lower_bound(Counter(r.length for r in got), 256) + 1
    assert packing.pack(docs_of([]), path).count() == 0


# --------------------------------------------------------------------------- near-duplicates


def shingles(t):
    import re

    w = re.findall(r"[0-9a-z]+", t.lower())
    return Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else Counter()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([20, 150, 800]))]
        if k % 4 == 0:
            base += passage
        rows.append((10 * k, " ".join(base)))
        if k % 3 == 0:
            for j in range(1, rng.choice([2, 5])):
                edited = [word() if rng.random() < 0.04 else w for w in base]
                rows.append((10 * k + j, " ".join(edited)))
        if k % 5 == 0:
            rows.append((10 * k + 9, " ".join(base)))
    return rows


def test_signatures_estimate_similarity():
    rows = corpus()
    raw = [t.encode() for _, t in rows]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    sig = neardup.signatures(data, at)
    for i in range(0, len(rows), 7):
        for j in range(i):
            s = similarity(rows[i][1], rows[j][1])
            assert abs((sig[i] == sig[j]).mean() - s) < 0.15
    alone = neardup.signatures(np.frombuffer(raw[3], np.uint8), np.array([0, len(raw[3])]))
    assert (alone[0] == sig[3]).all()
    assert not neardup.signatures(np.frombuffer(b"... ", np.uint8), np.array([0, 4])).any()


def test_classes_against_brute_force(docs_of):
    rows = corpus()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if similarity(s, t) >= 0.5:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i, _ in rows}
    got = {r.doc_id: r for r in neardup.with_class_ids(neardup.classes(docs_of(rows))).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all((r.n_links > 0) == (len({t for d, t in rows if want[d] == want[i]}) > 1) for i, r in got.items())


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (2000, neardup.K)).astype("<u2")
    for s, least in ((0.45, 0.9), (0.5, 0.96), (0.55, 0.99), (0.6, 0.995)):
        b = np.where(rng.random(a.shape) < s, a, a + 1).astype("<u2")
        assert (neardup.band_hashes(a) == neardup.band_hashes(b)).any(axis=1).mean() > least


def test_links_against_brute_force(docs_of, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base, rows = [word() for _ in range(200)], []
    for k in range(90):  # a bucket of texts of which many, but not all, are like each other
        share = rng.choice([0.02, 0.06, 0.1, 0.14])
        own = [word() for _ in range(60)] if k % 3 == 0 else []
        rows.append((k, " ".join([word() if rng.random() < share else w for w in base] + own)))
    raw = [t.encode() for _, t in rows]
    sig = neardup.signatures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    bands = neardup.band_hashes(sig)
    assert not len(neardup.first_bands(np.empty((0, neardup.K), bool)))
    linked = np.array([[i != j and (x == y).mean() >= 0.45 and (p == q).any() for j, (y, q) in enumerate(zip(sig, bands))] for i, (x, p) in enumerate(zip(sig, bands))])
    assert 10 < linked.sum(axis=1).max() and not linked.all(axis=None)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(rows))]
    for block in (1024, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: (r.n_links, r.class_id) for r in neardup.with_class_ids(neardup.classes(docs_of(rows))).collect()}
        assert got == {i: (linked[i].sum(), root[i]) for i in range(len(rows))}


def test_odd_documents_and_survivors(docs_of):
    rows = [(1, "one two three four five"), (2, "one two three four five"), (2, "one two three four five"), (3, "else"), (3, "other words"), *ODD]
    got = neardup.with_class_ids(neardup.classes(docs_of(rows))).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} >= {(1, 1), (2, 1), (901, 901), (902, 902), (903, 903), (904, 904)}
    kept = sorted((r.doc_id, r.text or "") for r in neardup.deduplicate(docs_of(rows)).collect())
    assert kept == sorted({(i, t or "") for i, t in rows if i != 2})
    by_shuffle = neardup.deduplicate(docs_of(rows), broadcast_rows=0)
    assert sorted((r.doc_id, r.text or "") for r in by_shuffle.collect()) == kept and by_shuffle.columns == docs_of(rows).columns
    assert neardup.classes(docs_of([])).count() == 0 and neardup.deduplicate(docs_of([])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1, 1.0) for k in range(40)] + [(100, 200, 1.0)], "a long, b long, sim double")
    got = {r.node: r.root for r in neardup.components(links, []).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100}


# --------------------------------------------------------------------------- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(-9, 10, (400, 8)).astype(float)
    v[50:170] = v[7]  # ties and repeats: more than a shard holds
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(7, v[7].tolist())]
    rows += [(2000 + k % 2, []) for k in range(3)]
    rows += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, [1.0, 2.0]), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("rank", F.lit(1))
    asked = df.where("vec_id % 10 = 0")
    good = [(i, np.array(x)) for i, x in rows if i is not None and x and i < 1000]
    for settings in ({"shard_rows": 64, "leaf": 8, "pass_rows": 30}, {"shard_rows": 128, "max_roots": 0, "max_pivots": 1}):
        got = defaultdict(list)
        for r in topk.top_k(df, asked, k=15, **settings).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert got.pop(2000) == [(1, 2001, 0)] and set(got) == {i for i, _ in good if i % 10 == 0}
        for i, q in good:
            if i % 10 == 0:
                want = sorted((-int(q @ c), j) for j, c in good if j != i)[:15]
                assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert {r.shard for r in topk._shards(df.where("vec_id < 400 and v is not null").select("vec_id", "v"), 400, 32, 64, []).collect()} > set(range(8))
    few = df.where("vec_id < 3")
    assert topk.top_k(few, few, k=20).count() == 6
    assert topk.top_k(df.limit(0), df.limit(0), k=3).count() == 0


# --------------------------------------------------------------------------- toxicity


def test_folding():
    assert toxicity.fold("1D10T $tupid!") == toxicity.fold("idiot stupid ").ljust(len("1D10T $tupid!"))[: len("1D10T $tupid!")] or toxicity.fold("1D10T").strip() == toxicity.fold("idiot")
    assert toxicity.fold("іdіоt") == toxicity.fold("idiot")  # Cyrillic letters
    assert toxicity.fold("ID​IOT") == toxicity.fold("idiot")


def test_matching_words_stems_and_exceptions():
    lex = toxicity.Lexicon({toxicity.fold("trash"): 1.0, toxicity.fold("moron") + "*": 2.0}, (toxicity.fold("trash can"),))
    hits = lambda t: [w for w, _ in lex.hits(toxicity.fold(t))]
    assert hits("trash, Moronic tr4sh") == [1.0, 2.0, 1.0]
    assert hits("a trash can and trashy") == [] and hits("") == []
    assert hits("trásh") == [1.0]
    assert 0 <= lex.score("")[0] < lex.score(toxicity.fold("trash moron"))[0] <= 1


def test_hits_against_a_naive_matcher():
    rng = random.Random(4)
    letters = "abcé"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    weights = {word() + rng.choice(["", "*"]): float(rng.randint(1, 5)) for _ in range(12)}
    spared = tuple({f"{word()} {word()}" for _ in range(6)})
    lex = toxicity.Lexicon(weights, spared)
    bare = lambda w: w.replace("é", "e")
    for _ in range(400):
        words = [word() for _ in range(rng.randint(0, 12))]
        out = []
        for k, w in enumerate(words):
            found = [x for t, x in weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
            if "é" in " ".join(words):
                found += [x for t, x in weights.items() if t.isascii() and not t.endswith("*") and bare(w) == t]
            pairs = [words[k - 1 : k + 1]] * (k > 0) + [words[k : k + 2]]
            free = any(" ".join(p) in spared or "é" in " ".join(words) and " ".join(map(bare, p)) in spared for p in pairs)
            if found and not free:
                out.append(max(found))
        assert sorted(w for w, _ in lex.hits(" ".join(words))) == sorted(out)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    from terrachron.llm import queries

    got = queries.op8_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n[0, 0] >= 0.995 * (n[0, 0] + n[0, 1])


def test_lexicon_is_learned(spark, docs_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows, labels = [], []
    for k in range(400):
        text = [word() for _ in range(rng.choice([8, 60]))]
        toxic = k % 5 == 0
        if toxic:
            text[2:2] = ["zorgle", "quuxi" + word()]
        elif k % 7 == 0:
            text[2:2] = ["mild", "zorgle"] if k % 14 else ["mild"]
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    df = docs_of([*rows, *ODD])
    lab = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    lex = toxicity.learn_lexicon(df, lab)
    assert {toxicity.fold("zorgle")} <= {t.rstrip("*") for t in lex.weights} and any(t.startswith("quu") for t in lex.weights)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, lex).collect()}
    right = sum((got[k].score >= 0.7) == (k % 5 == 0) for k in range(400))
    assert right >= 390 and got[901].score < 0.7 and 0 <= got[902].score
    kept = {r.doc_id for r in toxicity.drop_toxic(df, lex).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7} and {901, 902, 903, 904, 905} <= kept
    assert toxicity.learn_lexicon(df, lab.where("toxic = 0")) == toxicity.default_lexicon()
    assert toxicity.score_toxicity(docs_of([]), lex).count() == 0


# --------------------------------------------------------------------------- language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = langid.learn_and_identify(docs, fold != 2).join(docs, "doc_id").where(fold == 2)
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 20 and right >= 0.95 * n


def test_language_of_odd_texts(spark, docs_of):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    langs, table = langid.train(train)
    assert langs == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(docs_of([*ODD, (1, "und der hund"), (2, "123 !?"), (3, "the dog")]), langs, table).collect()}
    assert got[1].lang_pred == "de" and got[3].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (901, 902, 903, 904, 2))
    none = langid.train(train.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs_of([(1, "a")]), *none).collect()} == {"und"}
    assert langid.identify(docs_of([]), langs, table).count() == 0


def test_language_against_brute_force(spark, docs_of):
    import math

    rng = random.Random(3)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    texts = [(k, " ".join(word("abcdÉ" if k % 2 else "xyzdä") for _ in range(30)) + "! 12", "en" if k % 2 else "de") for k in range(20)]
    langs, table = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"), bits=12)

    def grams(t):
        low = [c.lower() if c.isalpha() else " " for c in "  " + t]
        points = np.array([*map(ord, low)], np.uint32)
        return [int(h[k]) for h in langid.buckets(points, 12) for k in range(len(low)) if low[k] != " "]

    counts = {lang: Counter(g for _, t, own in texts if own == lang for g in grams(t)) for lang in langs}
    logs = {lang: [math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * 4096)) for g in range(4096)] for lang, c in counts.items()}
    assert np.allclose(table, [logs[lang] for lang in langs], atol=1e-5)
    asked = [(k, " ".join(word("abcdÉxyzä") for _ in range(rng.randint(1, 9)))) for k in range(30)]
    got = {r.doc_id: r for r in langid.identify(docs_of(asked), langs, table).collect()}
    for k, t in asked:
        n = sum(c.isalpha() for c in t)
        x = {lang: sum(logs[lang][g] for g in grams(t)) / math.sqrt(n) / 2 for lang in langs}
        best = max(langs, key=x.get)
        assert got[k].lang_pred == best and abs(got[k].score - 1 / sum(math.exp(v - x[best]) for v in x.values())) < 1e-3


def test_scores_equal_row_by_row():
    import pyarrow as pa

    texts = pa.array(["Der Hund.", "", "Ça va?", "a"])
    points, at = langid.folded(texts)
    for k, t in enumerate(texts.to_pylist()):
        alone, _ = langid.folded(pa.array([t]))
        assert (points[at[k] : at[k + 1]] == alone).all() and len(alone) == len(t) + 2


# --------------------------------------------------------------------------- pages


def test_main_text():
    page = (
        "<html><head><title>x</title></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><div class='cookie-notice'>We use</div>"
        "<div id=content><h1>T &amp; U</h1><p>one <b>two</b>three<br>four<p>five&nbsp;six<ul><li>x<li>y</ul><div class=ad>buy</div>tail<!-- c --> end"
        '<script>if(a<b){"</p>"}</script></div><aside>s</aside><section class="comments"><p>nice</p></section><footer>f</footer></body></html>'
    )
    assert html.main_text(page) == "T & U\n\none twothree four\n\nfive six\n\nx\n\ny\n\ntail end"
    assert html.main_text("<article><header class=entry-header><h1>A</h1></header><p>b</p></article><p>other</p>") == "A\n\nb"
    assert html.main_text("") == "" and html.main_text("plain  text") == "plain text" and html.main_text("<p>a<p") == "a"


def test_style_tree_drops_what_a_site_repeats(spark):
    rows = []
    for k in range(40):
        body = f"<div class=x><p>Same on all pages of the site</p></div><div class=y><p>Own text {k} of the page</p></div>"
        rows.append((k, f"http://User@Host.example:80/{k}", f"<body>{body}</body>"))
    rows += [(100, "http://small.example/", "<body><div class=x><p>Same on all pages of the site</p></div></body>"), (101, None, None), (102, "no url", ""), (102, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("low", F.lit(2))
    for size in (1 << 20, 0):
        got = {r.page_id: r for r in html.extract(df, broadcast_bytes=size).collect()}
        assert got[3].text == "Own text 3 of the page" and got[100].text == "Same on all pages of the site"
        assert got[101].text == "" and got[101].url is None and got[102].text == ""
    assert html.extract(df, broadcast_bytes=0).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_parts_of_an_article_stay():
    inside = "<p>one</p><div class=legal>two</div><div class=related>three</div><math><mi>x</mi></math><svg><text>y</text></svg><p>four</p>"
    assert html.main_text(f"<article>{inside}</article>") == "one\n\ntwo\n\nthree\n\nx\n\ny\n\nfour"
    assert html.main_text("<article><p>a</p><div class=related><a>x</a> <a>y</a></div><div class=ad>z</div><form>f</form></article>") == "a"
    assert html.main_text("<form id=page><main><article><p>x</p></article></main></form><form>mail</form>") == "x"
    assert html.main_text("<div class='page has-sidebar'><article>in</article><div class=sidebar>s</div></div>") == "in"
    assert html.main_text("<article>post</article><article class=comment>reply</article>") == "post"
    assert html.main_text("<div class=zork><a>A</a> <a>B</a> <a>C</a></div><div><p>text</p></div>") == "text"


def test_deep_and_long_pages():
    parts = [f"<div class=a>{k} " for k in range(3000)]
    assert html.main_text("".join(parts)).split() == [str(k) for k in range(3000)]
    assert len({p for p, *_ in html.features("".join(parts))}) == 3001  # nodes of deep pages stay apart
    one, two = (f"<div class='{'x' * 80}{c}'>t</div>" for c in "ab")
    assert {p for p, *_ in html.features(one)} != {p for p, *_ in html.features(two)}
    assert html.main_text(f"<article><p>{'word ' * 300_000}</p></article>") == ("word " * 300_000).strip()


def test_importances_against_brute_force(spark):
    import math

    rng = random.Random(17)
    part = lambda: f"<div class={rng.choice('ab')}>{rng.choice(['x', 'y', 'z'])}</div>"
    rows = [(k, f"http://h{k % 3}.example/{k}", "".join(part() for _ in range(rng.randint(0, 4))) + "<p>same</p>" * (k % 4 > 0)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.path): (r.importance, r.pages) for r in html.importances(df.withColumn("host", html.host_of(F.col("url"))), most=2.0).collect()}
    want = {}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        counts = defaultdict(Counter)
        for page in {h for _, u, h in rows if u.split("/")[2] == host}:
            for path, kind, feature in html.features(page):
                counts[path, kind][feature] += 1
        for path, kind in counts:
            if kind == "c":
                both = []
                for k in "pc":
                    c, m = counts[path, k], sum(counts[path, k].values())
                    entropy = -sum(n / m * math.log(n / m) for n in c.values()) + (len(c) - 1) / (2 * m)
                    both.append(min(1.0, entropy / math.log(m)) if m > 1 else 1.0)
                pages = max(sum(counts[path, k].values()) for k in "pc")
                if pages >= 2:
                    want[host, path] = (max(both), pages)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want) and len(want) > 6


def test_style_tree_inside_articles(spark):
    rows = [(k, f"http://h.example/{k}", f"<article><p>Own {k}</p><div class=x>Same</div><div class=legal>Terms</div></article>") for k in range(12)]
    rows += [(100 + k, f"http://two.example/{k}", f"<article><p>Own {k}</p><div class=x>Same</div></article>") for k in range(2)]
    rows += [(200 + k, f"http://copies.example/{k}", f"<nav>{k}</nav><article><p>All alike</p></article>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[k] == f"Own {k}" for k in range(12))
    assert all(got[100 + k] == f"Own {k}\n\nSame" for k in range(2))  # too few pages to judge parts of an article
    assert all(got[200 + k] == "All alike" for k in range(9))  # never all of a page's text


def test_style_tree_judges_small_sites(spark):
    rows = []
    for n in (1, 2, 5, 19):
        for k in range(n):
            body = f"<div class=x><p>Same on all pages of the site</p></div><div class=y><p>Own text {k} of the page</p></div>"
            rows += [(100 * n + k, f"http://h{n}.example/{k}", f"<body>{body}</body>")] * (9 if k == 0 else 1)  # repeats are one page
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        own = f"Own text {r.page_id % 100} of the page"
        assert r.text == (own if r.page_id > 199 else "Same on all pages of the site\n\n" + own)


# --------------------------------------------------------------------------- pipeline


def test_pipeline_stages_on_odd_documents(spark, tmp_path, docs_of):
    import corpus_pipeline

    rows = [(1, "one two three four five"), (2, "one two three four five"), (2, "one two three four five"), (3, "password = hunter2hunter2"), *ODD]
    for case, docs in (("odd", docs_of(rows)), ("none", docs_of([]))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{case}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == columns
                if case == "odd":
                    assert {901, 902, 903, 904, 905} <= {r.doc_id for r in docs.collect()} and docs.where("doc_id = 901").first().text is None
        assert {r.doc_id for r in docs.collect()} == ({1, 3, 901, 902, 903, 904, 905} if case == "odd" else set())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from terrachron.llm import decontam, queries, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages, before = docs.columns, {}, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = stages[name] = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lex = queries.toxic_lexicon(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert toxicity.score_toxicity(stages["toxicity"], lex).where("score >= 0.7").count() == 0
    single = neardup.classes(stages["near_duplicates"])
    assert single.select("root").distinct().count() == single.count() <= stages["toxicity"].count() <= before
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.find_contamination(stages["decontamination"], bench).where("n_hit > 0").count() == 0
    assert secrets.find_secrets(stages["secrets"]).where("size(kinds) > 0").count() == 0
    assert stages["packing"].select("doc_id").distinct().count() == stages["secrets"].count() == stages["near_duplicates"].count()
