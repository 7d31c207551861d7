"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags and classes
are one node. A node's importance combines the entropy of its presentation (the sequences
of children that pages show there) and of its content (the texts that pages hold there):
what looks and reads alike on a whole site is noise. On each page the largest branches
whose every part is of low importance are removed; inside an article only what more than
five pages share is. Tags and roles of menus, footers and the like remove branches as well, and
words in classes that say so: plain ones everywhere, doubtful ones inside an article only
where the branch is nothing but links or its composite importance (the mean by text) is
under one half.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, drop_path, map_arrow, written

_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "noembed", "noframes", "audio", "video", "canvas", "annotation", "annotation-xml")
#: Text in these is taken as it stands up to the closing tag.
_RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements of no use for the main text.
_NOISE = frozenset((*_RAW, "nav", "footer", "aside", "form", "button", "input", "dialog", "menu", "head", "fieldset", "option"))
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre section table ul".split()
)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: Words of classes and ids that name noise wherever they are.
_NOISE_NAME = re.compile(
    r"(?i)(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adsense|adslot|adbox|sponsor(?:ed|s)?|promo(?:tion|s)?|nav|navbar|navigation|"
    r"menu|menus|breadcrumbs?|crumbs?|sidebar|side-?bar|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|signup|"
    r"comments?|disqus|respond|replies|reply|pagination|pager|paywall|outbrain|taboola|visually-hidden|sr-only)(?:$|[-_\s\d])"
)
#: Words that name noise around an article, but may stand for a part of one inside it.
_DOUBTFUL_NAME = re.compile(
    r"(?i)(?:^|[-_\s])(?:banners?|rail|widgets?|footer|foot|header|masthead|topbar|toolbar|alert|overlay|login|search|share|sharing|social|"
    r"related|recommend(?:ed|ations)?|more-?stories|trending|popular|tags|skip|copyright|legal|disclaimer|hidden)(?:$|[-_\s\d])"
)
_COMMENT_NAME = re.compile(r"(?i)(?:^|[-_\s])(?:comments?|disqus|replies|reply)(?:$|[-_\s\d])")
_HEADING = re.compile(r"(?i)head(?:er|ing)?")
_MAIN_NAME = re.compile(
    r"(?i)(?:^|[-_\s])(?:article|article-?body|post|post-?body|post-?content|entry|entry-?content|main|main-?content|story|"
    r"story-?body|content|body-?text|text-?body|hentry)(?:$|[-_\s\d])"
)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())

Node = tuple[int, int, str, str, bool]  #: (parent, path, tag, use, block)


def _use(tag: str, attrs: str, in_main: bool) -> tuple[str, str]:
    """(use, name under which the element merges); uses: noise, named (noise by its class), doubtful, body (main by its class), main, article, or nothing."""
    use, name = "", tag
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if in_main:  # an article's own header or heading has its title
                    value = _HEADING.sub("", value)
                name += "." + _DIGITS.sub("0", value.strip().lower())
                if tag in ("article", "main"):
                    use = "named" if _COMMENT_NAME.search(value) else use
                elif tag in ("body", "html") or use in ("noise", "named", "body", "main", "article"):
                    pass
                elif _NOISE_NAME.search(value):
                    use = "named"
                elif _DOUBTFUL_NAME.search(value):
                    use = "doubtful"
                elif _MAIN_NAME.search(value):
                    use = "body"
            elif key == "role":
                use = "noise" if value.lower() in _NOISE_ROLE else value.lower() if value.lower() in ("main", "article") else use
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                use = "noise"
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                use = "noise"
    if use == "noise":
        return use, name
    if tag == "form":
        use = "named"  # a form around a whole article is no form's text
    elif tag in _NOISE:
        use = "noise"
    elif tag == "header":
        # A page's header is noise; an article's own header has its title.
        use = use if in_main else "noise"
    elif tag in ("article", "main") and use != "named":
        use = tag
    return use, name


_DIGITS = re.compile(r"\d+")
_TOP = 0xCBF29CE484222325


def _step(path: int, name: str) -> int:
    """The path of a child, of any depth, as a number of 63 bits."""
    return int.from_bytes(hashlib.blake2b(f"{path}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements (the first is the root) and texts (element, raw text) of a page, in page order."""
    nodes: list[Node] = [(-1, _TOP >> 1, "", "", True)]
    steps: dict[tuple[int, str], int] = {}
    texts: list[tuple[int, str]] = []
    stack = [0]
    main = [False]
    at, n = 0, len(page)
    for_tag = _TAG.search
    while at < n:
        m = for_tag(page, at)
        if m is None:
            texts.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            texts.append((stack[-1], page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                texts.append((stack[-1], html.escape(m[0][9:-3])))
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]][2] == tag:
                    del stack[k:], main[k:]
                    break
                # An inline end tag doesn't close blocks, nor a block's end what holds it.
                if tag in _INLINE and nodes[stack[k]][4] or nodes[stack[k]][2] in ("td", "th", "table", "article", "main", "section", "body") and tag in ("p", "li", "dd", "dt"):
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]][2]
                if t == "p":
                    del stack[k:], main[k:]
                    break
                if t not in _INLINE:
                    break
        if tag in _ENDS:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]][2]
                if t in _ENDS[tag]:
                    del stack[k:], main[k:]
                    if tag != "tr":
                        break
                if t in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        use, name = _use(tag, m[3], main[-1])
        parent = stack[-1]
        step = nodes[parent][1], name
        if step not in steps:
            steps[step] = _step(*step)
        nodes.append((parent, steps[step], tag, use, tag not in _INLINE))
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "math"):
            if tag in ("br", "hr"):
                texts.append((len(nodes) - 1, " "))
            continue
        if tag in _RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            close = page.find(">", at)
            at = n if not end or close < 0 else close + 1
            continue
        stack.append(len(nodes) - 1)
        main.append(main[-1] or use in ("body", "main", "article"))
    return nodes, texts


def _digest(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) << 16 ^ zlib.adler32(s.encode("utf-8", "surrogatepass"))


def features(page: str) -> Counter:
    """(path, kind, feature) of a page: the children shown at each node, and the text it holds (once a page and path)."""
    nodes, texts = parse(page)
    shown: dict[int, list[int]] = {}
    held: dict[int, list[str]] = {}
    for parent, path, _, _, _ in nodes[1:]:
        kids = shown.setdefault(nodes[parent][1], [])
        if not kids or kids[-1] != path:
            kids.append(path)
        shown.setdefault(path, [])
    for node, raw in texts:
        if raw.strip():
            held.setdefault(nodes[node][1], []).append(raw)
    out: Counter = Counter()
    for path, kids in shown.items():
        out[path, "p", _digest(" ".join(map(str, kids)))] += 1
        if path in held:
            out[path, "c", _digest(_SPACE.sub(" ", "\n".join(held[path])))] += 1
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without its port (empty if there is none)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def importances(
    pages: DataFrame, least_pages: int = 2, most: float = 0.6, batch_bytes: int = 4 << 20, keep: list[str] | None = None
) -> DataFrame:
    """(host, path, importance, pages) of the style-tree nodes that hold text and are under ``most``, from pages (host, html).

    Presentation and content importance are entropies over a node's features, to the base of
    the number of pages that have it (0: all pages alike, 1: all differ). Few pages show too
    little of how a node varies, so each entropy is raised by (distinct features - 1) / (2
    pages), as Miller and Madow do; what is alike on all pages stays at 0. A node that fewer
    than ``least_pages`` different pages of the host have is not judged; rows that repeat a
    page count as one. Counts are summed in the tasks before each shuffle, so that a hot
    host is no hot key: its rows are as many as its distinct features.
    """
    digest = F.unhex(F.md5(F.concat("host", F.lit("\x00"), "html"))).alias("digest")
    repeats = written(pages.select(digest).groupBy("digest").agg(F.count("*").alias("c")).where("c > 1"), keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            cols = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))]
            cols.append(pa.array([counts[k] for k in keys], pa.float64()))
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, names=["host", "path", "kind", "feature", "n"])

        for b in by_bytes(batches, batch_bytes, "html"):
            for host, page, share in zip(*(b.column(j).to_pylist() for j in range(3))):
                for (path, kind, feature), c in features(page).items():
                    counts[host, path, kind, feature] += c * share
            if len(counts) > 100_000:
                yield flush()
        yield flush()

    once = pages.select("host", "html", digest).join(repeats, "digest", "left").select("host", "html", F.coalesce(F.lit(1.0) / F.col("c"), F.lit(1.0)).alias("share"))
    seen = map_arrow(once, run, "host string, path long, kind string, feature long, n double")
    seen = seen.groupBy("host", "path", "kind", "feature").agg(F.round(F.sum("n"), 3).alias("n"))
    nodes = seen.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("d"))
    nats = F.log("m") - F.col("nlogn") / F.col("m") + (F.col("d") - 1) / (2 * F.col("m"))
    entropy = F.when(F.col("m") > 1, F.least(F.lit(1.0), nats / F.log("m"))).otherwise(1.0)
    rows = nodes.select("host", "path", "kind", "m", entropy.alias("h"))
    both = rows.groupBy("host", "path").agg(
        F.max("m").alias("m"),
        F.coalesce(F.max(F.when(F.col("kind") == "p", F.col("h"))), F.lit(0.0)).alias("presentation"),
        F.max(F.when(F.col("kind") == "c", F.col("h"))).alias("content"),
    )
    # A leaf is judged by its content, an inner node by its presentation and what content it has itself.
    importance = F.greatest("presentation", "content")
    return both.where((F.col("m") >= least_pages) & F.col("content").isNotNull() & (importance < most)).select("host", "path", importance.alias("importance"), F.col("m").alias("pages"))


def main_text(page: str, low: dict[int, tuple[float, float]] | None = None, threshold: float = 0.2) -> str:
    """Blocks of the page's main text, joined by two line ends.

    ``low`` has the importance of nodes that the site's pages share, and how many share them;
    other nodes count as 1. If the page marks its articles (article, main, or a class that
    says so), only their text counts. A page whose every part is of low importance is kept.
    """
    low = low or {}
    nodes, texts = parse(page)
    n = len(nodes)
    weight, linked, links, worth, peak, holds, in_link, inner = [0] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n, [False] * n, [False] * n, [False] * n
    for k, (parent, _, tag, use, _) in enumerate(nodes[1:], 1):
        in_link[k] = in_link[parent] or tag == "a"
        inner[k] = inner[parent] or use in ("article", "main", "body")
    for node, raw in texts:
        if size := len("".join(raw.split())):
            importance, pages = low.get(nodes[node][1], (1.0, 1.0))
            if inner[node]:  # few pages prove little about parts of an article
                importance = max(importance, 1 / pages)
            weight[node] += size
            linked[node] += size * in_link[node]
            worth[node] += size * importance
            peak[node] = max(peak[node], importance)
    for k in range(n - 1, 0, -1):  # sums of branches, and whether they hold a marked article
        parent, _, tag, use, _ = nodes[k]
        links[k] += tag == "a"
        for x in (weight, linked, links, worth):
            x[parent] += x[k]
        peak[parent] = max(peak[parent], peak[k])
        holds[parent] |= holds[k] or use in ("article", "main")

    def kept(with_tree: bool, parted: bool) -> tuple[list[bool], list[bool], bool]:
        """Nodes that are dropped, nodes in articles, and whether any text is left (in articles, if there are any)."""
        drop, inside = [False], [False]
        for k, (parent, _, tag, use, is_block) in enumerate(nodes[1:], 1):
            own = use == "article" or use in ("main", "body") and not (parted and holds[k])
            within = inside[parent] or own
            gone = drop[parent] or use == "noise" or use == "named" and not holds[k]
            only_links = links[k] > 0 and linked[k] == weight[k]
            if use == "doubtful" and not holds[k]:
                gone = gone or not inside[parent] or only_links or worth[k] < 0.5 * weight[k]
            if is_block and not within and not holds[k] and links[k] >= 3 and only_links:
                gone = True  # a menu that no class names
            if with_tree and weight[k] and peak[k] < threshold:
                gone = True
            drop.append(gone)
            inside.append(within and not gone)
        left = [inside[node] for node, raw in texts if not drop[node] and raw.strip()]
        return drop, inside, any(left) if any(x[3] in ("article", "main", "body") for x in nodes) else bool(left)

    articles = [k for k, x in enumerate(nodes) if x[3] == "article"]
    around = [k for k, x in enumerate(nodes) if x[3] in ("main", "body") and holds[k]]
    parted = bool(articles) and all(2 * sum(weight[a] for a in articles if _within(nodes, a, k)) >= weight[k] for k in around)
    drop, in_main, left = kept(True, parted)
    if not left and low:
        drop, in_main, _ = kept(False, parted)
    some = any(in_main[node] and not drop[node] and raw.strip() for node, raw in texts)
    block = [0]
    for k, (parent, _, _, _, is_block) in enumerate(nodes[1:], 1):
        block.append(k if is_block else block[parent])
    out: list[str] = []
    parts: list[str] = []
    last = -1

    def flush() -> None:
        s = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if s:
            out.append(s)
        parts.clear()

    for node, raw in texts:
        if drop[node] or some and not in_main[node]:
            # Text that is left out still parts what stands before and after it, if it's a block.
            if block[node] != last:
                flush()
                last = -1
            continue
        if block[node] != last and last >= 0:
            flush()
        last = block[node]
        parts.append(raw)
    flush()
    return "\n\n".join(out)


def _within(nodes: list[Node], k: int, outer: int) -> bool:
    while k > outer:
        k = nodes[k][0]
    return k == outer


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.2,
    least_pages: int = 2,
    broadcast_bytes: int = 32 << 20,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """page_id, url, text of each page row.

    A null or empty html gives an empty text; a null url, or one without a host, belongs to
    the host "". Repeated rows are each answered, and count as one page of the site; other
    columns are ignored; an empty table gives no rows. Pages are read whole, however long or
    deep. A site is judged from two different pages on. The nodes under full importance are
    broadcast, a list per host, while they take at most ``broadcast_bytes``, which is
    counted; else pages meet them in a join on host and a salt, so that no host's pages
    gather in one task.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        host_of(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    keep: list[str] = []
    nodes = importances(rows, least_pages, batch_bytes=batch_bytes, keep=keep)
    listed = F.sort_array(F.collect_list(F.struct("path", F.col("importance").cast("float").alias("importance"), F.col("pages").cast("float").alias("pages")))).alias("low")
    kept: list[str] = []
    low = written(nodes.groupBy("host").agg(listed), kept)
    for path in keep:
        drop_path(spark, path)
    size = low.agg(F.sum(F.size("low") * 20 + F.octet_length("host") + 200)).first()[0] or 0

    def texts(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch, int, str], dict]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, batch_bytes, "html"):
            host, known, made = None, {}, []
            for k, (page, its) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if its != host:
                    host, known = its, of(b, k, its)
                made.append(main_text(page, known, threshold))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["page_id", "url", "text"])

    schema = "page_id long, url string, text string"
    if size <= broadcast_bytes:
        got = low.toArrow()
        tables = {}
        for host, x in zip(got["host"].to_pylist(), got["low"]):
            tables[host] = tuple(x.values.field(j).to_numpy(zero_copy_only=False) for j in range(3))
        shared = spark.sparkContext.broadcast(tables)
        drop_path(spark, kept[0])

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = lambda b, k, host: {p: (i, m) for p, i, m in zip(*(x.tolist() for x in shared.value[host]))} if host in shared.value else {}
            yield from texts(batches, lru_host(of))

        return map_arrow(rows.select("page_id", "url", "html", "host"), sent, schema)
    salts = 64
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from texts(batches, lambda b, k, host: {x["path"]: (x["importance"], x["pages"]) for x in b.column(4)[k].as_py() or ()})

    return map_arrow(met.select("page_id", "url", "html", "host", "low"), joined, schema)


def lru_host(of: Callable[[pa.RecordBatch, int, str], dict], most: int = 64) -> Callable[[pa.RecordBatch, int, str], dict]:
    """``of`` with what it gave for the last hosts."""
    known: dict[str, dict] = {}

    def get(b: pa.RecordBatch, k: int, host: str) -> dict:
        if host not in known:
            if len(known) >= most:
                known.pop(next(iter(known)))
            known[host] = of(b, k, host)
        return known[host]

    return get
