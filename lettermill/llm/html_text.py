"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a style node is a path of elements with their classes and ids. For every node the
jobs count on how many pages each layout of its children and each text below it occurs. A node whose layout and texts are much the same
on many pages carries little information (entropy) and is cut from each page as a branch; so is a single text that most pages repeat. What
the markup itself says counts first: navigation, forms, adverts, comments and the like go, and if a page has an article or a main element,
only that is kept, less its own branches of low importance. Inside it a name that merely contains such a word ("related-work") is only
evidence: it raises the importance the node has to reach. Articles that repeat each other are counted once there, so that copies of an
article do not look like boilerplate. Each page is parsed once; counts are summed per (host, node, feature) before they are shuffled, and no
page is collected by its host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.bytes_of import short_batches
from lettermill.llm.url_filter import url_host
from lettermill.session import fresh_dir, materialize

#: Weight of texts against layouts in a node's importance; what is less important is cut, if so many pages have it.
TEXTS, LOW, LEAST_PAGES = 0.9, 0.2, 8
MARKED = 0.5  # the limit for nodes inside an article whose name contains a word of MARKS
DEPTH = 24  # style nodes below this depth count as their ancestor at it

RAW = "script|style|textarea|title|noscript|template|iframe|svg|math|object|canvas|audio|video|xmp"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/a-zA-Z][^>]*>|<[!?][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(\bhidden\b)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img input".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
MAIN = frozenset(("article", "main"))
GONE = frozenset("head nav aside footer form button select menu dialog datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination "
    "footer masthead toolbar share sharing social related recommended comment comments commentlist disqus replies reply respond widget "
    "paywall skip".split()
)
#: Words that say nothing about the content beside one of MARKS.
NEUTRAL = frozenset(
    "area bar block body bottom box button content container count form head header inner item items label left link links list main outer "
    "panel right section slot text thread title top unit wrap wrapper".split()
)


@dataclass
class Element:
    tag: str
    sign: str
    node: int
    gone: bool
    main: bool
    depth: int
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """``blocks``: (nodes, in an article or main, text); ``layouts``: (node, children, in an article or main).

    Nodes go from the outermost inwards, inside an article or main from this element on, and end in the content node: the text there.
    """

    blocks: list[tuple[tuple[int, ...], bool, str]] = field(default_factory=list)
    layouts: set[tuple[int, int, bool]] = field(default_factory=set)


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for name, value, hidden in _ATTR.findall(text):
        out[(name or hidden).lower()] = value.strip("\"'")
    return out


def _goes(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[bool, bool]:
    """Whether the markup says that this is not text of the page's own, and whether its name hints at it."""
    if tag in GONE or tag == "header" and not in_main:
        return True, True
    if not attributes:
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True, True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True, True
    if tag in ("html", "body"):
        return False, False
    names = [{w.lower() for w in _WORD.findall(name)} for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    marked = [words for words in names if words & MARKS]
    if in_main:
        return any(words <= MARKS | NEUTRAL for words in marked), bool(marked)
    return bool(marked) or any("header" in words for words in names), bool(marked)


def parse(source: str) -> Page:
    """Blocks of text and layouts of a page; unclosed and stray tags do no harm."""
    page, stack, buffer = Page(), [Element("", "", 0, False, False, 0)], []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text and not stack[-1].gone:
                main = stack[-1].main
                nodes = dict.fromkeys(e.node for e in stack[1:] if e.main or not main)
                content = _hash(f"{stack[-1].node}|{text}")
                page.blocks.append(((*nodes, content), main, text))

    def pop() -> None:
        flush()
        done = stack.pop()
        if done.depth < DEPTH:
            page.layouts.add((done.node, _hash(" ".join(done.children)), done.main))

    def close_within(tags: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in bounds or stack[i].tag in MAIN:
                return

    def say(text: str) -> None:
        if text and not stack[-1].gone:
            buffer.append(html.unescape(text) if "&" in text else text)

    at = 0
    for m in _TOKEN.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "br":
                buffer.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        if tag not in INLINE or stack[-1].gone:
                            pop()
                        else:
                            stack.pop()
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in CLOSES_P:
            close_within({"p"}, {"td", "th", "div", "section", "table", "button", "blockquote", "li"})
        if tag in SAME:
            close_within(SAME[tag], BOUNDS[tag])
        if tag not in INLINE:
            flush()
        if tag in VOID or len(stack) > 512 and tag in INLINE:
            continue
        parent = stack[-1]
        attributes = _attributes(m["attr"]) if m["attr"] and not m["attr"].isspace() else {}
        main = parent.main or tag in MAIN or attributes.get("role") == "main"
        goes, marked = _goes(tag, attributes, parent.main or tag in MAIN)
        gone = parent.gone or goes
        if gone and not parent.gone:
            flush()
        sign = tag
        if attributes:
            sign = f"{tag}.{'.'.join(sorted(attributes.get('class', '').split()))}#{re.sub(r'[0-9]+', '', attributes.get('id', ''))}"
        if tag in INLINE and not gone:
            stack.append(Element(tag, sign, parent.node, gone, parent.main, parent.depth))
            continue
        if not parent.children or parent.children[-1] != sign:
            parent.children.append(sign)
        node = parent.node
        if parent.depth < DEPTH:  # the lowest bit of a node's name says whether its own name is marked
            node = _hash(f"{parent.node}/{sign}{'@main' if main and not parent.main else ''}") & ~1 | (marked and main)
        stack.append(Element(tag, sign, node, gone, main, parent.depth + 1))
    say(source[at:])
    flush()
    while len(stack) > 1:
        pop()
    return page


def main_text(page: Page, low: frozenset[int] | set[int]) -> str:
    """The blocks outside branches of low importance: those in an article or main element if there are any, else all.

    The article itself is never a branch to cut; one with nothing left would be repeated as a whole and stays as it is.
    """
    inside = [b for b in page.blocks if b[1]]
    kept = [b for b in inside if low.isdisjoint(b[0][1:])] or inside or [b for b in page.blocks if low.isdisjoint(b[0])]
    return " ".join(b[2] for b in kept)


PARSED = "inside array<boolean>, texts array<string>, nodes array<array<bigint>>, layouts array<array<bigint>>, article bigint"


def parse_pages(pages: DataFrame) -> DataFrame:
    """The blocks and layouts of every page, once, beside all columns but ``html``. ``article`` tells articles apart.

    It is the smallest hash of the article's texts: articles that share most texts mostly share it, those that have one sentence in common
    seldom do. Pages without an article have null. ``row`` numbers the rows of the stored table.
    """
    own = [f for f in pages.schema.fields if f.name != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [parse(source.as_py() or "") for source in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in own),
                    pa.array([[b[1] for b in page.blocks] for page in done], pa.list_(pa.bool_())),
                    pa.array([[b[2] for b in page.blocks] for page in done], pa.list_(pa.string())),
                    pa.array([[b[0] for b in page.blocks] for page in done], pa.list_(pa.list_(pa.int64()))),
                    pa.array([[(n, c, int(m)) for n, c, m in page.layouts] for page in done], pa.list_(pa.list_(pa.int64()))),
                    pa.array([min((_hash(b[2]) for b in page.blocks if b[1]), default=None) for page in done], pa.int64()),
                ],
                names=[*(f.name for f in own), "inside", "texts", "nodes", "layouts", "article"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    parsed = pages.mapInArrow(run, f"{schema}, {PARSED}").withColumn("row", F.monotonically_increasing_id())
    path = fresh_dir(pages.sparkSession, "style-tree-pages")
    parsed.write.option("compression", "zstd").parquet(path)  # it is as long as the texts
    return pages.sparkSession.read.schema(parsed.schema).parquet(path)


def style_counts(parsed: DataFrame) -> DataFrame:
    """(host, node, inside, text, feature, n): on how many pages a node has this layout, or this content node below it.

    Nodes inside articles count one page for each article that a host has, others all pages.
    """
    firsts = parsed.where(F.col("article").isNotNull()).groupBy("host", "article").agg(F.min("row").alias("first_row"))
    narrow = parsed.select("row", "host", "inside", "nodes", "layouts").join(firsts.select("first_row"), F.col("row") == F.col("first_row"), "left")
    schema = "host string, node bigint, inside boolean, text boolean, feature bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for row in batch.to_pylist():
                host, first = row["host"], row["first"]
                counts.update((host, node, bool(main), False, layout) for node, layout, main in row["layouts"] if first or not main)
                own = {
                    (host, node, main, True, nodes[-1])
                    for nodes, main in zip(row["nodes"], row["inside"], strict=True) if first or not main
                    for node in nodes[:-1]
                }
                counts.update(own)
            keys = list(zip(*counts, strict=True)) if counts else [[]] * 5
            kinds = pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()
            columns = [pa.array(k, kind) for k, kind in zip(keys, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts.values(), pa.int64())], names=["host", "node", "inside", "text", "feature", "n"]
            )

    rows = narrow.select("host", "inside", "nodes", "layouts", F.col("first_row").isNotNull().alias("first")).mapInArrow(run, schema)
    return rows.groupBy("host", "node", "inside", "text", "feature").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, node, inside, pages, importance): with m pages, the entropy of layouts to base m, and one less the mean entropy of texts.

    A text on n of m pages has entropy log n / log m: 0 on one page, 1 on all. A node on one page has importance 1.
    """
    layout, text, n = ~F.col("text"), F.col("text"), F.col("n")
    sums = counts.groupBy("host", "node", "inside").agg(
        F.sum(F.when(layout, n)).alias("pages"), F.sum(F.when(layout, n * F.log(n))).alias("layouts"),
        F.sum(F.when(text, F.log(n))).alias("texts"), F.count(F.when(text, 1)).alias("distinct_texts"),
    )
    log_m = F.log("pages")
    presentation = (log_m - F.col("layouts") / F.col("pages")) / log_m
    content = F.greatest(F.lit(0.0), 1 - F.col("texts") / F.col("distinct_texts") / log_m)
    mixed = F.when(F.col("distinct_texts") > 0, (1 - TEXTS) * presentation + TEXTS * content).otherwise(presentation)
    return sums.select("host", "node", "inside", "pages", F.when(F.col("pages") > 1, mixed).otherwise(1.0).alias("importance"))


def low_nodes(counts: DataFrame) -> DataFrame:
    """(host, node): nodes of low importance, and content nodes of articles that most pages repeat, on hosts with enough pages."""
    known = importance(counts).where(F.col("pages") >= LEAST_PAGES)
    limit = F.when(F.col("inside") & (F.col("node").bitwiseAND(1) == 1), MARKED).otherwise(LOW)
    styles = known.where(F.col("importance") < limit).select("host", "node")
    # A content node has the importance of its text alone, and must be on most pages of a node above it.
    n, pages = F.col("n"), F.col("pages")
    often = counts.where(F.col("inside") & F.col("text") & (n > LEAST_PAGES / 2))
    repeated = often.join(known.where("inside").select("host", "node", "pages"), ["host", "node"]).where(
        (2 * n > pages) & (1 - F.log(n) / F.log(pages) < LOW)
    )
    return styles.unionByName(repeated.select("host", F.col("feature").alias("node"))).distinct()


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages have empty text; a null URL, or one without a host, is of the host that has no name. Repeated rows are
    extracted one by one, and their article counts once in the tree. A very long page is parsed whole. An empty table gives no rows;
    other columns are ignored.
    """
    short_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = parse_pages(own.withColumn("host", url_host(F.col("url"))))
    counts = materialize(style_counts(parsed), "style-tree-counts")
    cut = low_nodes(counts).groupBy(F.col("host").alias("cut_host")).agg(F.collect_list("node").alias("low"))
    cut = materialize(cut, "style-tree-low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["inside", "texts", "nodes", "low"]).to_pylist()
            texts = [
                main_text(Page(list(zip(map(tuple, r["nodes"]), r["inside"], r["texts"], strict=True))), frozenset(r["low"] or ())) for r in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = parsed.join(cut, F.col("host") == F.col("cut_host"), "left").select("page_id", "url", "inside", "texts", "nodes", "low")
    kind = own.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
