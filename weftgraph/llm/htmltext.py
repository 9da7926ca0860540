"""Main text of web pages: flat text blocks classified by a decision tree over themselves and their neighbours."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import mapped, texts_of

MARKUP = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|[!?/][^>]*>)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSEEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page.
RAW = {x: re.compile(rf"</{x}\b[^>]*>|\Z", re.I) for x in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "object", "math", "head_")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Elements, and words of class, id and role names, that mark what surrounds an article.
AROUND = frozenset("nav header footer aside form menu dialog button select".split())
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo".split()
)
#: Those of the names that begin other words too (share-price, header-image): alone they mark, as part of a name they hint.
AMBIGUOUS = frozenset("banner discussion header masthead menu notice notices pager reply replies respond search share skip social toolbar widget".split())
#: Elements that an article is made of, and beginnings of names that only look like those above.
TEXTUAL = HEADINGS | {"p", "section", "blockquote", "figure"}
PHRASES = frozenset((("ad", "hoc"), ("related", "work"), ("related", "works")))
#: Opening one of these ends an open one of the others in its set.
ENDS = [frozenset(("li",)), frozenset(("td", "th", "tr")), frozenset(("dt", "dd")), frozenset(("option",))]
FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "heading", "in_main", "page_has_main", "around")


def around_level(name: str, attributes: str, inside: bool = False) -> int:
    """How much an element looks like a menu, header, footer, sidebar, notice, advert, form or comment: 3 by its kind, 2 by a whole name, 1 by a part of a name.

    A name's first part counts as the whole, but for ambiguous ones.  On headings, paragraphs and
    sections inside an article, and on the article itself, an ambiguous name is a hint at most.  What
    holds the whole page is never one; a form may hold it and counts as a name.
    """
    if name in ("html", "body"):
        return 0
    if name in AROUND:
        return 2 if name == "form" else 3
    if not attributes.strip():
        return 0
    if UNSEEN.search(attributes) or HIDDEN.search(QUOTED.sub("=", attributes)):
        return 3
    level, own = 0, name in MAIN or (inside and name in TEXTUAL)
    for found in NAMED.findall(attributes):
        for token in "".join(found).split():
            parts = [x.lower() for x in NAME_PART.findall(token)]
            if tuple(parts[:2]) in PHRASES:
                continue
            unsure = token.lower() in AMBIGUOUS
            if (token.lower() in AROUND_NAMES and not (own and unsure)) or (parts and parts[0] in AROUND_NAMES and parts[0] not in AMBIGUOUS):
                return 2
            if any(x in AROUND_NAMES for x in parts) and name not in MAIN:
                level = 1
    return level


def blocks_of(html: str) -> list[tuple[str, tuple]]:
    """The flat text blocks of a page in order: (text, features in the order of FEATURES).

    A block ends where a block-level element begins or ends; <br> is white space.  Open elements
    are followed by a stack, in which unclosed paragraphs and list items end as browsers end them.
    Time grows with the page alone: an end tag looks for its element only if one is open, and markup is
    looked for only while there is an end of any left.
    """
    out: list[list] = []
    stack: list[tuple[str, int, bool]] = []  # (name, around, main)
    parts: list[str] = []
    linked, heading, in_link, at, has_main = 0, 0, 0, 0, 0
    around, main = 0, False
    open_: Counter[str] = Counter()
    bounds: list[int] = []  # places in the stack of what is neither inline nor a heading: paragraphs end there at the latest
    last = html.rfind(">")

    def cut(i: int) -> None:
        nonlocal in_link
        for x, _, _ in stack[i:]:
            open_[x] -= 1
            in_link -= x == "a"
        del stack[i:]
        while bounds and bounds[-1] >= i:
            bounds.pop()

    def end() -> None:
        nonlocal linked, heading
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            n = text.count(" ") + 1
            out.append([text, n, min(1.0, linked / n), heading, int(main), min(around, 2)])
        parts.clear()
        linked = heading = 0

    while at <= last and (m := MARKUP.search(html, at)):
        if m.start() > at:
            parts.append(some := html[at : m.start()])
            if in_link:
                linked += len(some.split())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                end()
            if not open_[name]:
                continue
            i = len(stack) - 1
            while stack[i][0] != name and (name not in INLINE or stack[i][0] in INLINE):
                i -= 1
            if stack[i][0] != name:
                continue
            before = around
            cut(i)
            around, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            if before != around and name in INLINE:
                around, after = before, around
                end()
                around = after
            continue
        if name in RAW and not m[3].endswith("/"):
            at = RAW[name].search(html, at).end() if at <= last else len(html)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID or (m[3].endswith("/") and name not in INLINE):
            if name not in INLINE:
                end()
            continue
        own = around_level(name, m[3], main)
        if name not in INLINE:
            end()
            closed = next((x for x in ENDS if name in x), ())
            if bounds and (stack[bounds[-1]][0] == "p" or stack[bounds[-1]][0] in closed):
                cut(bounds[-1])
            around, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        elif own > around:
            end()
        # what the names of its container say is nothing of a page's article; those below an article may be comments or teasers
        now = max(own, 0 if name in MAIN and (around == 1 or (around == 2 and not has_main)) else around)
        stack.append((name, now, main or name in MAIN))
        open_[name] += 1
        if name not in INLINE and name not in HEADINGS:
            bounds.append(len(stack) - 1)
        around, main = now, stack[-1][2]
        if name in MAIN and around < 2:
            has_main = 1
        if name == "a":
            in_link += 1
        elif name in HEADINGS:
            heading = 1
    if at < len(html):
        rest, comment, _ = html[at:].partition("<!--")  # what opens a comment here is never closed
        parts.append(rest)
        if comment and in_link:
            linked += len(rest.split())
    end()
    near = [(0, 0.0), *((b[1], b[2]) for b in out), (0, 0.0)]
    return [(b[0], (b[1], b[2], *near[i], *near[i + 2], b[3], b[4], has_main, b[5])) for i, b in enumerate(out)]


#: The labelled pages: for each block in order, whether it belongs to the article.
LABELLED = [
    ("<title>x</title><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A short heading</h1><p>The first paragraph of this article has a fair number of words in it.</p><p>Short one.</p></article><footer>Made by someone.</footer>", "001110"),
    ("<header>The name of the site</header><main><h2>Heading</h2><p>Some words of text.</p><ul><li>A point</li><li>Another <a href=x>point</a></li></ul></main><aside>Seen elsewhere on this site with many more words than the article has.</aside>", "011110"),
    ("<div class=ad>Buy this now, it is cheap and good and you will like it.</div><article><p>One.</p><p>Two <a href=y>linked words here</a>.</p></article><div class='comments'><p>I liked reading this very much, thank you for it.</p></div>", "0110"),
    ("Only some plain words", "1"),
    ("<p>Hello</p>", "1"),
    ("<article><p><a href=z>The whole of this paragraph is one link</a></p><p>Words.</p></article><div>Read also</div><div>Outside of the article there is text of many words too, but it is not the article's.</div>", "1100"),
    ("<article><h1>Title</h1><form>Name and address please</form><p>Text.</p><div class='share-buttons'><a href=f>Share</a></div></article><div id=cookie-notice>We use cookies to make this site better for all of you who read it.</div>", "10100"),
    ("<form>Search the site for words</form><div>A longer paragraph that stands by itself outside of any marked article and holds only words.</div>", "01"),
    ("<article><p>A.</p></article><article class='comment'><p>A reader's comment that is rather long and full of words and opinions.</p></article>", "10"),
    ("<body class='no-sidebar has-header'><article><div class='entry-header'><h1>The title of a post</h1></div><p>Its text is here.</p><div class='overflow-hidden'>More of it.</div><p class='share-price'>Shares fell by two to nine.</p><div class='post-share'><a href=a>Mail</a> <a href=b>Print</a></div></article></body>", "11110"),
    ("<div class='page-with-sidebar'><main><p>Words in the middle.</p><p>And <a href=x>more of them</a> there.</p></main></div><div class='widget-area'>Something else to see</div>", "110"),
    ("<div class='page-with-sidebar'><div>A page without a marked article, all of whose text stands in a box that is named after the bar at its side.</div><div>The second of its paragraphs is as long as the first one, and it holds no link to another page either.</div><div class='right-sidebar'>Small box</div></div>", "110"),
    ("<div class='site-header'>The name of a site</div><div>Its only paragraph has a good number of words in it, and none of them is a link to some other page.</div>", "01"),
]

#: Paragraph lengths of the made-up part of the labelled table: two lists that meet every length after every other size.
LENGTHS = (1, 40, 2, 3, 120, 5, 8, 17, 1, 1, 18, 300, 12, 25, 4, 60, 900, 2, 14, 33, 7, 200, 10, 1)


def paragraph(n: int, linked: int = 0, name: str = "p") -> str:
    """A block of n words, the first `linked` of them a link."""
    return f"<{name}>" + "<a href=x>" * bool(linked) + "word " * linked + "</a>" * bool(linked) + "word " * (n - linked) + f"</{name}>"


#: Blocks of pages without a marked article: words, linked words, element.
KINDS = {"text": (45, 0, "p"), "long": (150, 20, "p"), "links": (3, 3, "li"), "mixed": (12, 9, "div"), "short": (4, 0, "p"), "line": (9, 1, "div"), "title": (5, 0, "h2")}


def is_article(before: str, own: str, after: str) -> bool:
    """The labels of such pages: long texts; lines and headings that stand with them and not with links."""
    if own in ("text", "long"):
        return True
    if own in ("links", "mixed"):
        return False
    if own == "title":
        return after not in ("links", "mixed")
    return not {before, after} & {"links", "mixed"} and bool({before, after} & {"text", "long"})


def labelled_pages() -> list[tuple[str, str]]:
    """LABELLED and pages of paragraphs of many lengths: with a marked article inside and outside of it, and without one, where neighbours tell."""
    inside = "".join(paragraph(n, (0, 0, 0, n, n // 2)[i % 5]) for i, n in enumerate(LENGTHS))
    outside = "".join(paragraph(n, (0, 0, n)[i % 3]) for i, n in enumerate(LENGTHS))
    pages = [(f"<article>{inside}</article>", "1" * len(LENGTHS)), (f"<main><h2>word</h2>{inside}<h2>word word</h2></main>", "1" * (len(LENGTHS) + 2))]
    pages += [(f"<div>{outside}</div><article><p>word</p></article>", "0" * len(LENGTHS) + "1"), (f"<article><p>word</p><aside>{outside}</aside></article>", "1" + "0" * len(LENGTHS))]
    pages += [(f"<nav>{outside}</nav><div>{paragraph(50)}{paragraph(3)}{paragraph(70)}</div><footer>{inside}</footer>", "0" * len(LENGTHS) + "111" + "0" * len(LENGTHS))]
    for before, own, after in product(KINDS, KINDS, KINDS):
        # the outer two stand beside a text each, so that their own labels follow from the same rule
        order = ["text", before, own, after, "text"]
        labels = [is_article(a, b, c) for a, b, c in zip(["none", *order], order, [*order[1:], "none"])]
        pages.append(("".join(paragraph(*KINDS[k]) for k in order), "".join("01"[x] for x in labels)))
    return LABELLED + pages


def labelled_rows() -> list[tuple]:
    """The labelled table: the features of each block and its label."""
    rows = []
    for html, labels in labelled_pages():
        found = blocks_of(html)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {[x[0] for x in found]}")
        rows += [(*map(float, f), float(y)) for (_, f), y in zip(found, labels)]
    return rows


def trained(spark: SparkSession, depth: int = 12) -> list[tuple]:
    """A decision tree fitted to the labelled table, as nodes (feature, threshold, left, right) or (label,)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame(labelled_rows(), ", ".join(f"{x} double" for x in (*FEATURES, "label"))).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(rows)
    lines = iter(model.toDebugString.splitlines()[1:])
    nodes: list[tuple] = []

    def node() -> int:
        line = next(lines).strip()
        nodes.append(())
        own = len(nodes) - 1
        if m := re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line):
            left = node()
            next(lines)  # Else
            nodes[own] = (int(m[1]), float(m[2]), left, node())
        else:
            nodes[own] = (float(line.split(":")[1]),)
        return own

    node()
    return nodes


def keeps(nodes: list[tuple], features: tuple) -> bool:
    """The tree's decision for one block."""
    n = nodes[0]
    while len(n) > 1:
        n = nodes[n[2] if features[n[0]] <= n[1] else n[3]]
    return n[0] > 0.5


def main_text(html: str | None, decide: Callable[[tuple], bool]) -> str:
    """The kept blocks of a whole page, joined by a space; null or empty: empty."""
    return " ".join(text for text, f in blocks_of(html) if decide(f)) if html else ""


def extract(pages: DataFrame, nodes: list[tuple] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html).

    Without a shuffle: each page is read by itself, whole.  Null and empty html give an empty
    text; null ids and urls pass through; repeated rows give repeated results; an empty table
    gives none; further columns of pages are not read; a page of any length is read whole.
    """
    spark = pages.sparkSession
    tree = nodes or trained(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def decide(features: tuple) -> bool:
            return keeps(tree, features)

        for b in batches:
            texts = [main_text(h, decide) for h in texts_of(b, "html")]
            yield {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), read, "page_id long, url string, text string, n_chars long")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
