"""Main text of web pages from flat blocks.

``blocks`` cuts a page into flat text blocks in page order. A block has its text, its word count, its link density, the same of its
neighbours and two marks of its place: inside article or main content, and the room that furniture leaves it. Furniture is by tag, role or words
of class and id (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Its room is the smallest share of the page's unlinked
words that an enclosing element of that kind holds, 1 outside of them: a form or a box that only its name marks may wrap a whole page, and then
holds most of its words; it counts as 0 where the page has its content elsewhere. A decision tree, trained by Spark on the small labelled table of
``SAMPLES``, says which blocks are main text. The tree has at most 2^5 leaves and travels as a list of splits.

A page is handled on its own in one Arrow pass: no shuffle, memory bounded by the longest page.

Defined results: null or empty html has an empty text; unclosed and stray tags are accepted; text outside any block counts as a block; scripts,
styles, templates, comments and the head are never text; repeated rows give repeated results; other columns are kept except those named like an output column. An
empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, table

checks = Checks()

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+)*+)>|[^<]+|<", re.S)
MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|data-main)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# tags whose content is no text
SILENT = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "title"}
# of these, the ones whose content is not even markup: it ends at their own end tag and nowhere else
RAW = {"script", "style", "noscript", "iframe", "textarea", "title"}
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "head"}
CONTENT = {"article", "main"}
LEFT_OPEN = {"nav", "header", "form", "menu", "button", "fieldset"}
FURNITURE_WORDS = set("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr
header masthead menu nav navbar navigation newsletter notice notices notification pager pagination popup modal promo promotion related respond share sharing sidebar social
sponsor sponsored subscribe subscription toolbar widget alert copyright legal topbar login signup search form tags""".split())
CONTENT_WORDS = set("article content entry main post story body text".split())
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
# tags that can wrap a whole page, and name parts that tell of a layout and not of the element
WRAPPERS = {"form", "fieldset"}
LAYOUT_PREFIX = re.compile(r"(?:has|with|no|without|hide)[-_]", re.I)
COMMENT = re.compile(r"(?:user|reader|blog|post)?[-_]?comment(?:s|list|item|thread)?(?:[-_].*)?$", re.I)
FEATURES = ["words", "links", "prev_words", "prev_links", "next_words", "next_links", "content", "room"]
DEPTH = 5


class Block:
    __slots__ = ("parts", "words", "linked", "content", "inside", "room", "marked")

    def __init__(self, content: int, inside: tuple[int, ...], marked: bool) -> None:
        self.parts, self.words, self.linked = [], 0, 0
        self.content, self.inside, self.marked, self.room = content, inside, marked, 1.0


def _place(tag: str, attrs: str) -> tuple[int, bool]:
    """(1 content, 0 neither, -1 furniture that may be a wrapper, -2 furniture or hidden; labelled as main text in a sample)."""
    kind, marked = (-1 if tag in WRAPPERS else -2 if tag in FURNITURE else 1 if tag in CONTENT else 0), False
    if attrs and tag not in ("body", "html"):
        for name, value in MARKS.findall(attrs):
            name, raw = name.lower(), value.strip("\"'")
            value = raw.lower()
            if name == "data-main":
                marked = True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in FURNITURE_ROLES):
                kind = -2
            elif name == "role" and value in ("main", "article"):
                kind = kind or 1
            elif name in ("class", "id"):
                names = [x for x in raw.split() if not LAYOUT_PREFIX.match(x)]
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(names)).lower()))
                if tag != "main" and any(map(COMMENT.match, names)):
                    kind = -2
                elif words & FURNITURE_WORDS and kind < 1:
                    kind = min(kind, -1)
                elif words & CONTENT_WORDS and not kind:
                    kind = 1
    return kind, marked


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks in page order; a block without a word is none."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # open non-inline tags with their place
    boxes: list[list] = []  # every furniture element: may wrap, content around it, words, holds content
    inside: list[int] = []  # those open now
    now, silent, link, content, marked = Block(0, (), False), "", 0, 0, 0

    def fresh() -> Block:
        return Block(content, tuple(inside), marked > 0)

    def close() -> None:
        nonlocal now
        text = " ".join("".join(now.parts).split())
        if text:
            now.parts = [text]
            now.words = text.count(" ") + 1
            out.append(now)
        now = fresh()

    def leave(depth: int) -> None:
        """Ends the open tags from ``depth`` on."""
        nonlocal content, marked
        for _, kind, main in stack[depth:]:
            content, marked = content - (kind > 0), marked - main
            if kind < 0:
                inside.pop()
        del stack[depth:]

    page, at = page or "", 0
    while m := TOKEN.match(page, at):
        tag, at = m[2], m.end()
        if tag and not m[1] and tag.lower() in RAW and not m[3].endswith("/"):
            if not silent:
                close()
            end = RAW_END[tag.lower()].search(page, at)
            at = end.end() if end else len(page)
            continue
        if silent:
            if tag and m[1] and tag.lower() == silent:
                silent = ""
            continue
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:  # comment or declaration
                continue
            if "&" in piece:
                piece = entities.unescape(piece)
            now.parts.append(piece)
            if link:
                now.linked += len(piece.split())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = max(link - 1, 0)
            if tag in INLINE:
                continue
            close()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                leave(depth)
                link = 0
                now = fresh()
            continue
        if tag == "a":
            link = 1
        elif tag == "br":  # white space inside its block
            now.parts.append(" ")
        if tag in INLINE:
            continue
        close()
        if tag in SILENT and not m[3].endswith("/"):
            silent = tag
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of their kind
            if stack and stack[-1][0] == tag:
                leave(len(stack) - 1)
        elif tag in CONTENT:  # an article ends a menu, header or form that was left open before it
            leave(next((i for i, (name, _, _) in enumerate(stack) if name in LEFT_OPEN), len(stack)))
        kind, main = _place(tag, m[3])
        stack.append((tag, kind, main))
        if kind < 0:
            inside.append(len(boxes))
            boxes.append([kind == -1, content, 0, False])
        content, marked = content + (kind > 0), marked + main
        link = 0
        now = fresh()
    close()
    return rooms(out, boxes)


def rooms(found: list[Block], boxes: list[list]) -> list[Block]:
    """Sets the room of every block."""
    total = sum(b.words - min(b.linked, b.words) for b in found)
    content = sum(b.content > 0 for b in found)
    held = [0] * len(boxes)  # blocks of content in a box, its own surroundings counted
    for b in found:
        for k in b.inside:
            boxes[k][2] += b.words - min(b.linked, b.words)
            boxes[k][3] |= b.content > boxes[k][1]
            held[k] += b.content > 0
    share = [words / max(total, 1) if wraps and (has or held[k] == content) else 0.0 for k, (wraps, _, words, has) in enumerate(boxes)]
    for b in found:
        b.room = min((share[k] for k in b.inside), default=1.0)
    return found


def features(found: list[Block]) -> list[list[float]]:
    """One row of FEATURES per block; a missing neighbour has no word and no link."""
    own = [(float(b.words), min(b.linked / b.words, 1.0)) for b in found]
    pad = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [[*pad[i + 1], *pad[i], *pad[i + 2], float(b.content > 0), b.room] for i, b in enumerate(found)]


# the small labelled table: pages whose main blocks carry data-main
SAMPLES = (
    """<body><nav><ul><li><a href=a>Home</a></li><li><a href=b>World news</a></li></ul></nav><div class=ad>Buy one get one free at the shop today</div><article><h1 data-main>Short title</h1>
    <p data-main>A first paragraph of some twenty words that tells what happened in the town on that day and why it did so.</p><p data-main>Yes.</p><p data-main>No one knew.</p>
    <p data-main>Then <a href=x>somebody</a> wrote a long letter about it, and the others answered in kind over several weeks.</p></article><footer>&copy; the site, all rights reserved by somebody</footer></body>""",
    """<body><header><h1>The Daily Site</h1><p>All the news that fits in a page of this width and of this height, every day.</p></header><main><h2 data-main>Title</h2><p data-main>One.</p><p data-main>Two words.</p>
    <ul><li data-main>First item of a list</li><li data-main><a href=q>linked item</a></li></ul><section class=comments><h3>Comments</h3><p>I read this with great joy and would like to add a thing or two of my own to it.</p><p>Nice!</p></section></main>
    <aside><h3>Related</h3><a href=1>One more story of today</a><p>Our writers tell you what they liked most in this long and eventful year.</p></aside></body>""",
    """<body><div class=topbar><a href=1>Log in</a> <a href=2>Register</a></div><div><p data-main>Pages of plain boxes have no marks at all, and yet their long paragraphs of many words without any link are what the reader came for.</p>
    <p data-main>A second paragraph follows the first one with about as many words as that had, also without a link in it.</p><p><a href=1>next page</a> <a href=2>last page</a></p></div><div id=footer>Imprint and contact of the people who run this</div></body>""",
    """<body><div class="cookie notice">This site uses cookies to give you the best experience, please accept them all now.</div><form><p>Enter your mail address here to get our letter each week without any charge</p></form><div class=post>
    <h2 data-main>On rivers</h2><p data-main>Rivers run.</p><blockquote data-main>They do not stop for anyone who asks them to.</blockquote><p data-main>So it is said by those who live near one and see it each day of their lives.</p></div>
    <div id=sidebar><p>Popular posts of the month, chosen by the readers of this page in a vote</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div></body>""",
    """<body><ul><li><a href=1>Start</a></li><li><a href=2>About us</a></li><li><a href=3>Contact</a></li></ul><p>Menu</p><p data-main>When nothing is marked the words must do, so this paragraph has quite a lot of them, one after the other, up to its end.</p>
    <p data-main>And this one as well, since most texts have more than one paragraph that is worth the reading, or so we hope.</p><p><a href=1>Terms</a></p><p>2024</p></body>""",
    """<body><article><header><p>By somebody, on a day in March, in the section of things</p></header><h1 data-main>A</h1><p data-main>B c d.</p><p data-main><a href=1>A paragraph that is one link</a></p><footer>Filed under things and other things</footer>
    <aside>Read also what we wrote about the same thing a year ago in this place</aside><p data-main>End of it.</p></article></body>""",
    """<body><div><p><a href=1>How to mend a broken chair in a day</a></p><p><a href=2>Ten ways of cooking rice that you never tried</a></p><p><a href=3>What the mayor said about the new bridge</a></p></div>
    <div><p data-main>Nothing here is marked, the links above are many words long, and still a reader sees at once that this is where the text of the page begins.</p><p data-main>It does.</p>
    <p data-main>After a short remark it goes on for as long as it needs, with <a href=1>a link</a> now and then, which does no harm to a paragraph of this length.</p><p data-main>Quite so.</p>
    <p data-main>The last of the long paragraphs closes the page, and what follows is a list of links again, as it so often is on pages.</p></div>
    <p><a href=4>Share this with all the friends you have</a></p><p><a href=5>Print</a></p><p><a href=6>Send us a letter about this page</a></p></body>""",
    """<body><div class="wrap has-sidebar"><nav><a href=1>Start</a> <a href=2>Sports</a></nav><div class="banner page"><h1 data-main>On bells</h1><p data-main>The bells of the town were cast in the same year in which the bridge was built, as an old book says.</p>
    <p data-main>They ring.</p><p data-main>Nobody has counted how often they did so in all the years since then, though some have tried to.</p><div class=sidebar><p>Read more of our long reports on towns and on their bells</p></div></div></div></body>""",
    """<body><form id=aspnetForm action=x><div id=header><p>The site of the town, for all who live in it and near it</p></div><div id=center><h2 data-main>Water</h2><p data-main>The water of the town comes from the hills to the west of it, by a pipe that is ten miles long.</p>
    <p data-main>It is cold.</p><p data-main>In a dry year the mayor asks all who live here to use less of it, and most of them do so without a word.</p></div><fieldset><p>Search the site</p></fieldset><div id=footer><p>Write to the town hall if you have a question</p></div></form></body>""",
    """<body><div class="sidebar-layout legal"><p data-main>These are the terms under which the library lends its books to those who hold a card of the town, from this year on.</p><p data-main>A book may be kept for four weeks, and for two more if no one else has asked for it in that time.</p>
    <p data-main>Maps stay here.</p></div><div class=promo><p>Our new book on maps is out now, buy it</p></div></body>""",
    """<body><article><h1 data-main>Apples</h1><p data-main>Apples keep for long.</p></article><ol class=commentlist><li><article class=comment><p>I have kept mine for more than a year in the cellar and they were as good as on the first day of all.</p></article></li>
    <li><article class=comment><p>Mine were gone after a month, but then the cellar of my house is not a cold one at all, sad to say.</p></article></li></ol></body>""",
    "<body><article><p data-main>One.</p></article></body>", "<body><nav><a href=1>Start</a></nav><article><p data-main>A</p></article></body>", "<body><main><p data-main><a href=1>Link</a></p><p data-main>Text of it.</p></main></body>",
    """<body><div class=post><p data-main>Short news.</p></div><div class=footer><p>All that stands on these pages may be read by all, but it may not be printed again without asking the people who wrote it first.</p></div></body>""",
    """<body><table><tr><td><a href=1>All the articles of this month in one list</a></td><td><a href=2>Archive</a></td></tr></table><div><div data-main>Text can stand in boxes without a paragraph tag, and then it is as good a text as any other would be in its place.</div>
    <div data-main>The next box goes on with it for a sentence or two, without any link, and ends there as texts do.</div></div><div><a href=1>Back to the top of this very page</a></div><div>v2</div></body>""",
)


def labelled(spark: SparkSession, samples: tuple[str, ...] = SAMPLES) -> DataFrame:
    rows = [(*f, float(b.marked)) for page in samples for found in [blocks(page)] for b, f in zip(found, features(found), strict=True)]
    return spark.createDataFrame(rows, [*FEATURES, "label"])


def train(spark: SparkSession, samples: tuple[str, ...] = SAMPLES) -> list[tuple]:
    """The tree as a list of (feature, threshold, left, right) and (main,) leaves."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled(spark, samples)).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=DEPTH, minInstancesPerNode=1, seed=7).fit(data)
    tree: list[tuple] = []

    def add(node) -> int:
        at = len(tree)
        tree.append(())
        if node.subtreeDepth() == 0:
            tree[at] = (node.prediction() > 0.5,)
        else:
            split = node.split()
            tree[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()))
        return at

    add(model._call_java("rootNode"))
    return tree


def is_main(tree: list[tuple], row: list[float]) -> bool:
    at = tree[0]
    while len(at) > 1:
        at = tree[at[2] if row[at[0]] <= at[1] else at[3]]
    return at[0]


def main_text(page: str | None, tree: list[tuple]) -> str:
    found = blocks(page)
    return "\n\n".join(b.parts[0] for b, row in zip(found, features(found), strict=True) if is_main(tree, row))


def extract(pages: DataFrame, tree: list[tuple], html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text``."""
    kept = [c for c in pages.columns if c not in (html, "text")]
    schema = pages.select(*kept).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 64):
            text = [main_text(x.as_py(), tree) for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(text, pa.string())], names=[*kept, "text"])

    return pages.select(html, *kept).mapInArrow(run, schema)


@checks.add("op1_html_text")
def op1_html_text(spark: SparkSession, d: str) -> DataFrame:
    found = extract(table(spark, d, "pages").select("page_id", "url", "html"), train(spark))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
