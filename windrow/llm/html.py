"""Main-text extraction from HTML by tree scoring.

A page becomes a light tree. Elements that are never content (navigation, forms, scripts ...) or whose class, id or role
says so are cut. Every paragraph passes points for its length and its commas to its ancestors, the parent in full, the
ones above in falling shares; a container's points are discounted by its link density. The best container and those of its siblings
that score well are kept, and their text is emitted block by block.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from windrow.llm.common import batches, strings, table

# Names of HTML elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style noscript iframe template head title nav aside form footer button select option textarea input object embed canvas svg math audio video dialog menu xmp noembed noframes".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: An implied end tag is not looked for beyond these.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
WORDS_OF = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
#: Names of what is never part of an article: menus, headers, footers, sidebars, notices, adverts, forms, reader comments.
APART = "ads?|advert\\w*|sponsor\\w*|promo\\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|paywall|share|sharing|social|sidebar|menu|nav\\w*|breadcrumbs?|pagination|pager|masthead|header|footer|copyright|comments?|disqus|replies|discussion|widget|toolbar|login"
UNLIKELY = re.compile(WORDS_OF.format(APART), re.I)
#: Those of them that say so inside an article too, wherever they stand in a name.
SURE = re.compile(WORDS_OF.format("ads?|advert\\w*|sponsor\\w*|promo\\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|paywall|sidebar|comments?|disqus|replies|login"), re.I)
#: Inside an article others must be the whole name, and the block must look like it as well.
DOUBTFUL = re.compile(rf"(?:{APART})", re.I)
CONTROLS = frozenset("form input button select textarea".split())
#: Share of links, share of text in list items, and characters of such an item, from which a doubtful block is no part of the article.
LINKED, LISTED, ITEM = 0.4, 0.8, 40
#: Names that tell a container around an article from one inside it only by where it stands.
AROUND = re.compile(WORDS_OF.format("side|rail|foot|related|recommend\\w*|reply|search|skip|hidden|tags?"), re.I)
#: Names of paragraphs and phrases that are adverts or notices, where the class says so.
SMALL = re.compile(WORDS_OF.format("ads?|advert\\w*|sponsor\\w*|promo\\w*|cookies?|consent|gdpr|notices?|newsletter|subscribe|paywall|share|sharing|social|breadcrumbs?|copyright|comments?"), re.I)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTAINERS = frozenset("div section ul ol dl table tbody details center fieldset figure address header hgroup body".split())
PHRASES = (BLOCKS | {"span", "a"}) - CONTAINERS
CONTENT = re.compile(WORDS_OF.format("article|content|main|post|story|entry|body|text"), re.I)
FOREIGN = re.compile(r"comment|advert|related|sidebar", re.I)
NOT_ARTICLE = re.compile(WORDS_OF.format("comments?|ads?|advert\\w*|related|promo\\w*"), re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
PLAIN = re.compile(r"[^>\"']++")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
COMMAS = re.compile(r"[,،、，;]")


class Node:
    """An element. kind: -1 never content, 1 named as content, 0 neither. within: whether it stands in an article.

    doubtful: in an article, but named as what is not part of one; measure() decides. items and listed: list items below and
    their characters; controls: form controls below. size, lead, trail, told, links and commas describe the visible text below: its characters, its white space at either
    end, its characters without the ends of its pieces, those of them in links, and its commas (see measure).
    """

    __slots__ = ("tag", "parent", "children", "depth", "within", "kind", "points", "size", "lead", "trail", "told", "links", "commas", "own", "doubtful", "items", "listed", "controls")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.points = tag, parent, [], 0.0
        self.depth = parent.depth + 1 if parent else 0
        self.within = parent is not None and (parent.within or parent.tag == "article" or (parent.kind > 0 and parent.tag in ("div", "section")))
        self.kind, self.doubtful = judged(tag, attributes, self.within)
        self.items = self.listed = self.controls = 0

    @property
    def length(self) -> int:
        return max(0, self.size - self.lead - self.trail)


def judged(tag: str, attributes: str, within: bool = False) -> tuple[int, bool]:
    """An element's kind by its tag, role and names, and whether it is doubtful."""
    if tag in NEVER:
        return -1, False
    if not attributes or tag in ("html", "body"):
        return int(tag in ("article", "main")), False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "") == "true" or INVISIBLE.search(found.get("style", "")):
        return -1, False
    if found.get("role", "").lower() in UNLIKELY_ROLES:
        return -1, False
    style = unescape(found.get("class", ""))
    names = f"{style} {unescape(found.get('id', ''))}"
    if tag in ("article", "main") or found.get("role", "").lower() in ("main", "article"):
        return -1 if NOT_ARTICLE.search(names) else 1, False
    named = int(bool(CONTENT.search(names)))
    if tag in CONTAINERS:
        apart = SURE.search(names) if within else UNLIKELY.search(names) or AROUND.search(names)
        if apart and not (tag in ("section", "div") and named and not FOREIGN.search(names)):
            return -1, False
    elif tag in PHRASES and (SURE if within else SMALL).search(style):
        return -1, False
    doubtful = within and (tag in CONTAINERS or tag in PHRASES) and any(DOUBTFUL.fullmatch(x) for x in names.split())
    return named, doubtful


def looks_apart(node: Node) -> bool:
    """Whether a doubtful block is made of links, of short list items, or around form controls."""
    if node.controls or (node.length and node.links >= LINKED * node.length):
        return True
    return node.items > 0 and node.listed >= LISTED * node.told and node.listed <= ITEM * node.items


class Tags:
    """The tags of a page from left to right, in time linear in its length whatever it leaves open."""

    def __init__(self, html: str):
        self.html = html
        self.last = {mark: html.rfind(mark) for mark in (">", '"', "'", "]]>")}
        self.dead: set[int] = set()  # quotes from which no end of the tag follows
        self.run = 0, 0  # a run without quotes or ends of tags, and what follows it

    def close(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` ends; without regard to quotes if they leave it open; or -1."""
        html, pos, passed = self.html, at, []
        while self.last[">"] >= pos:
            if not self.run[0] <= pos <= self.run[1]:
                m = PLAIN.match(html, pos)
                self.run = pos, m.end() if m else pos
            pos = self.run[1]
            if html[pos : pos + 1] == ">":
                return pos
            passed.append(pos)
            if pos in self.dead or pos >= len(html) or self.last[html[pos]] <= pos:
                break
            pos = html.index(html[pos], pos + 1) + 1
        self.dead.update(passed)
        return html.find(">", at) if self.last[">"] >= at else -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, attributes) of the first markup from `at` on; kind: open, close, text or none."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "none", "", ""
            if html.startswith("<![CDATA[", start) and self.last["]]>"] >= start + 9:
                end = html.index("]]>", start + 9)
                return start, end + 3, "text", html[start + 9 : end].replace("&", "&amp;"), ""
            closing = html.startswith("/", start + 1)
            name = NAME.match(html, start + 1 + closing)
            if name and (end := self.close(name.end())) >= 0:
                return start, end + 1, "close" if closing else "open", name[0].lower(), html[name.end() : end]
            if html[start + 1 : start + 2] in ("!", "?", "/") and self.last[">"] > start + 1:
                return start, html.index(">", start + 2) + 1, "none", "", ""
            at = start + 1
        return None


def parse(html: str) -> Node:
    """The page's tree. Missing end tags are implied as browsers imply them for paragraphs, lists and tables.

    For every tag the open elements stand on a stack of their own, so no search passes over the depth of the tree.
    """
    root = Node("html", None)
    tags, at, node, end = Tags(html), 0, root, len(html)
    open_: dict[str, list[Node]] = {"html": [root]}

    def up_to(target: Node) -> Node:
        """Close all that is open below target, and target."""
        x = node
        while True:
            open_[x.tag].pop()
            if x is target:
                return x.parent
            x = x.parent

    while at < end:
        m = tags.next(at)
        if m is None:
            node.children.append(html[at:])
            break
        start, after, kind, tag, attributes = m
        if start > at:
            node.children.append(html[at:start])
        at = after
        if kind == "text":
            node.children.append(tag)
        elif kind == "close":
            if open_.get(tag) and open_[tag][-1].parent is not None:
                node = up_to(open_[tag][-1])
        elif kind == "open":
            if tag == "br":
                node.children.append(" ")
                continue
            if tag == "html" or (tag == "body" and open_.get("body")):
                continue
            if tag in BLOCKS and open_.get("p"):
                node = up_to(open_["p"][0])
            if tag in CLOSES_OWN:
                wall = max((open_[w][-1].depth for w in WALLS[tag] if open_.get(w)), default=-1)
                below = [x[i] for t in CLOSES_OWN[tag] if (x := open_.get(t)) and (i := bisect_right(x, wall, key=lambda n: n.depth)) < len(x)]
                if below:
                    node = up_to(min(below, key=lambda n: n.depth))
            child = Node(tag, node, attributes)
            node.children.append(child)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = close.end() if close else end
            elif tag not in VOID and not attributes.endswith("/"):
                open_.setdefault(tag, []).append(child)
                node = child
    return root


def walk(root: Node) -> Iterator[Node]:
    """All elements that may be content, in page order."""
    stack = [root]
    while stack:
        x = stack.pop()
        if x.kind >= 0:
            yield x
            stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


def measure(root: Node) -> list[Node]:
    """The elements that may be content, in page order, each with the figures of the visible text below it.

    Every element hands its figures up once, children before parents, so the tree's depth costs nothing.
    """
    found, apart = list(walk(root)), False
    for node in reversed(found):
        size = lead = trail = told = links = commas = own = 0
        for c in node.children:
            if isinstance(c, str):
                n, bare = len(c), len(c.strip())
                before = n - len(c.lstrip()) if bare else n
                more = (n, before, n - before - bare, bare, 0, len(COMMAS.findall(c)))
                own = own or bare
            elif c.kind >= 0:
                node.items += c.items + (c.tag == "li")
                node.listed += c.told if c.tag == "li" else c.listed
                node.controls += c.controls
                more = (c.size, c.lead, c.trail, c.told, c.links, c.commas)
            else:
                node.controls += c.tag in CONTROLS
                continue
            n, before, behind, bare, linked, points = more
            if lead == size:  # white space only so far
                lead, trail = lead + before, behind
            else:
                trail = trail + n if before == n else behind
            size, told, links, commas = size + n, told + bare, links + linked, commas + points
        node.size, node.lead, node.trail, node.told, node.commas, node.own = size, lead, trail, told, commas, own
        node.links = told if node.tag == "a" else links
        if node.doubtful and looks_apart(node):
            node.kind, apart = -1, True
    return found if not apart else list(walk(root))


def score_tree(found: list[Node]) -> list[Node]:
    """Paragraphs pass their points up; the scored containers in page order."""
    scored: dict[int, Node] = {}
    for node in found:
        leaf = node.tag in PARAGRAPHS or (node.tag in ("div", "section", "article", "main") and node.own)
        length = node.length
        if not leaf or not length:
            continue
        points = (1 + node.commas + min(length / 100, 3)) * (1 - min(1.0, node.links / length))
        up = node.parent if node.tag in PARAGRAPHS else node
        for level, share in enumerate((1.0, 0.5, 1 / 6, 1 / 9)):
            if up is None:
                break
            if id(up) not in scored:
                scored[id(up)] = up
                up.points = 25.0 * (up.kind > 0) if level == 0 or up.kind > 0 else 0.0
            up.points += points * share
            up = up.parent
    return list(scored.values())


def density(node: Node) -> float:
    return node.links / max(1, node.length)


def main_nodes(root: Node) -> list[Node]:
    """The best container, the article around it if it has one, and well-scored siblings, in page order."""
    found = measure(root)
    best = max(score_tree(found), key=lambda x: x.points * (1 - density(x)), default=None)
    if best is None:
        named = [x for x in found if x.kind > 0 and x.length]
        return named[:1]
    up = best
    while up.parent is not None:
        up = up.parent
        if up.tag in ("article", "main"):
            best = up
            break
    if best.parent is None:
        return [best]
    least, kept = max(10.0, 0.2 * best.points), []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif not isinstance(c, str) and c.kind >= 0 and best.tag != "main":
            if c.points * (1 - density(c)) >= least or (c.tag == "p" and c.length > 80 and density(c) < 0.25):
                kept.append(c)
    return kept


def blocks(node: Node) -> Iterator[str]:
    """A node's text blocks in page order: references decoded, white space collapsed, empty ones left out."""
    pending: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:  # the end or beginning of a block
            block = " ".join(unescape("".join(pending)).split())
            pending = []
            if block:
                yield block
        elif isinstance(x, str):
            pending.append(x)
        elif x is node or (x.kind >= 0 and (x.tag != "header" or x.within)):
            around = [None] if x.tag in BLOCKS else []
            stack.extend(around + list(reversed(x.children)) + around)
    block = " ".join(unescape("".join(pending)).split())
    if block:
        yield block


def extract(html: str) -> str:
    return "\n".join(b for node in main_nodes(parse(html)) for b in blocks(node)) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null or empty html gives an empty text. Repeated rows give repeated rows; other columns are not read; an empty table
    gives no rows. Pages are read whole, where they are: nothing is shuffled; the time a page takes is linear in its
    length.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text="html"):
            texts = [extract(h) for h in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
