"""HTML main text by consensus host paths.

Every page is read into a tree of containers. A container's path is the chain of its ancestors' tags with their
generalised ids and classes (digits become ``#``, classes sorted). Subtrees that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments are dropped, by tag, by role, or by an id or class whose
parts are all words for such things or for their place. A container scores by the text of its subtree: paragraphs,
headings and list items count in full, bare text by half, text in links less, and lists of links nothing.

A page's main container is its article (or what its articles have in common), if that holds half of the score;
otherwise, from the root or the ``main`` element down, the smallest container that still holds nearly all of the score
and the top heading. Each page votes for the path of its main container; the votes of a host are added up in Spark,
and the host's winning path says what is extracted from all of its pages. A page of which that path holds less than
half of what its own main container holds falls back on its own.

Extraction takes every outermost container on the path. Character references are decoded, white space inside a block
becomes one blank, blocks are joined in page order by one blank.

Hosts' winners are at most one row a host. They are broadcast if there are no more than ``BROADCAST_HOSTS``, else
joined by shuffling; hosts with a large share of the pages are dealt over many tasks.

Defined cases: null or empty html gives the empty text; a null url is the host ''; unclosed and mis-nested tags end
with their parents; quotes inside tags count only where a value begins, so stray ones stay harmless; of tied votes the
higher score wins, then the larger path; repeated rows each get a row; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import join_hot, materialise

BROADCAST_HOSTS = 100_000
#: Share of the score that a container must hold for what lies beside it to be left out.
NEARLY_ALL = 0.9

#: Attributes: a name, which may hold quotes, and a value, whose quotes count only at its start.
_PAIR = r"""[\s/]*+[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
#: A comment, declaration, raw-text element with its content, or tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)(?![^\s/>])(?:{_PAIR}|[\s/=])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:{_PAIR}|[\s/=])*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("html body div article section main nav header footer aside form table tbody thead tfoot tr td th ul ol dl center blockquote figure details fieldset menu dialog button head".split())
_DROPPED = frozenset("nav header footer aside form menu dialog button head".split())
#: Containers that may be a page's main one, and those that are only passed through on the way to it.
_MAIN = frozenset("html body div article section main td center".split()) | {"#"}
_PASSED = frozenset("table tbody tr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())
_BLOCKS = _PROSE | {"li", "dt", "dd", "td", "th"}
_HEADINGS = frozenset(("h1", "h2", "h3"))
#: Open cells and rows that end where another begins.
_ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}}
#: Words for boilerplate, for a thing's place or form, and for what holds a text.
_NAMES = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promos?|promotions?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|cookies?|consent|gdpr|notice|alert|popup|modal"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|widgets?|toolbar|pagination|pager|contentinfo"
    r"|complementary|search|legal|disclaimer|copyright|imprint|skiplinks?"
)
_PLACES = re.compile(
    r"main|site|page|top|bottom|left|right|side|global|primary|secondary|tertiary|list|area|section|box|bars?|block|wrap|wrapper|container|links?|inner|outer|items?|thread|form|buttons?|icons?|slot|unit|space"
    r"|posts|articles|stories|media|mobile|desktop|sticky|fixed|floating|overlay|text|row|col|column|header|panel|group|g?\d+|[a-z]"
)
_HOLDERS = frozenset("article entry post story content main body text hentry prose articlebody entry-content post-content article-body article-content post-body story-body main-content".split())
_SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "path", "parent", "dropped", "kept", "first", "last", "score", "heading", "children")

    def __init__(self, tag: str, path: str, parent: Node | None, dropped: bool, first: int) -> None:
        self.tag, self.path, self.parent, self.dropped, self.first = tag, path, parent, dropped, first
        self.last, self.score, self.heading, self.kept = -1, 0.0, False, True
        self.children: list[Node] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in text:
        for m in _ATTRIBUTE.finditer(text):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    plain = lambda name: re.sub(r"\d+", "#", attributes.get(name, "").lower()).split()
    return "".join([tag, *(f"#{x}" for x in plain("id")[:1]), *(f".{x}" for x in sorted(set(plain("class"))))])


def boilerplate(attributes: dict[str, str]) -> bool:
    """Whether role, id or a class names boilerplate: all parts of the name do, or say where it is."""
    if _NAMES.fullmatch(attributes.get("role", "").lower()):
        return True
    classes = attributes.get("class", "").split()
    if any(c.lower() in _HOLDERS for c in classes):
        return False
    for name in [*classes, attributes.get("id", "")]:
        parts = [x.lower() for x in _SPLIT.split(name) if x]
        if any(_NAMES.fullmatch(x) for x in parts) and all(_NAMES.fullmatch(x) or _PLACES.fullmatch(x) for x in parts):
            return True
    return False


class Page:
    """A page's containers, and its runs of text in order as (container, text); a block's edge is a run without text."""

    def __init__(self, source: str) -> None:
        self.root = Node("#", "", None, False, 0)
        self.nodes = [self.root]
        self.runs: list[tuple[Node, str]] = []
        self.weights: list[float] = []
        self._read(source)
        for node in self.nodes:
            if node.last < 0:
                node.last = len(self.runs)
            inside = node.parent
            while node.tag == "header" and node.heading and inside is not None:  # the head of an article is part of it
                node.dropped, inside = node.dropped and inside.tag != "article", inside.parent
            node.kept = not node.dropped and (node.parent is None or node.parent.kept)
        for (node, _), weight in zip(self.runs, self.weights, strict=True):
            if weight and node.kept:
                node.score += weight
        for node in reversed(self.nodes[1:]):
            if node.kept:
                node.parent.score += node.score
                node.parent.heading |= node.heading

    def _read(self, source: str) -> None:
        stack, at, links, block = [self.root], 0, 0, ""

        def text(piece: str) -> None:
            n = len(piece) if not piece.isspace() else 0
            weight = n * ((0.6 if block in _PROSE else 0.0) if links else 1.0 if block else 0.5)
            self.runs.append((stack[-1], piece))
            self.weights.append(weight)
            if n and block in _HEADINGS:
                for node in reversed(stack):
                    if node.heading:
                        break
                    node.heading = block == "h1" or node.tag == "header"

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            if m["raw"] or not m["tag"]:
                continue
            tag, closing = m["tag"].lower(), bool(m["close"])
            if tag == "a":
                links = 0 if closing else 1
            if tag in _INLINE:
                continue
            self.runs.append((stack[-1], ""))
            self.weights.append(0.0)
            if tag in _BLOCKS:
                block = "" if closing else tag
            if tag not in _CONTAINERS:
                continue
            links = 0
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        for node in stack[depth:]:
                            node.last = len(self.runs)
                        del stack[depth:]
                        break
            else:
                while stack[-1].tag in _ENDS.get(tag, ()):
                    stack.pop().last = len(self.runs)
                attributes = _attributes(m["attributes"])
                dropped = tag in _DROPPED or tag not in ("body", "html") and boilerplate(attributes)
                node = Node(tag, f"{stack[-1].path}/{_step(tag, attributes)}", stack[-1], dropped, len(self.runs))
                stack[-1].children.append(node)
                stack.append(node)
                self.nodes.append(node)
        if at < len(source):
            text(source[at:])

    def main(self) -> Node | None:
        """The page's main container; None if nothing scores."""
        node, half = self.root, self.root.score / 2
        if not half:
            return None
        articles = [x for x in self.nodes if x.kept and x.tag == "article" and x.score > 0 and not self._within(x, "article")]
        if sum(x.score for x in articles) >= half:
            return self._common(articles)
        node = next((x for x in self.nodes if x.kept and x.score >= half and x.tag == "main"), node)
        best = node
        while node.children:
            child = max(node.children, key=lambda x: x.score if x.kept else -1.0)
            if not child.kept or child.score < NEARLY_ALL * best.score or best.heading and not child.heading or child.tag not in _MAIN | _PASSED:
                break
            node = child
            best = node if node.tag in _MAIN else best
        return best

    @staticmethod
    def _within(node: Node, tag: str) -> bool:
        while node.parent is not None:
            node = node.parent
            if node.tag == tag:
                return True
        return False

    @staticmethod
    def _common(nodes: list[Node]) -> Node:
        """The smallest container of all nodes."""
        chains = []
        for node in nodes:
            chain = []
            while node is not None:
                chain.append(node)
                node = node.parent
            chains.append(chain[::-1])
        return [level[0] for level in zip(*chains, strict=False) if all(x is level[0] for x in level)][-1]

    def on(self, path: str) -> list[Node]:
        """The outermost kept containers on a path that hold more than links."""
        found: list[Node] = []
        for node in self.nodes:
            if node.path == path and node.kept and node.score > 0 and not (found and found[-1].first <= node.first < found[-1].last):
                found.append(node)
        return found

    def text(self, nodes: list[Node]) -> str:
        words = [text or " " for top in nodes for node, text in [(None, ""), *self.runs[top.first : top.last]] if node is None or node.kept]
        return " ".join(entities.unescape("".join(words)).split())


def best_path(source: str) -> tuple[str, float]:
    """The path of the page's main container and its score; '' if nothing scores."""
    main = Page(source).main() if source else None
    return (main.path or "/", main.score) if main is not None else ("", 0.0)


def extract(source: str, path: str | None) -> str:
    """The page's text by its host's path, or by its own main container where that path holds too little."""
    page = Page(source)
    main = page.main()
    if main is None:
        return ""
    found = ([page.root] if path == "/" else page.on(path)) if path else []
    return page.text(found if found and sum(x.score for x in found) >= main.score / 2 else [main])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/]*//(?:[^/@]*@)?([^/:?#]*)", 1))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [best_path(x or "") for x in batch.column("html").to_pylist()]
        yield pa.record_batch({"host": batch.column("host"), "path": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, paths = batch.column("html").to_pylist(), batch.column("path").to_pylist()
        out = [extract(source, path) if source else "" for source, path in zip(sources, paths, strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def winners(pages: DataFrame) -> DataFrame:
    """host, path, votes: the path most pages of the host vote for; of equals the higher score, then the smaller path."""
    votes = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, score double")
    counted = votes.where(F.col("path") != "").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    top = F.max_by(F.struct("path", "votes"), F.struct("votes", "score", "path")).alias("top")
    return counted.groupBy("host").agg(top).select("host", "top.path", "top.votes")


def main_text(pages: DataFrame, broadcast: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    chosen = materialise(winners(pages), "hosts").select("host", "path")
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    if chosen.count() <= broadcast:
        rows = rows.join(F.broadcast(chosen), "host", "left")
    else:
        rows = join_hot(rows, chosen, "host", F.xxhash64("url", "page_id"), rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    texts = rows.select("page_id", "url", "html", "path").mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
