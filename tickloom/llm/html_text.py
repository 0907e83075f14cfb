"""Main text of web pages by host consensus.

1. Every page is parsed by itself and its containers are scored by the text
   they hold outside menus, adverts, forms and the like; the tightest one that
   holds most of it casts a vote for its generalised path: tags and classes
   from the body down, digits masked.  A name alone drops neither an article
   nor what holds half of the page's text or lies on the host's path; inside an
   article a name that only contains a mark drops nothing but lists of links.
   Hidden elements go, inline ones too.
2. Spark counts the votes by host and path (partial sums, so a host with a
   third of all pages is no hot key) and takes each host's winner.
3. Every page is parsed again and its text taken from the containers on the
   winning path; a page without one uses its own best container.

The winners, one row per host, are a written table; they are broadcast if their
bytes stay below ``MAX_BROADCAST_BYTES`` and joined by shuffle beyond that.

Tags that are no article (menus, forms and so on) are weighed, too: a form or
field set that holds nearly all of a page's text is the page; a menu, header or
the like that nobody ended loses only its own lines, not the containers after
them; and where nothing at all is left, first such forms, then such tags that
hold an article, then all of them count. A head ends where something begins that
no head can hold. In an article, names count for less: headings have none by
their id, paragraphs and sections of running text are dropped for an advert's
name but not for the name of a topic (``TOPICS``), inline elements only for
an advert's (``span``, ``ins``).

Defined results: null or empty html gives an empty text; a null URL belongs to
the host ''; text without any markup is one block; unclosed comments and
scripts reach to the end of the page, as in browsers; what is in noscript is
left out, unless the page has no other text; repeated rows come back repeated;
columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as htmllib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, table
from .url_filters import host_of

MAX_BROADCAST_BYTES = 64 << 20
#: A container is left for its child only if the child holds this share of its text.
MOST = 0.7
#: A container that holds this share of the page's text is not dropped for its name.
HALF = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|select|canvas|title|desc|metadata|defs|annotation|annotation-xml)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*>|<[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Elements that end the block before them; those in CONTAINER may also hold the main text.
CONTAINER = frozenset("body main article section div td center blockquote details".split())
FORMS = frozenset(["form", "fieldset"])
DROPPED = FORMS | frozenset("nav footer aside header menu button dialog head label audio video map applet".split())
#: What can stand in a head; anything else ends it.
HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A form that holds this share of the page's text is the page.
WHOLE = 0.8
BLOCK = CONTAINER | DROPPED | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption pre hr address figure figcaption summary html option".split())
#: Blocks that end where one of those begins, if nobody ended them.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of classes, ids and roles that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription popup modal overlay sidebar sidenav widget widgets related recommended recommendations share sharing social comment comments "
    "disqus respond replies breadcrumb breadcrumbs menu nav navbar navigation footer header masthead topbar toolbar pagination pager login signup "
    "copyright skip search complementary contentinfo disclaimer paywall toc".split()
)
#: Names that begin or end so tell a feature, state or subject of what they name, not what it is.
FEATURE_FIRST = frozenset("has with without no not category tag tagged".split())
FEATURE_LAST = frozenset("open opened closed enabled disabled allowed".split())
#: Marks of what often is longer than the article, and the words that such names may also have.
LONGER = frozenset("comment comments disqus respond replies cookie cookies consent gdpr".split())
NEUTRAL = frozenset("list area section box container wrapper wrap block content body thread bar message text inner".split())
#: Marks that are topics or notes of an article as often as what stands around it, and tags of running text that may bear them.
TOPICS = frozenset("alert notice notices banner header footer social search navigation navbar nav menu login signup copyright disclaimer promotion overlay modal toc complementary contentinfo".split())
RUNNING = frozenset("p section blockquote li dd dt table td th tr ul ol dl figure figcaption pre details summary".split())
#: Characters from which a marked block can be running text.
SENTENCE = 16
#: Whole names of inline adverts.
INLINE_ADS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo".split())
# Kinds of blocks, words of places and of lists: with a mark, they name what the mark names.
NEUTRAL |= frozenset("post posts page site left right top bottom main primary secondary author article mobile desktop sticky inline links link items item stories story buttons button icons bar row group card unit slot header footer".split())
#: Text of which this share is linked is a list of links.
LINKED = 0.5
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BARE_HIDDEN = re.compile(r"\shidden(?=[\s/]|$)", re.I)
_DIGITS = re.compile(r"[0-9]+")
_NOSCRIPT = re.compile(r"</?noscript\b[^>]*>", re.I)


class Node:
    """A container, or something dropped, with the text blocks that follow its start.

    ``mark`` is set for what may be dropped: for its name 1 where a mark is part of it, 2 where it is all of it, 3 if that is one of ``LONGER``;
    for its tag 4 (forms) or 5. ``topic``: all marks of the name are topics. ``closed``: the page has an end tag for it.
    ``inner``: inside a list, paragraph or the like that is marked, where every block is a node.
    ``own``, ``size`` and ``linked``: characters of its blocks outside links (less as many as are linked), of all, and of links.
    """

    __slots__ = ("children", "closed", "dropped", "headline", "inner", "linked", "mark", "own", "parent", "path", "size", "tag", "topic")

    def __init__(self, tag: str, path: str, parent: Node | None, dropped: bool, mark: int = 0, inner: bool = False):
        self.tag, self.path, self.parent, self.dropped, self.mark, self.inner = tag, path, parent, dropped, mark, inner
        self.children: list[Node | str] = []
        self.own = 0.0
        self.size = self.linked = 0
        self.closed = self.topic = False
        self.headline = tag == "main" or (tag == "article" and mark < 3)


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))


def _attributes(raw: str | None) -> dict[str, str]:
    if not raw:
        return {}
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)}
    if "hidden" not in found and _BARE_HIDDEN.search(raw):
        found["hidden"] = ""
    return found


def _names(attributes: dict[str, str], which=("class", "id", "role")) -> list[list[str]]:
    """The words of each name that tells what an element is."""
    found = []
    for name in " ".join(attributes[k] for k in which if k in attributes).split():
        words = [w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w and not w.isdigit()]
        if not (MARKS.isdisjoint(words) or words[0] in FEATURE_FIRST or words[-1] in FEATURE_LAST):
            found.append(words)
    return found


def _mark(attributes: dict[str, str], which=("class", "id", "role")) -> int:
    found = 0
    for words in _names(attributes, which):
        whole = all(w in MARKS or w in NEUTRAL for w in words)
        found = max(found, 1 + whole + (whole and not LONGER.isdisjoint(words)))
    return found


def _topic(attributes: dict[str, str]) -> bool:
    """Whether every mark of its names is a topic's."""
    return all(w in TOPICS for words in _names(attributes) for w in words if w in MARKS)


def parse(page: str, path: str | None = None) -> Node:
    """The tree of containers with their blocks of text in page order; marks on ``path`` do not count."""
    root = node = Node("", "", None, False)
    words: list[str] = []  # raw text of the open block
    linked = 0
    in_link = False
    silent: list[str] = []  # an inline element without visible text, and those of its name inside it

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join(htmllib.unescape("".join(words)).split())
            if text and not node.dropped:
                node.children.append(text)
                node.own += max(len(text) - 2 * linked, 0)
                node.size += len(text)
                node.linked += min(linked, len(text))
            words.clear()
        linked = 0
        silent.clear()

    def leave_head() -> None:
        nonlocal node
        flush()
        node.closed, node = True, node.parent

    def add(raw: str) -> None:
        nonlocal linked
        if silent:
            return
        if node.tag == "head" and raw.strip():
            leave_head()
        words.append(raw)
        if in_link:
            linked += len(raw)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        tag, closing = name.lower(), bool(m.group(2))
        if node.tag == "head" and not closing and tag not in HEAD:
            leave_head()
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCK:
            flush()
            in_link = False
            if tag == "h1" and not closing:
                node.headline = True
            if closing:
                up = node
                while up.parent and up.tag != tag and (tag in CONTAINER or tag in DROPPED or up.tag not in CONTAINER):
                    up = up.parent
                if up.parent and up.tag == tag:
                    up.closed, node = True, up.parent
                continue
            while node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
                node = node.parent
            if tag in ("html", "hr"):
                continue
            attributes = _attributes(m.group(4))
            hidden = bool(attributes) and tag != "body" and _hidden(attributes)
            heading = tag in HEADINGS
            mark = _mark(attributes, ("class", "role") if heading else ("class", "id", "role")) if attributes and tag != "body" and not hidden else 0
            small = tag not in CONTAINER and tag not in DROPPED
            if small and tag not in ("ul", "ol", "table", "p") and mark == 1:
                mark = 0
            if tag not in VOID and (not small or hidden or mark or node.inner):
                inside = node.dropped
                # What stands at the head of an article belongs to it.
                title = tag == "header" and not inside and _within_article(node)
                classes = ".".join(sorted(_DIGITS.sub("#", c) for c in attributes.get("class", "").split()))
                place = f"{node.path}/{tag}" + (f".{classes}" if classes else "") if tag != "body" else ""
                if tag in DROPPED:
                    mark = 4 if tag in FORMS else 5
                child = Node(tag, place, node, inside or (hidden and not title), 0 if title else mark, node.inner or (small and bool(hidden or mark)))
                child.topic = mark == 2 and _topic(attributes)
                node.children.append(child)
                node = child
        elif tag not in VOID:
            # An inline element that is hidden, or an advert and the like by its whole name.
            if silent:
                if tag == silent[0]:
                    silent.pop() if closing else silent.append(tag)
            elif not closing and m.group(4):
                attributes = _attributes(m.group(4))
                advert = tag in ("span", "ins") and any(INLINE_ADS.issuperset(w for w in words_ if w in MARKS) for words_ in _names(attributes, ("class", "role")))
                if _hidden(attributes) or (advert and _mark(attributes) >= 2) or (_mark(attributes) >= 2 and not _within_article(node)):
                    silent.append(tag)
    if at < len(page):
        add(page[at:])
    flush()
    _drop_marked(root, path)
    return root


def _ordered(root: Node, marked: bool = True) -> list[Node]:
    """All containers, each before those inside it (without recursion: pages nest deeply)."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and (marked or not c.mark)]
    return found


def _drop_marked(root: Node, path: str | None) -> None:
    """Drop what is marked by its name, unless it is or holds the page's text."""
    nodes = _ordered(root)
    if not any(n.mark and not n.dropped for n in nodes):
        return
    held: dict[int, float] = {}
    size: dict[int, tuple[int, int]] = {}
    inner: dict[int, float] = {}  # of forms: what they would hold if they counted
    for node in reversed(nodes):
        inside = [c for c in node.children if isinstance(c, Node)]
        inner[id(node)] = node.own + sum(inner[id(c)] if c.mark == 4 else held[id(c)] for c in inside if c.mark < 5)
        below = sum(held[id(c)] for c in inside)
        if node.mark == 5 and not node.closed and not node.dropped and any(c.mark < 4 and held[id(c)] > 0 for c in inside):
            # Nobody ended it: its own lines go, containers that follow them stay.
            node.children, node.own, node.mark = inside, 0.0, 0
        held[id(node)] = 0.0 if node.mark >= 4 else node.own + below
        size[id(node)] = (node.size + sum(size[id(c)][0] for c in inside), node.linked + sum(size[id(c)][1] for c in inside))
        node.headline |= any(c.headline and not c.dropped for c in node.children if isinstance(c, Node))
    for node in nodes:
        # The page stands in a form.
        if node.mark == 4 and inner[id(node)] >= WHOLE * (held[id(root)] + inner[id(node)]) > 0 and (node.headline or not any(n.tag in ("article", "main") and held[id(n)] > 0 for n in nodes)):
            more = inner[id(node)]
            node.mark = 0
            up = node
            while up:
                held[id(up)] += more
                up = up.parent
            for n in nodes:
                if n.mark == 4 and _inside(n, node):
                    n.mark = 0 if inner[id(n)] >= WHOLE * more else 4
    least = HALF * held[id(root)]
    article = any(n.tag in ("article", "main") and held[id(n)] > 0 for n in _kept(root))
    for node in nodes:
        if node.mark > 3:
            continue
        large = held[id(node)] >= least > 0
        total, linked = size[id(node)]
        if path and (path == node.path or path.startswith(node.path + "/")):
            node.mark = 0
        elif node.mark < 3 and node.tag in ("article", "main"):
            node.mark = 0
        elif node.mark == 1 and linked < LINKED * total and _within_article(node.parent):
            # Part of a name says little of what stands in an article, unless it is a list of links.
            node.mark = 0
        elif node.topic and node.tag in RUNNING and total >= SENTENCE and linked < LINKED * total and _within_article(node.parent):
            # Running text about what the name says.
            node.mark = 0
        elif large and (node.mark == 1 or node.headline or (node.mark == 2 and not article)):
            node.mark = 0
    holders: set[int] = set()  # what is, or has inside it, an article
    for node in reversed(nodes):
        if node.tag in ("article", "main") or any(isinstance(c, Node) and id(c) in holders for c in node.children):
            holders.add(id(node))
    for lifted in (2, 3, 4, 5):
        # Names and tags count for nothing where they leave no text at all; those around an article go first.
        for around in (True, False) if lifted > 3 else (False,):
            if not any(n.own for n in _kept(root)):
                for node in nodes:
                    if node.mark <= lifted and (not around or id(node) in holders):
                        node.mark = 0
    for node in nodes:
        if node.mark:
            node.dropped, node.children, node.own = True, [], 0.0


def _inside(node: Node, outer: Node) -> bool:
    up = node.parent
    while up and up is not outer:
        up = up.parent
    return up is outer


def _kept(root: Node) -> list[Node]:
    return _ordered(root, marked=False)


def _within_article(node: Node | None) -> bool:
    while node:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _weigh(root: Node) -> dict[int, float]:
    """Text held by every container, what is inside it included."""
    held: dict[int, float] = {}
    for node in reversed(_ordered(root)):
        held[id(node)] = node.own + sum(held[id(c)] for c in node.children if isinstance(c, Node))
    return held


def best(root: Node) -> Node:
    """The tightest container that holds most of the page's text."""
    held = _weigh(root)
    node = root
    while True:
        # Tags of menus and forms are still here if they hold the page.
        inner = [c for c in node.children if isinstance(c, Node) and not c.dropped and (c.tag in CONTAINER or (c.tag in DROPPED and node.tag not in ("article", "main")))]
        if not inner:
            return node
        child = max(inner, key=lambda c: held[id(c)] * (2 if c.tag in ("article", "main") else 1))
        share = MOST / 2 if child.tag in ("article", "main") else MOST
        if held[id(child)] <= 0 or held[id(child)] < share * held[id(node)] or (node.tag == "article" and child.tag != "article"):
            return node
        node = child


def blocks(node: Node) -> list[str]:
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            found.append(x)
        elif not x.dropped:
            stack += reversed(x.children)
    return found


def on_path(root: Node, path: str) -> list[Node]:
    """The outermost kept containers on a path, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.path == path and not node.dropped and node.tag:
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def vote(page: str | None) -> str:
    return best(parse(page or "")).path


def main_text(page: str | None, path: str | None) -> str:
    root = parse(page or "", path)
    nodes = on_path(root, path) if path else []
    text = "\n\n".join(b for n in nodes for b in blocks(n)) or "\n\n".join(blocks(best(root)))
    if not text and page and _NOSCRIPT.search(page):
        return main_text(_NOSCRIPT.sub(" ", page), path)
    return text


@F.pandas_udf(T.StringType())
def votes(page: pd.Series) -> pd.Series:
    return page.map(vote)


@F.pandas_udf(T.StringType())
def texts(page: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([main_text(p, w) for p, w in zip(page, path, strict=True)], dtype=object)


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with most votes of each host (ties: the shorter, then the smaller)."""
    counted = pages.select(host_of(F.col("url")).alias("host"), votes("html").alias("path")).groupBy("host", "path").agg(F.count("*").alias("n"))
    ranked = F.struct(-F.col("n"), F.length("path"), F.col("path"))
    return counted.groupBy("host").agg(F.min_by("path", ranked).alias("path"))


def extract(pages: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text of every page."""
    place = Workspace(pages.sparkSession, "html-paths")
    winners = place.write(winning_paths(pages), "paths").select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    size = winners.agg(F.sum(F.octet_length("__host") + F.octet_length("__path") + 64)).first()[0] or 0
    if size <= max_bytes:
        winners = F.broadcast(winners)
    read = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("__host")).join(winners, "__host", "left")
    return read.select("page_id", "url", texts("html", "__path").alias("text"))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
