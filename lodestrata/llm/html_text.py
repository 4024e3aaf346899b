"""Main text of web pages by tree scoring.

A page becomes a small tree. Parts that never hold the article (scripts, navigation, forms, advertisements, comments, ...)
are cut. Each paragraph has points for its commas and its length, which it passes to its ancestors, less with each
level; an ancestor's points are discounted by the share of its text that lies in links. If the best container lies in an
article or main, that is kept whole but for cut parts, and with it siblings that score like it or read like paragraphs;
else the best container and all of its siblings, loose text too, that aren't mostly links. The text is given in
blocks, in page order.

Pages are independent rows, read in the scan's partitions and not exchanged.

Defined results: null or empty html, or a page without an article, gives an empty text; a tag that the page's end cuts off
is dropped; a quote in a tag is a character unless it follows `=` and is closed again, so it takes nothing else with it; elements
that are left open end with the page; repeated rows each keep a row; a very long page is
read whole, nesting is not limited; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm import shared

# Element names of HTML by what they do here, and words in class, id or role that name parts beside an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CUT = frozenset("script style textarea title noscript iframe xmp noembed noframes head nav footer aside form button select dialog template svg canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
#: An element that starts ends an open one of these names, up to the given border.
IMPLIED = {
    "li": (("li",), ("ul", "ol")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements that may be ended so, and by a border's name those that it hides; a paragraph is hidden by any other block.
ENDED = frozenset({"p"}.union(*(ends for ends, _ in IMPLIED.values())))
BORDERS = {x: frozenset({"p"} if x in BLOCK and x != "p" else ()) | {e for ends, to in IMPLIED.values() if x in to for e in ends} for x in BLOCK | {"select"}}
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer header masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promos promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article main content post story entry body text".split())
HEAD_WORDS = frozenset("header headers heading masthead banner".split())
NEGATIONS = frozenset("no not without with has have hide is".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())

#: A name and, behind `=`, a value; only there a quote opens a string, and only if it is closed again. Elsewhere it is a character.
_NAME, _VALUE = r"=[^\s/>=]*+|[^\s/>=]++", r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
_TOKEN = re.compile(rf"{_COMMENT}|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:{_NAME})(?:\s*+=\s*+(?:{_VALUE}))?+)*+)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element; `within`: it is or lies in an article or main; `ends`: by name the open elements that an implied end may close."""

    __slots__ = ("name", "parent", "children", "points", "chars", "link_chars", "commas", "cut", "within", "ends")

    def __init__(self, name: str, parent: Node | None, cut: bool = False):
        self.name, self.parent, self.cut = name, parent, cut
        self.within = name in ("article", "main") or (parent is not None and parent.within)
        ends = parent.ends if parent is not None else {}
        if name in BORDERS and (gone := BORDERS[name] & ends.keys()):
            ends = {k: v for k, v in ends.items() if k not in gone}
        self.ends = {**ends, name: self} if name in ENDED else ends
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.link_chars = self.commas = 0


def _names_aside(name: str, strict: bool, last: bool) -> bool:
    """Whether one class or id names a part beside the article: by any of its words, whatever the others say if strict.

    A header of the article (`post-header`) is none, nor is what a negation or `with`, `has` speaks of (`no-sidebar`). If
    last is set, only the last word counts (`cookie-notice`, not `notice-period`).
    """
    words = _WORD.findall(name)
    if not strict and ARTICLE_WORDS.intersection(words):
        return False
    for i, word in enumerate(words):
        if word in ASIDE_WORDS and not (word in HEAD_WORDS and ARTICLE_WORDS.intersection(words[:i])):
            return not NEGATIONS.intersection(words[:i]) and (not last or words[-1] in ASIDE_WORDS)
    return False


def _aside(name: str, attributes: str, within_article: bool, strict: bool) -> str:
    """`yes` if an element is none of the article by its name, role, class or id, or because it is hidden; else `no`.

    `links` for a paragraph or heading inside an article that a word names so, but not the last one: it is, if mostly links.
    """
    if name in CUT:
        return "yes"
    if name == "header" and not within_article:
        return "yes"
    if not attributes or name in ("html", "body", "article", "main"):
        return "no"
    given: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        given.setdefault(key.lower(), (value[1:-1] if value[:1] in ("'", '"') and value[:1] == value[-1:] and len(value) > 1 else value).lower())
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return "yes"
    if given.get("role") in ASIDE_ROLES:
        return "yes"
    names = [*given.get("class", "").split(), given.get("id", "")]
    prose = within_article and (name == "p" or name in HEADINGS)
    if any(_names_aside(x, strict, prose) for x in names):
        return "yes"
    return "links" if prose and any(_names_aside(x, strict, False) for x in names) else "no"


def _mostly_links(node: Node) -> bool:
    chars = links = 0
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, linked = stack.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            chars, links = chars + n, links + n * linked
        else:
            stack += [(c, linked or x.name == "a") for c in x.children]
    return 2 * links >= chars


def parse(page: str, strict: bool = True) -> Node:
    """The tree of a page; text in cut parts is left out."""
    root = here = Node("#root", None)
    opened: Counter[str] = Counter()  # names of the elements from the root to here
    doubtful: list[Node] = []
    at = 0
    find = _TOKEN.search
    while at < len(page):
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not here.cut:
            here.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        closing, name, attributes, end = m.groups()
        if name is None or not end:
            continue  # a comment or declaration; or a tag that the end of the page cuts off
        name = name.lower()
        if closing:
            if opened[name]:
                here = _up(here, _closed(here, name), opened)
            continue
        here = _up(here, _implied(here, name), opened)
        if name in VOID:
            if not here.cut:
                here.children.append(Node(name, here))
            continue
        aside = "yes" if here.cut else _aside(name, attributes, here.within, strict)
        node = Node(name, here, aside == "yes")
        if not node.cut:
            here.children.append(node)
        if aside == "links":
            doubtful.append(node)
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}[\\s/>]", re.IGNORECASE).search(page, at)
            if not stop:
                break
            at = stop.start()
        here = node
        opened[name] += 1
    for node in doubtful:
        if _mostly_links(node):
            node.parent.children = [c for c in node.parent.children if c is not node]
    return root


def _up(here: Node, to: Node, opened: Counter[str]) -> Node:
    """Ends the elements from here up to `to`."""
    while here is not to:
        opened[here.name] -= 1
        here = here.parent
    return to


def _closed(here: Node, name: str) -> Node:
    node = here
    while node.parent is not None:
        if node.name == name:
            return node.parent
        if name not in BLOCK and node.name in BLOCK:
            return here  # an inline end tag doesn't end blocks
        node = node.parent
    return here


def _implied(here: Node, name: str) -> Node:
    """Where an element of this name goes, after the ends that its start implies."""
    if name in CLOSES_P and "p" in here.ends:
        here = here.ends["p"].parent
    open_ = [here.ends[x] for x in IMPLIED[name][0] if x in here.ends] if name in IMPLIED else []
    if not open_:
        return here
    node = here  # the innermost of them
    while node not in open_:
        node = node.parent
    return node.parent


def _ordered(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return out


def _score(root: Node) -> list[Node]:
    """Sets chars, link_chars and points of every node; returns the nodes, parents before children."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.commas += c.commas
            else:
                node.chars += len("".join(c.split()))
                node.commas += c.count(",")
        if node.name == "a":
            node.link_chars = node.chars
        if node.name in PARAGRAPH and node.chars:
            points, up, share = 1 + node.commas + min(node.chars / 100, 3.0), node.parent, 1.0
            heading = 0.2 if node.name[0] == "h" or node.name == "li" else 1.0
            while up is not None and share >= 0.1:
                up.points += points * share * heading * (1 - node.link_chars / node.chars)
                up, share = up.parent, share / 2 if share == 1.0 else share / 3
    for node in nodes:
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.name in ("div", "section", "article", "main") and own >= 25:  # text that no paragraph holds
            node.points += 1 + own / 100
        if node.name in ("article", "main"):
            node.points += 5 if node.chars else 0
        node.points *= 1 - (node.link_chars / node.chars if node.chars else 0)
    return nodes


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the text of node in blocks; a block ends where a block element starts or ends."""
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.name == "br":
            out[-1].append(" ")
        else:
            block = x.name in BLOCK
            if block:
                out.append([])
                stack.append(None)
            stack += reversed(x.children)


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 1.0


def _frame(best: Node) -> Node | None:
    """The outermost article around best, or the main around it if that holds no other article; None without either.

    One with mostly links is no frame.
    """
    frames, node = {}, best
    while node is not None:
        if node.name in ("article", "main") and _density(node) < 0.5:
            frames[node.name] = node
        node = node.parent
    article, main = frames.get("article"), frames.get("main")
    if main is None or article is None:
        return main or article
    number = lambda top: sum(n.name == "article" for n in _ordered(top))
    return main if number(main) == number(article) else article


def _beside_frame(frame: Node, points: float) -> list[Node | str]:
    """The frame whole; of its siblings paragraphs, what scores like the article, and headings if the frame has none."""
    headings = not any(n.name == "h1" and n.chars for n in _ordered(frame))
    kept: list[Node | str] = []
    for x in frame.parent.children:
        if x is frame:
            kept.append(x)
        elif isinstance(x, Node) and x.name in BLOCK and x.chars:
            density = _density(x)
            reads = x.name == "p" and (density < 0.25 if x.chars > 80 else density == 0)
            if reads or (x.points >= 0.2 * points and density < 0.5) or (headings and x.name in HEADINGS and density < 0.5):
                kept.append(x)
    return kept


def _beside(best: Node) -> list[Node | str]:
    """best, and of its siblings every block and every run of loose text and inline elements that isn't mostly links."""
    kept: list[Node | str] = []
    loose: list[Node | str] = []
    for x in [*best.parent.children, best]:  # the last one only ends a run
        if isinstance(x, str) or x.name not in BLOCK:
            loose.append(x)
            continue
        chars = sum(len("".join(y.split())) if isinstance(y, str) else y.chars for y in loose)
        if chars and sum(y.link_chars for y in loose if isinstance(y, Node)) < 0.5 * chars:
            kept += loose
        loose = []
        if x is best or (x.chars and _density(x) < 0.5):
            kept.append(x)
    return kept[:-1]


def main_text(page: str) -> str:
    """The article's blocks, white space made single, joined by newlines; empty if there is none."""
    for strict in (True, False):  # where nothing is left, words of articles count against those of other parts
        nodes = _score(parse(page, strict))
        holders = [n for n in nodes if n.name not in PARAGRAPH and n.name in BLOCK and n.name not in ("html",) and n.points > 0]
        if holders:
            break
    else:
        return ""
    best = max(holders, key=lambda n: n.points)
    frame = _frame(best)
    if best.parent is None or best.name == "body":
        kept: list[Node | str] = [best]
    elif frame is not None:
        kept = _beside_frame(frame, best.points)
    else:
        kept = _beside(best)
    out: list[list[str]] = [[]]
    for x in kept:
        if isinstance(x, str):
            out[-1].append(x)
        else:
            _blocks(x, out)
    lines = (" ".join("".join(b).split()) for b in out)
    return "\n".join(x for x in lines if x)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in shared.chunks(batches, 2):
        texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
