"""Main text of web pages by composite text density.

The page is read into a tree. Elements that never hold article text by their
meaning (nav, footer, aside, dialog and the like, a header outside of an
article, hidden parts, ARIA roles of these) are set aside. For every other node
the composite text density (Sun, Song, Liao: DOM based content extraction via
text density, 2011) is computed: characters per tag, lowered by the share of
link text and link tags. The densities of a node's children are summed, the
subtree of the greatest sum is the main text, and the least density on the path
from the body to it is the threshold: a subtree beside it belongs to the text if
its own density reaches the threshold and its sum is a fifth of the greatest, and so
do elements of its name and class beside it that aren't mostly links; a part inside it that is mostly links falls below the threshold and goes. If the
body itself has the greatest sum, its sparse containers go too. An article
element around the chosen subtree, or the one that holds most of it, is taken
alone, with the articles beside it. The last h1 before the text is its headline,
if the text has none.

Density can't tell a reader's comment, an advert or a notice from article text.
For these kinds alone the author's naming counts: an element whose class or id
is such a name (`MARKS`, with no words but `PLAIN` ones beside) is left out,
unless it holds over half of the page's text and an article, main or h1 element
(of comments: main or h1) and so is a wrapper. A form is left out as well,
unless it is such a wrapper or holds over half of the text and over 200
characters for each of its controls.

Defined results: a null or empty page has an empty text, and so has a page of
menus, adverts, comments and forms only; a page without mark-up is its own text;
broken mark-up is read about as a browser would close it; of equal sums the
first node in page order wins; repeated rows each get their text; columns beside
key, url and html are left out, whatever their names; text is never cut, and a
page takes time in proportion to its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from briarlake.llm.text import small_batches

# Element names, roles and names of parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav footer aside menu dialog button select search head noscript template canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CONTROLS = frozenset("input select textarea button".split())
CONTAINERS = frozenset("div section ul ol dl table center".split())
_SECTIONS = ("caption", "thead", "tbody", "tfoot", "tr", "td", "th")
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("caption", "tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "thead": _SECTIONS, "tbody": _SECTIONS, "tfoot": _SECTIONS, "button": ("button",),
}
SCOPE = {
    "li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "optgroup": ("select",),
    "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "button": (),
}
#: What may stand in a head or a select; anything else ends it.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
IN_SELECT = frozenset("option optgroup hr script template".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion "
    "comment comments commentlist disqus respond replies "
    "nav navbar navigation topnav menu topbar breadcrumb breadcrumbs pagination header masthead banner footer sidebar sidebars "
    "cookie cookies consent gdpr notice notices alert popup modal overlay share sharing newsletter subscribe signup login signin paywall".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that only place or frame a part.
PLAIN = frozenset("label text button buttons icon icons link links item items message title left right top bottom main primary secondary site page global list section block box bar container wrapper wrap area panel slot unit inner outer user reader post article form 1 2 3 4".split())
#: A list of other articles: all its words are of these, and one is of the first two.
RELATED = frozenset("related recommended posts post articles article stories story links content section block box list widget".split())
#: Inside an article these mark its own heading.
HEADS = frozenset("header masthead banner".split())

#: Characters a form must have for each of its controls to count as text.
CHARS_PER_CONTROL = 200
#: A closing line of rights is shorter.
RIGHTS_CHARS = 200

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_RIGHTS = re.compile(r"\s*(?:©|&copy;|&#169;|\(c\)\s|copyright\b)", re.IGNORECASE)
_HIDING = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE | re.ASCII) for name in RAW}


class Node:
    """chars, tags, link_chars, link_tags, controls: of the whole subtree. parts: texts and nodes."""

    __slots__ = ("name", "parent", "parts", "off", "marked", "chars", "tags", "link_chars", "link_tags", "controls", "holds", "heads", "kind", "density", "total", "best")

    def __init__(self, name: str, parent: Node | None = None, off: bool = False, marked: str = "", kind: str = ""):
        self.name, self.parent, self.off, self.marked, self.kind, self.parts = name, parent, off, marked, kind, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.controls = 0
        self.holds = self.heads = False
        self.density = self.total = 0.0
        self.best = self


def _marks(attributes: str, in_article: bool) -> tuple[bool, str, str]:
    """(off, marked, kind) by an element's attributes: hidden or of a role that is no text; "part" or "comments" if named so; its classes."""
    marked = kind = ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            return True, "", ""
        if key == "role" and value.strip().lower() in ROLES:
            return True, "", ""
        if key == "class":
            kind = " ".join(value.split())
        if key in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                named = words & MARKS
                if words & {"related", "recommended"} and len(words) > 1 and words <= RELATED:
                    marked = marked or "part"
                if named and words <= MARKS | PLAIN and not (in_article and named <= HEADS):
                    marked = "comments" if named & COMMENTS else marked or "part"
    return False, marked, kind


class _Open:
    """The open elements, with the places of each name, so that no end tag needs a search."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((x[-1] for n in names if (x := self.places.get(n))), default=0)

    def first(self, scope: int, *names: str) -> int:
        """Place of the outermost open element of these names inside the one at `scope`; 0 if there is none."""
        return min((x[k] for n in names if (x := self.places.get(n)) and (k := bisect_right(x, scope)) < len(x)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Close the element at this place and all in it."""
        while len(self.stack) > place:
            name = self.stack.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def parse(page: str) -> Node:
    """The tree of a page. An open paragraph ends where a block begins; an end tag closes what is open inside it.

    End tags that HTML lets out are put in: of head, list items, parts of tables,
    options; and a select ends at the first element that it can't hold.
    """
    root = Node("html")
    opened, at = _Open(root), 0
    stack = opened.stack
    while True:
        found = _TAG.search(page, at)
        if found is None:
            if stack[-1].name == "head":
                opened.close(opened.last("head"))
            stack[-1].parts.append(page[at:])
            return root
        if found.start() > at:
            if stack[-1].name == "head" and not page[at : found.start()].isspace():
                opened.close(opened.last("head"))
            stack[-1].parts.append(page[at : found.start()])
        at = found.end()
        if found[2] is not None:
            close, name, attributes = found[1], found[2].lower(), found[3]
        elif found[5] is not None:
            close, name, attributes = found[4], found[5].lower(), found[6]
        else:
            continue
        if close:
            place = opened.last(name)
            if place and not (name not in BLOCK and name not in ASIDE and opened.blocks and opened.blocks[-1] > place):  # an inline end tag doesn't close a block
                opened.close(place)
            continue
        if (head := opened.last("head")) and name not in IN_HEAD and name != "head" and stack[-1].name == "head":
            opened.close(head)
        if (select := opened.last("select")) and name not in IN_SELECT and name != "select":
            opened.close(select)
        if name in ("html", "body"):
            if (head := opened.last("head")) and name == "body":
                opened.close(head)
            if len(stack) == 1 and name == "body":
                body = Node("body", stack[-1])
                stack[-1].parts.append(body)
                opened.push(body)
            continue
        if name in CONTROLS:
            stack[-1].controls += 1
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "br":
                stack[-1].parts.append(" ")
            elif name == "hr":
                stack[-1].parts.append(Node("hr", stack[-1]))
            continue
        if name in BLOCK:
            if (p := opened.last("p")) and opened.blocks[-1] == p:
                opened.close(p)
        if name in CLOSES and (place := opened.first(opened.last(*SCOPE[name]), *CLOSES[name])):
            opened.close(place)
        in_article = bool(opened.last("article", "main"))
        off = name in ASIDE or name == "header" and not in_article
        off_too, marked, kind = _marks(attributes, in_article) if attributes else (False, "", "")
        if name == "main" or name == "article" and not in_article:
            marked = ""
        node = Node(name, stack[-1], off or off_too, marked, kind)
        stack[-1].parts.append(node)
        if not attributes.endswith("/") or name in BLOCK:
            opened.push(node)


def _order(root: Node) -> list[Node]:
    """Nodes that are not set aside, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.off]
    return out


def _ink(text: str) -> int:
    return 0 if text.isspace() else len(text) - text.count(" ")


def _last_block(root: Node) -> Node | None:
    """The innermost block of the page's last text."""
    node = root
    while True:
        for part in reversed(node.parts):
            if isinstance(part, str) and not part.isspace():
                while node.name not in BLOCK and node.parent is not None:
                    node = node.parent
                return node
            if isinstance(part, Node) and not part.off and part.chars:
                node = part
                break
        else:
            return None


def _written(node: Node) -> str:
    """The start of a node's text."""
    out, todo = [], [node]
    while todo and sum(map(len, out)) < 40:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part.lstrip() if not out else part)
        elif not part.off:
            todo += reversed(part.parts)
    return "".join(out)


def set_marks_aside(root: Node) -> None:
    """Named parts and forms of controls are off unless they wrap the text, and so is a closing line of rights."""
    nodes = _order(root)
    page_chars = sum(_ink(x) for node in nodes for x in node.parts if isinstance(x, str))
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += _ink(part)
                continue
            node.controls += part.controls
            if not part.off:
                node.chars += part.chars
                node.heads |= part.heads or part.name in ("main", "h1")
                node.holds |= part.holds or part.name in ("article", "main", "h1")
        written = node.name == "form" and not node.marked and node.controls * CHARS_PER_CONTROL < node.chars
        wraps = 2 * node.chars > page_chars and (written or (node.heads if node.marked == "comments" else node.holds))
        if (node.marked or node.name == "form") and not wraps:
            node.off = True
    last = _last_block(root)
    if last is not None and last.chars < RIGHTS_CHARS and 4 * last.chars < root.chars and _RIGHTS.match(_written(last)):
        last.off = True


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_chars: int, page_link_chars: int) -> float:
    """Composite text density. The logarithm's base is 2 at least, so that pages with hardly any link have no pole."""
    if not chars:
        return 0.0
    tags, link_tags = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_link_chars / max(page_chars, 1) * chars + math.e)
    return chars / tags * math.log(max(chars / max(link_chars, 1) * tags / link_tags, 1.0)) / math.log(max(base, 2.0))


def weigh(root: Node) -> list[Node]:
    """Counts, densities, the children's sums and the best node of every subtree; nodes with parents first."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += _ink(part)
            elif not part.off:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, root.chars, root.link_chars)
        inner = [x for x in node.parts if isinstance(x, Node) and not x.off]
        node.total = sum(x.density for x in inner) or node.density  # a leaf stands for itself
        for x in inner:
            if x.best.total > node.best.total:
                node.best = x.best
    return nodes


def _path(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _article(node: Node) -> Node | None:
    """The outermost article element around the node, or the one that holds over half of its text."""
    around = [x for x in _path(node) if x.name == "article"]
    if around:
        return around[-1]
    todo = [x for x in node.parts if isinstance(x, Node) and not x.off]
    while todo:
        x = todo.pop()
        if 2 * x.chars > node.chars:  # at most one child holds over half
            if x.name == "article":
                return x
            todo = [y for y in x.parts if isinstance(y, Node) and not y.off]
    return None


def _kin(node: Node) -> list[Node]:
    """The elements of the node's name and class beside it, or beside the element around it that has such: further articles of the page."""
    while node.parent is not None and node.name != "body":
        found = [x for x in node.parent.parts if isinstance(x, Node) and not x.off and x is not node and x.name == node.name and x.kind == node.kind and 2 * x.link_chars <= x.chars and x.chars]
        if node.name == "article" or node.kind:
            return found
        node = node.parent
    return []


def _headline(root: Node, chosen: set[int]) -> Node | None:
    """The last h1 before the chosen parts, if they have none and no link fills it."""
    last, passed, todo = None, False, [(root, False)]
    while todo:
        node, on = todo.pop()
        on = on or id(node) in chosen
        passed = passed or on
        if node.name == "h1":
            if on:
                return None
            if not passed and 2 * node.link_chars <= node.chars:
                last = node
        todo += [(x, on) for x in reversed(node.parts) if isinstance(x, Node) and not x.off]
    return last


def choose(root: Node) -> set[int]:
    """Ids of the nodes whose subtrees are the main text; what they hold that is none of it is set off."""
    best = root.best
    threshold = min(x.density for x in _path(best))
    article = _article(best)
    chosen: set[int] = set()
    if article is not None:
        inside = [article, *_kin(article)]
        chosen |= set(map(id, inside))
    else:
        inside, todo, seen = [], [root], set()
        while todo:
            node = todo.pop()
            if node.density >= threshold and 5 * node.best.total >= best.total and node.chars and id(node.best) not in seen:
                seen.add(id(node.best))
                chosen.add(id(node.best))
                inside.append(node.best)
                for x in _kin(node.best):
                    if id(x) not in seen:
                        seen.add(id(x))
                        chosen.add(id(x))
                        inside.append(x)
            if id(node) not in chosen:
                todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.off]
    headline = _headline(root, chosen)
    if headline is not None:
        chosen.add(id(headline))
    todo = inside
    while todo:
        node = todo.pop()
        for x in node.parts:
            if isinstance(x, Node) and not x.off:
                sparse = x.density < threshold and x.name in CONTAINERS
                linked = x.link_tags > 1 and 2 * x.link_chars > x.chars
                loose = node.name in ("html", "body") and 5 * x.best.total < best.total
                if sparse and (linked or loose):
                    x.off = True
                else:
                    todo.append(x)
    return chosen


def _blocks(root: Node, chosen: set[int]) -> str:
    blocks: list[str] = []
    inline: list[str] = []

    def close() -> None:
        if inline:
            text = " ".join("".join(inline).split())
            if text:
                blocks.append(text)
            inline.clear()

    todo: list[tuple[Node | str | None, bool]] = [(root, id(root) in chosen)]
    while todo:
        part, on = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            if on:
                inline.append(unescape(part) if "&" in part else part)
        elif not part.off:
            on = on or id(part) in chosen
            if part.name in BLOCK:
                close()
                todo.append((None, on))
            todo += [(x, on) for x in reversed(part.parts)]
        elif part.name in BLOCK:
            close()
        elif on:
            inline.append(" ")
    close()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The article text of one page: blocks in page order, one to a line."""
    if not page:
        return ""
    root = parse(page)
    set_marks_aside(root)
    weigh(root)
    return _blocks(root, choose(root))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    small_batches(pages.sparkSession, 500)
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, url)]
    return pages.select(key, url, html).mapInArrow(run, f"{kinds[0]}, {kinds[1]}, text string, n_chars long")
