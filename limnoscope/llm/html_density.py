"""Main text of web pages by composite text density.

Each page is parsed once into a tree of elements. A node's density is its characters per tag, adjusted for links: text
in links lowers it, and a page rich in links lowers it further. A node's density sum adds its children's densities; the
subtree with the largest sum is taken, and the least density on the path from it to the body is the threshold that
decides which neighbours on that path belong to the text as well.

What is never text is left out of the tree: scripts, styles, form controls, menus, footers, sidebars, comments, hidden
parts, forms and elements whose class, id or role names an advert, notice, sidebar, menu or comment list. Neither a form
nor such a name drops the element that wraps all articles of the page, or all but a tenth of its text. A name that is only
part of a compound (`has-sidebar`, `ad-free`) does not drop an element either that holds the densest text, or prose inside
an article. All articles of the body belong to the text if they are prose.

Blocks are the runs of text between block elements. White space in a block becomes one space; blocks are joined by one
line feed. Character references are decoded.

Defined results: a null, empty or textless page gives the empty text with 0 characters; broken markup is read as far as
it goes, unclosed elements end with their parent; repeated rows give repeated results; extra columns are not returned;
an empty table gives no rows. Whole pages are read, whatever their length.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
NEVER = frozenset(
    "head script style noscript template iframe object svg canvas audio video nav menu footer aside button label select textarea input dialog".split()
)
#: A paragraph ends where one of these begins.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
#: An open element of the first kind ends where one of its followers begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class, id and role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup paywall sidebar side aside widget widgets menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar footer footnav masthead topbar comment comments commentlist disqus replies respond discussion "
    "share sharing social related recommended recommendations search login skip toc complementary contentinfo".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SPACES = re.compile(r"\s+")
BLANK = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "named", "article")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: str = ""):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        #: The innermost article around the node, itself included.
        self.article: Node | None = self if tag in ("article", "main") else parent.article if parent is not None else None
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], parent: Node | None) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    # A page's header is left out, an article's own header holds its title.
    if tag == "header":
        return parent is None or parent.article is None
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """"whole" for a form or if a word of class, id or role is boilerplate, "part" if only a part of a compound word is."""
    if tag == "form":
        return "whole"
    found = ""
    if tag not in ("html", "body", "article", "main", "header"):
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for word in value.lower().split():
                    if word in BOILERPLATE:
                        return "whole"
                    if not BOILERPLATE.isdisjoint(re.split(r"[-_]+", word)):
                        found = "part"
    return found


class Builder(HTMLParser):
    """Tree of a page; text of dropped subtrees is not kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.at = self.root
        #: How many elements of each name are open, so nothing is looked for in vain.
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close("p", barrier=BLOCKS - {"p"})
        if tag in SIBLINGS:
            for open_, followers in SIBLINGS.items():
                if tag in followers:
                    self._close(open_, barrier={"ul", "ol", "dl", "table", "select", "tbody", "thead"})
        if tag == "body":
            # The head ends where the body begins, closed or not.
            self._close("head", barrier=frozenset())
        parent = self.at
        node = Node(tag, parent, parent.dropped or _is_boilerplate(tag, attrs, parent), _named(tag, attrs))
        parent.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "iframe", "object"):
            self._end(self.at)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._close(tag, barrier=frozenset())
        else:
            self._close(tag, barrier=BLOCKS)

    def _close(self, tag: str, barrier) -> None:
        if not self.open.get(tag):
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in barrier:
                return
            node = node.parent
        if node.parent is not None:
            self._end(node)

    def _end(self, node: Node) -> None:
        """Ends the node and whatever is open below it."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def handle_data(self, data):
        if not self.at.dropped:
            self.at.children.append(data)


def _below(root: Node) -> list[Node]:
    """The node and all that is not dropped below it, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return order


def _measure(root: Node) -> None:
    """Characters, tags and links below every node, then densities and their sums; parents after children."""
    order = _below(root)
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(BLANK.sub("", c))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = root
    page_ratio = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c == 0:
            continue
        plain = max(c - node.link_chars, 1)
        base = math.log(c * lc / plain + page_ratio * c + math.e)
        node.density = c / t * math.log(c * t / (lc * lt) + 1, max(base, 1.0001))
    for node in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)
        # Text directly in a node counts like a child without tags.
        node.total += sum(len(BLANK.sub("", c)) for c in node.children if isinstance(c, str))


def _up(node: Node) -> list[Node]:
    """The node and its ancestors up to the body."""
    path = [node]
    while node.parent is not None and node.tag != "body":
        node = node.parent
        path.append(node)
    return path


def _densest(order: list[Node]) -> Node:
    best = order[0]
    for node in order:
        if node.total > best.total or best is order[0] and node.total == best.total:
            best = node
    return best


def _drop_named(root: Node) -> None:
    """Drops elements by their class, id or role, except those that hold the page's text; densities are measured anew."""
    _measure(root)
    order = _below(root)
    if not any(n.named for n in order):
        return
    # Articles outside of named elements are the page's own; only without them is one inside, and its wrapper stays.
    inside: dict[int, bool] = {}
    for n in order:
        inside[id(n)] = bool(n.named) or n is not root and inside[id(n.parent)]
    articles = [n for n in order if n.tag in ("article", "main") and n.chars]
    if articles and all(inside[id(n)] for n in articles):
        for x in _up(max(articles, key=lambda n: n.chars)):
            x.named = ""
    elif not articles:
        _keep_wrapper(root, order)
    for node in order:
        if node.named == "whole":
            node.dropped = True
    _measure(root)
    order = _below(root)
    holds = {id(x) for x in _up(_densest(order))}
    for node in order:
        if node.named != "part" or id(node) in holds:
            continue
        around = node.article
        if around is None or node.density < around.density / 2 or 2 * node.link_chars > node.chars:
            node.dropped = True
    _measure(root)


def _keep_wrapper(root: Node, order: list[Node]) -> None:
    """Clears the name of an element that holds all but a tenth of the page's text outside links, and of what wraps it."""
    plain = lambda n: n.chars - n.link_chars
    wrapper = root
    while True:
        # The outermost named elements below the wrapper; what is left without them.
        outer, todo = [], [wrapper]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Node) and not c.dropped:
                    (outer if c.named == "whole" else todo).append(c)
        largest = max(outer, key=plain, default=None)
        if largest is None or 10 * (plain(wrapper) - sum(map(plain, outer))) >= plain(largest):
            return
        for x in _up(largest):
            x.named = ""
        wrapper = largest


def _chosen(root: Node) -> Node:
    """The subtree with the largest density sum, and the neighbours on its path that reach the path's threshold."""
    order = _below(root)
    best = _densest(order)
    articles = [n for n in order if n.tag in ("article", "main") and n.chars]
    while best.tag not in BLOCKS and best.parent is not None:
        best = best.parent
    if articles and best.tag in ("body", "html"):
        best = max(articles, key=lambda n: n.chars)
    path = _up(best)
    threshold = min((n.density for n in path if n.chars), default=0.0)
    # An article is one whole: its sparse parts, such as headings, belong to it. Neighbours of the outermost may join it.
    whole = [k for k, n in enumerate(path) if n.tag in ("article", "main")]
    start = whole[-1] if whole else 0
    taken, below = path[start], path[start]
    for node in path[start + 1 :]:
        # A page with an article on the path has named its text itself, so what else the body holds stays out.
        # Its other articles do not.
        outside = whole and node.tag in ("body", "html")
        taken = _with_neighbours(node, below, taken, threshold, ("article", "main") if outside else None)
        below = node
    return taken


def _with_neighbours(node: Node, below: Node, taken: Node, threshold: float, only: tuple[str, ...] | None = None) -> Node:
    """`taken`, the text of the child `below`, with the node's other children that reach the threshold, in page order.

    Text and inline elements between two blocks are one child. Headings before the last child taken are taken too. With
    `only`, no other children than those elements are looked at.
    """
    children: list[tuple[bool, bool, list[Node | str]]] = []
    run: list[Node | str] = []

    def close() -> None:
        chars = sum(len(BLANK.sub("", c)) if isinstance(c, str) else c.chars for c in run)
        if chars:
            children.append((chars >= threshold, False, list(run)))
        run.clear()

    for c in node.children:
        if only is not None and c is not below and (isinstance(c, str) or c.tag not in only):
            continue
        if isinstance(c, str) or c.tag not in BLOCKS and c is not below and not c.dropped:
            run.append(c)
        elif not c.dropped:
            close()
            if c is below:
                children.append((True, False, [taken]))
            elif c.chars and only is not None:
                # Another article need only be prose of about that density.
                children.append((2 * c.density >= threshold and 2 * c.link_chars <= c.chars, False, [c]))
            elif c.chars:
                children.append((c.density >= threshold, c.tag in HEADINGS, [c]))
    close()
    if len(children) == 1:
        return taken
    last = max(k for k, (dense, _, _) in enumerate(children) if dense)
    out = Node("div", None)
    for k, (dense, heading, items) in enumerate(children):
        if dense or heading and k < last:
            out.children += [*items, Node("hr", None)]
    return out


def blocks(node: Node) -> list[str]:
    """Texts between block elements, in page order, white space folded."""
    out, run, todo = [], [], [node]

    def flush() -> None:
        text = SPACES.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped:
            block = item.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            if item.tag == "br":
                run.append(" ")
            todo += reversed(item.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    body = next((c for c in builder.root.children if isinstance(c, Node) and c.tag == "body"), builder.root)
    _drop_named(body)
    return "\n".join(blocks(_chosen(body)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages` (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
