"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Possessive, so that unclosed tags cost no second look; an unclosed quotation mark is an ordinary character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag of these closes an open p.
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "legend"}
#: Elements whose text is not part of the page's prose.
HIDDEN = frozenset("head script style noscript template iframe svg button select option textarea input dialog object canvas audio video map title".split())
#: Elements beside an article. These, and the marks below, are looked at where the text is chosen, inside the subtree that density has found.
BESIDE = frozenset("nav footer header aside form menu".split())
#: Words of a class, id or role that mark blocks beside the article, and words that say nothing either way: a name is a mark if all its words are of these, one of the first kind. Paragraphs, headings
#: and cells are marked by the third kind only. A mark counts only if the block holds no article or main element, not half of all text with an h1, and not nearly all text; likewise a form.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus footer gdpr header masthead menu nav navbar navigation modal newsletter notice notices pagination pager popup promo promoted promotion promotions recommend recommended recommendations related remark replies reply respond share sharing sidebar side skip social sponsor sponsored subscribe subscription tag tags toolbar widget widgets complementary contentinfo search alert".split())
NEUTRAL = frozenset("site page top bottom left right global primary secondary block box area section wrapper container inner outer list item items link links post posts article articles story stories content unit slot bar form button buttons icon icons text title policy cloud media main the and for to".split())
STRONG = frozenset("ad ads advert adverts advertisement sponsored sponsor cookie cookies copyright comment comments newsletter promo".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote figure figcaption dd dt".split())
WORDS = re.compile(r"[A-Za-z]+")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """hidden: no prose; beside: an element or mark that says it is beside the article; marked: what says so can be overruled."""

    __slots__ = ("tag", "kids", "hidden", "beside", "marked", "depth", "holds", "chars", "tags", "link_chars", "link_tags", "score", "sum", "up")

    def __init__(self, tag: str, up: Node | None, hidden: bool = False, beside: bool = False, marked: bool = False):
        self.tag, self.up, self.hidden, self.beside, self.marked, self.kids = tag, up, hidden, beside, marked, []
        self.depth = up.depth + 1 if up else 0


def is_mark(value: str, words: frozenset = MARKS) -> bool:
    for name in value.split():
        found = {w.lower() for w in WORDS.findall(name)}
        if found & words and found <= MARKS | NEUTRAL:
            return True
    return False


#: Elements that a start tag closes if they are open nearer than the stops.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


def parse(page: str) -> Node:
    """A tolerant tree: kids are nodes or strings; p, li, dd, dt, tr, td, th and option close themselves; stray end tags are passed over.

    Open elements are kept by tag, so what a tag closes is found without a walk: the work is that of the page's length.
    """
    root = Node("#root", None)
    at, now, n = 0, root, len(page)
    opened: defaultdict[str, list[Node]] = defaultdict(list)
    blocks: list[Node] = []

    def close(to: Node) -> Node:
        x = now
        while True:
            opened[x.tag].pop()
            if x.tag in BLOCK:
                blocks.pop()
            if x is to:
                return x.up
            x = x.up

    nearest = lambda tags: max((opened[t][-1] for t in tags if opened[t]), key=lambda x: x.depth, default=None)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            now.kids.append(page[at:])
            break
        if m.start() > at:
            now.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            to = nearest((tag,))
            # an inline end tag does not close blocks
            if to is not None and (tag in BLOCK or not blocks or blocks[-1].depth < to.depth):
                now = close(to)
            continue
        if tag in CLOSES_P and blocks and blocks[-1].tag == "p":
            now = close(blocks[-1])
        if tag in CLOSES:
            same, stop = map(nearest, CLOSES[tag])
            if same is not None and (stop is None or same.depth > stop.depth):
                now = close(same)
        hidden, beside, marked = tag in HIDDEN, tag in BESIDE, tag == "form"
        if not hidden and m[3]:
            for name, a, b, c in ATTR.findall(m[3]):
                name, value = name.lower(), a or b or c
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    hidden = marked = True
                elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and is_mark(value, STRONG if tag in PARAGRAPHS else MARKS):
                    beside = marked = True
        node = Node(tag, now, hidden, beside, marked)
        now.kids.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and (tag in BLOCK or not m[3].rstrip().endswith("/")):  # <div/> opens a div in HTML
            now = node
            opened[tag].append(node)
            if tag in BLOCK:
                blocks.append(node)
    return root


def measure(root: Node) -> Node:
    """Composite text density of each node, and the sums of its children's; returns body, or the root without one.

    chars and tags count text and elements below a node, link_chars and link_tags those of links; hidden text counts for nothing.
    Density = C/T * log base ln(C/(C-L) * L + Lb/Cb * C + e) of (C/L) * (T/Lt), with C characters, T tags, L and Lt those of
    links, Lb and Cb of body. A header that holds the h1 of an article or main element is part of it.
    """
    order, stack, body = [], [root], None
    while stack:
        x = stack.pop()
        order.append(x)
        if x.tag == "body" and body is None:
            body = x
        stack += [k for k in x.kids if type(k) is Node]
    everything = sum(len(k) for x in order if x.tag not in RAW for k in x.kids if type(k) is str and not k.isspace())
    for x in reversed(order):  # a mark on a wrapper of the whole article, or of nearly all text, says nothing
        x.holds = max([2 if x.tag in ("article", "main") else x.tag == "h1", *(k.holds for k in x.kids if type(k) is Node)])
        x.sum = sum(k.sum if type(k) is Node else len(k) if not k.isspace() else 0 for k in x.kids) if x.tag not in RAW else 0
        if x.marked and (x.holds == 2 or x.sum > (0.5 if x.holds else 0.9) * everything):
            x.hidden = x.hidden and x.tag in HIDDEN
            x.beside = False
    inside: set[int] = set()
    for x in order:
        if x.tag in ("article", "main") or x.up is not None and id(x.up) in inside:
            inside.add(id(x))
            if x.tag == "header" and x.holds and not x.marked:
                x.beside = False
    for x in reversed(order):
        c = t = lc = lt = 0
        for k in x.kids:
            if type(k) is Node:
                c, t, lc, lt = c + k.chars, t + k.tags + 1, lc + k.link_chars, lt + k.link_tags
            else:
                c += len(k) - k.count(" ") if not k.isspace() else 0
        if x.tag in RAW or x.hidden:
            c = t = lc = lt = 0
        if x.tag == "a":
            lc, lt = c, t + 1
        x.chars, x.tags, x.link_chars, x.link_tags = c, t, lc, lt
    body = body or root
    share = body.link_chars / max(body.chars, 1)
    for x in reversed(order):
        x.score = density(x.chars, x.tags, x.link_chars, x.link_tags, share)
        x.sum = sum(k.score for k in x.kids if type(k) is Node)
    return body


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density of C characters, T tags, L and Lt those of links; share is Lb/Cb of body."""
    if not c or c == lc:
        return 0.0
    t = max(t, 1)
    base = math.log(c / (c - lc) * lc + share * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(base, 1e-9)


#: A block beside the densest that has this share of its plain text belongs to the article, too.
PARALLEL = 0.25


def densest(body: Node) -> Node:
    """The node with the largest sum of its children's densities, the first in page order of equals."""
    best, stack = body, [body]
    while stack:
        x = stack.pop()
        if x.sum > best.sum:
            best = x
        stack += [k for k in reversed(x.kids) if type(k) is Node and not k.hidden]
    return best


def main_node(root: Node) -> tuple[Node, float]:
    """The subtree that holds the article, and the threshold: the smallest density on the path from the densest node to body.

    The densest node is raised to an ancestor that has another block as dense as the threshold and not much shorter, or a heading of the
    first rank that it lacks, or that is the article or main element around it.
    """
    body = measure(root)
    top = x = densest(body)
    threshold = x.score
    plain = max(x.chars - x.link_chars, 1)
    while x is not body:
        below, x = x, x.up
        threshold = min(threshold, x.score)
        others = [k for k in x.kids if type(k) is Node and k is not below and not k.hidden and not k.beside]
        if x.tag in ("article", "main") or any(k.holds == 1 and not top.holds or k.score >= threshold and k.chars - k.link_chars >= PARALLEL * plain for k in others):
            top = x
    return top, threshold


def _walk(x: Node) -> Iterator[Node]:
    stack = [x]
    while stack:
        y = stack.pop()
        yield y
        stack += [k for k in y.kids if type(k) is Node]


def text_of(top: Node, threshold: float = 0.0) -> str:
    """Blocks in page order, one a line; white space inside a block is one space.

    Left out are blocks under the threshold that are mostly links, hidden ones, and those that an element or a mark puts beside the article. Short plain blocks stay.
    """
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        t = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if t:
            blocks.append(t)
        run.clear()

    stack: list = [iter((top,))]
    closing: list[bool] = [False]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            if closing.pop():
                end()
        elif type(k) is str:
            run.append(k)
        elif k is not top and (k.hidden or k.beside or k.tag in BLOCK and k.score < threshold and 2 * k.link_chars > k.chars) or k.tag in RAW:
            if k.tag in BLOCK:
                end()
        elif k.tag == "br":
            run.append(" ")
        else:
            block = k.tag in BLOCK
            if block:
                end()
            stack.append(iter(k.kids))
            closing.append(block)
    end()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(*main_node(parse(page))) if page else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    A null page is empty; an empty page, or one without main text, gives "". Null ids and urls stay,
    repeated rows are all returned, pages are of any length, other columns are not carried. Pages
    are independent: one pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    plain = df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    kinds = dict(plain.dtypes)
    return plain.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
