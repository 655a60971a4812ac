"""Main text of web pages by wrapper induction (operator 9).

For every host and layout (the tags that lead to the article) two pages with content are references.  Each
page's DOM tree is aligned with both by simple tree matching: matched nodes have equal tags and matched
parents, order among siblings is kept, and the matching with the most equal text blocks wins.  Counts
over all pages of the host then tell the nodes whose text is the same nearly everywhere (the template)
from the slots whose text varies (the content).  Regions that HTML itself names as no content (menus,
footers, forms, adverts, comments by tag, role or class) are cut before; a host with too few pages for
a template relies on them alone.  A form, header, role or name cuts no region that holds the article, and a
heading that all pages share stays where text of the article follows it.

The matching is exact at any size and depth.  Lists of single blocks are matched as a longest common
subsequence with bit vectors, other siblings as the heaviest chain of pairs that share text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshore.llm.common import text_batches, written

#: a node is template if its text is the same in this share of at least so many pages of the host
SAME_SHARE, LEAST_PAGES = 0.9, 5
#: slots that are the same on at most this share of the pages vary; a page that repeats more than this share of the
#: varying slots (of all slots, if none varies) is a copy of the reference's article and doesn't count
COPY_SHARE = 0.5
#: references of a host and layout
REFERENCES = 2
#: rows of bit vectors that a longest common subsequence keeps at a time, in bits
KEPT_BITS = 1 << 24
#: references of so many bytes together go to every task; beyond it pages are joined with them by host
SENT_BYTES = 32_000_000
#: a host of more layouts has its pages' layouts found before their references are joined
MOST_LAYOUTS = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select")
DROP = frozenset((*RAW, "nav", "footer", "aside", "form", "button", "head", "menu", "dialog", "object", "canvas",
                  "audio", "video", "map", "math"))
BLOCK = frozenset(("address article aside blockquote body caption center dd details div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
#: what can stand in a head besides the elements read whole; anything else ends it, with or without an end tag
IN_HEAD = frozenset("base basefont bgsound head html link meta".split()) | {"script", "style", "noscript", "template", "title"}
#: an opening tag ends an open element of these names, up to the given bounds
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: words of class and id names that mark a region as no part of the article
NO_CONTENT = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer "
    "masthead topbar toolbar comment comments disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip "
    "search copyright").split())

#: a name with one of these tells of a page's state (has-sidebar, no-comments), not of a region
STATES = frozenset("has no not with without is hide show enable enabled disable disabled open closed".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: of these names inside an article, sections stay unless most of their text is links
OFTEN_TEXT = frozenset(("related", "recommended"))
#: of inline elements, only these go by their names
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())

#: class names of article elements that are none
NO_ARTICLE = frozenset("ad advert advertisement comment promo related reply sponsored teaser".split())

#: a header of these is the article's own
OF_ARTICLE = frozenset("article post entry content story".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}
SPACE = re.compile(r"\s+")
NAME_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element, or a block of text (tag '#'); ``key`` is what has to agree for two nodes to match."""
    __slots__ = ("tag", "kids", "text", "out", "why", "anchor", "print", "nodes", "keys", "flat", "size", "linked", "holds")

    def __init__(self, tag: str, out: bool = False, text: str = "", why: str = "", anchor: str = ""):
        self.tag, self.kids, self.text, self.out, self.why, self.anchor = tag, [], text, out, why, anchor
        # hash and number of the nodes below, hashes of the texts below, and whether it is or holds one block only
        self.print, self.nodes, self.keys, self.flat = 0, 1, frozenset(), False
        # text and linked text below, whether an article is there
        self.size, self.linked, self.holds = len(text), 0, tag in ("article", "main") and not why


def _no_content(tag: str, attrs: str, in_article: bool) -> tuple[str, str]:
    """Why an element is no content: '' if it is, 'sure', 'region' unless it holds the article, 'name' (see settle),
    'links' if most of it is linked text, or 'anchor' if only its id says so, which comes along."""
    why, anchor = "", ""
    if tag in DROP or tag == "header" and not in_article:
        why = "region" if tag in ("form", "header") else "sure"
    if why == "sure" or not attrs or tag in ("html", "body", "main"):
        return why, anchor
    if tag == "article":       # (class names of articles also tell their categories, so only whole names count)
        names = [v.strip("\"'").lower().split() for n, v in ATTR.findall(attrs) if n.lower() == "class"]
        return "name" * any(not NO_ARTICLE.isdisjoint(x) for x in names), anchor
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "sure", ""
        if name == "role" and value in NO_CONTENT_ROLES:
            why = "region"
        # ids of headings, inline elements and an article's sections are where links lead to
        if name == "class" or name == "id" and tag in BLOCK and tag not in HEADINGS and not (tag == "section" and in_article):
            found = [w for part in value.split() if STATES.isdisjoint(ws := NAME_WORD.findall(part)) for w in ws]
            if in_article and tag == "section" and OFTEN_TEXT.issuperset(NO_CONTENT.intersection(found)) and not OFTEN_TEXT.isdisjoint(found):
                why = why or "links"
            elif not NO_CONTENT.isdisjoint(found) or "header" in found and not in_article and OF_ARTICLE.isdisjoint(found):
                if name == "class":
                    why = why or "name"
                else:
                    anchor = value
    return why or "anchor" * bool(anchor), anchor


def _inline_advert(tag: str, attrs: str) -> bool:
    """Whether an inline element goes: it is hidden, or its class says that it is an advert."""
    if _no_content(tag, attrs, True)[0] == "sure":
        return True
    return any(name.lower() == "class" and not ADVERTS.isdisjoint(NAME_WORD.findall(value.lower())) for name, value in ATTR.findall(attrs))


def settle(root: Node) -> Node:
    """Marks out what is no content, with all below it.

    No element that holds an article or main element goes by its tag, role or name; none goes by its name that has
    most of the page's text, where the article is in no other element; and none by an id that repeats the
    element's heading.  What stays so is left to the template.
    """
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.kids
    for x in reversed(order):
        for k in x.kids:
            if k.why != "sure":
                x.size += k.size
                x.linked += k.linked
                x.holds = x.holds or k.holds
    total, anywhere = root.size, root.holds
    todo2 = [(root, False, False)]
    while todo2:
        x, out, inside = todo2.pop()
        if x.why == "sure":
            out = True
        elif x.why == "links":
            out = out or 2 * x.linked > x.size
        elif x.why and not x.holds:
            most = 2 * x.size > total and (inside or not anywhere)
            if x.why == "region" or not most and not (x.why == "anchor" and _repeats_heading(x, inside)):
                out = True
        x.out = out and x.tag != "body"
        if x.kids:
            inside = inside or x.tag in ("article", "main")
            todo2 += [(k, x.out, inside) for k in x.kids]
    return root


def _prints(root: Node) -> None:
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.kids
    for x in reversed(order):
        kids = [k for k in x.kids if not k.out]
        x.print = hash((x.tag, x.text, *(k.print for k in kids)))
        x.nodes = 1 + sum(k.nodes for k in kids)
        x.keys = frozenset((x.print,)) if x.tag == "#" else frozenset().union(*(k.keys for k in kids))
        x.flat = x.tag == "#" or len(kids) == 1 and kids[0].tag == "#"


def _repeats_heading(node: Node, inside: bool) -> bool:
    """Whether the id is made of the element's first heading; of one word it counts inside an article only."""
    words = NAME_WORD.findall(node.anchor)
    if not inside and NO_CONTENT.issuperset(words):
        return False
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            return NAME_WORD.findall(" ".join(k.text for k in x.kids).lower())[:len(words)] == words
        todo += reversed(x.kids)
    return False


def parse(html: str) -> Node:
    """The tree of a page; inline elements dissolve into the text blocks around them."""
    root = Node("#root")
    stack, text, pos, n = [root], [], 0, len(html)
    linked, in_link = 0, False

    def flush():
        nonlocal linked
        if text:
            t = SPACE.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if t:
                stack[-1].kids.append(Node("#", text=t))
                stack[-1].kids[-1].linked = min(linked, len(t))
            linked = 0

    def pop_to(i):
        flush()
        del stack[i:]

    in_article = 0
    while pos < n:
        m = TOKEN.match(html, pos)
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            t = m.group()
            if t[:2] not in ("<!", "<?"):
                if stack[-1].tag == "head" and t.strip():
                    pop_to(len(stack) - 1)
                text.append(t)
                if in_link:
                    linked += len(t)
            continue
        if not m.group().endswith(">"):
            break  # cut off inside a tag
        tag = tag.lower()
        if tag == "a":
            in_link = not m.group(1)
        if m.group(1):  # closing
            if tag in BLOCK or tag in DROP:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        in_article -= sum(x.tag in ("article", "main") for x in stack[i:])
                        pop_to(i)
                        break
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                flush() if tag == "hr" else text.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, pos)
            pos = end.end()
            continue
        if tag not in BLOCK and tag not in DROP:
            if m.group(3) and _inline_advert(tag, m.group(3)):
                # goes up to its own end; one without an end before the block's is no element to cut
                close = re.compile(rf"</({re.escape(tag)})\s*>|</?(?:article|main|body|div|p|section|li|td)\b", re.I).search(html, pos)
                if close and close.group(1):
                    flush()
                    pos = close.start()
            continue
        if tag in CLOSES_P or tag == "p":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag not in ("p", "#"):
                    break
        if tag in SIBLINGS:
            ends, bounds = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    pop_to(i)
                    break
        flush()
        why, anchor = _no_content(tag, m.group(3), in_article > 0)
        node = Node(tag, why=why, anchor=anchor)
        in_article += tag in ("article", "main")
        stack[-1].kids.append(node)
        stack.append(node)
    flush()
    return settle(root)


def _length(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if not x.out:
            total += len(x.text)
            todo += x.kids
    return total


def article(root: Node) -> Node:
    """All articles of the page (the outermost ones) with the h1 that stands beside them in a main element; without
    articles the largest main element, or else the page."""
    articles, mains, titles = [], [], []
    todo = [(root, False)]
    while todo:
        x, in_main = todo.pop()
        if x.out:
            continue
        if x.tag == "article":
            articles += [x] if _length(x) else []
            continue
        if x.tag == "main":
            mains.append(x)
            in_main = True
        if x.tag == "h1" and in_main:
            titles.append((len(articles), x))
            continue
        todo += [(k, in_main) for k in reversed(x.kids)]
    if len(articles) == 1 and not titles:
        return articles[0]
    if articles:
        whole = Node("article")
        for k, x in enumerate((*articles, None)):
            whole.kids += [t for at, t in titles if at == k] + ([x] if x else [])
        return whole
    best = max(mains, key=_length, default=None)
    return best if best is not None and _length(best) else root


def layout(root: Node, main: Node) -> str:
    """The tags from the root to the article (its first part, if it has several), without html and body, whose tags
    are optional."""
    first = main.kids[0] if main.kids and main.tag == "article" and main.kids[0].tag in ("article", "h1") else main
    todo = [(root, "")]
    while todo:
        x, path = todo.pop()
        path = path if x.tag in ("html", "body") else f"{path}/{x.tag}"
        if x is main:
            return path
        if x is first:
            return path.rpartition("/")[0] + "/article"
        todo += [(k, path) for k in x.kids if k.tag != "#" and not k.out]
    return ""


def blocks(node: Node) -> list[Node]:
    """The text blocks of content regions in page order."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.out:
            continue
        if x.tag == "#":
            out.append(x)
        todo += reversed(x.kids)
    return out


def common_subsequence(xs: list, ys: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.

    Rows of bit vectors (a bit for each y) take a few machine words for 64 places each; lists whose rows would not fit
    are halved at the row where the two halves' lengths add up to the most.
    """
    if not xs or not ys or set(xs).isdisjoint(ys):
        return []
    if len(xs) * len(ys) <= KEPT_BITS or len(xs) == 1:
        rows = _rows(xs, ys)
        out, j = [], len(ys)
        for i in range(len(xs) - 1, -1, -1):
            # down to the least prefix of ys that gives this row's length; it ends in a pair if the row above has less
            prefix = (1 << j) - 1
            length = j - (rows[i + 1] & prefix).bit_count()
            if length == j - (rows[i] & prefix).bit_count():
                continue
            while j and (j - 1) - (rows[i + 1] & ((1 << (j - 1)) - 1)).bit_count() == length:
                j -= 1
            j -= 1
            out.append((i, j))
        return out[::-1]
    mid, n = len(xs) // 2, len(ys)
    ahead = _lengths(_rows(xs[:mid], ys, last=True)[0], n)
    behind = _lengths(_rows(xs[mid:][::-1], ys[::-1], last=True)[0], n)[::-1]
    cut = max(range(n + 1), key=lambda j: ahead[j] + behind[j])
    return common_subsequence(xs[:mid], ys[:cut]) + [(i + mid, j + cut) for i, j in common_subsequence(xs[mid:], ys[cut:])]


def _rows(xs: list, ys: list, last: bool = False) -> list[int]:
    """Bit vectors of the lengths' differences along ys after 0, 1, ... entries of xs (a zero bit is a step)."""
    places: dict = {}
    for j, y in enumerate(ys):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(ys)) - 1
    row, rows = full, [full]
    for x in xs:
        hit = row & places.get(x, 0)
        row = (row + hit | row & ~hit) & full
        if last:
            rows[0] = row
        else:
            rows.append(row)
    return rows


def _lengths(row: int, n: int) -> list[int]:
    out = [0]
    for j in range(n):
        out.append(out[-1] + (not row >> j & 1))
    return out


def _chain(weights: dict[tuple[int, int], int], n: int) -> list[tuple[int, int]]:
    """The heaviest series of pairs that ascends on both sides (a Fenwick tree of the best ends so far)."""
    best: list[tuple[int, tuple | None]] = [(0, None)] * (n + 1)
    by_row: dict[int, list[int]] = {}
    for i, j in weights:
        by_row.setdefault(i, []).append(j)
    for i in sorted(by_row):
        found = []
        for j in by_row[i]:
            top, at = (0, None), j
            while at:
                if best[at][0] > top[0]:
                    top = best[at]
                at &= at - 1
            found.append((j, top[0] + weights[i, j], (i, j, top[1])))
        for j, weight, link in found:            # after the row, so that a row gives one pair
            at = j + 1
            while at <= n:
                if weight > best[at][0]:
                    best[at] = (weight, link)
                at += at & -at
    link = max(best, key=lambda b: b[0])[1]
    out = []
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


Matching = tuple[int, int, list[tuple[Node, Node]]]     # equal texts, matched nodes, matched text blocks in order


def _match(a: Node, b: Node) -> Matching:
    """The best matching of two nodes of one tag."""
    nodes = 0
    front: list[tuple[Node, Node]] = []          # equal blocks before and behind what is looked at
    back: list[tuple[Node, Node]] = []
    while True:
        if a.print == b.print:
            same = front + list(zip(blocks(a), blocks(b))) + back
            return len(same), nodes + a.nodes, same
        nodes += 1
        if a.tag == "#":
            return len(front) + len(back), nodes, front + [(a, b)] + back
        xs, ys = [k for k in a.kids if not k.out], [k for k in b.kids if not k.out]
        # equal subtrees at both ends belong to some best matching
        most, first, last = min(len(xs), len(ys)), 0, 0
        while first < most and xs[first].print == ys[first].print:
            front += zip(blocks(xs[first]), blocks(ys[first]))
            first += 1
        while last < most - first and xs[-1 - last].print == ys[-1 - last].print:
            back = [*zip(blocks(xs[-1 - last]), blocks(ys[-1 - last])), *back]
            last += 1
        nodes += sum(x.nodes for x in (*xs[:first], *xs[len(xs) - last:]))
        xs, ys = xs[first:len(xs) - last], ys[first:len(ys) - last]
        if len(xs) == len(ys) == 1 and xs[0].tag == ys[0].tag:
            a, b = xs[0], ys[0]                  # no recursion along single children
            continue
        found = _siblings(xs, ys)
        return len(front) + len(back) + found[0], nodes + found[1], front + found[2] + back


def _siblings(xs: list[Node], ys: list[Node]) -> Matching:
    """Pairs that share text make the heaviest chain; what stands between them matches in order, by tags."""
    found: dict[tuple[int, int], Matching] = {}
    if all(x.flat for x in xs) and all(y.flat for y in ys):      # such share their one text, or nothing
        chain = common_subsequence([x.print for x in xs], [y.print for y in ys])
    else:
        holders: dict = {}
        for j, y in enumerate(ys):
            for key in y.keys:
                holders.setdefault((y.tag, key), []).append(j)
        for i, x in enumerate(xs):
            for j in {j for key in x.keys for j in holders.get((x.tag, key), ())}:
                match = _match(x, ys[j])
                if match[0]:
                    found[i, j] = match
        # equal texts count first, then matched nodes
        above = 1 + sum(x.nodes for x in xs)
        chain = _chain({ij: m[0] * above + m[1] for ij, m in found.items()}, len(ys))
    equal = nodes = i0 = j0 = 0
    pairs: list[tuple[Node, Node]] = []
    for i, j in (*chain, (len(xs), len(ys))):
        gap = [(i0 + p, j0 + q) for p, q in common_subsequence([x.tag for x in xs[i0:i]], [y.tag for y in ys[j0:j]])]
        for p, q in gap + [(i, j)] * (i < len(xs)):
            more = found.get((p, q)) or _match(xs[p], ys[q])
            equal, nodes = equal + more[0], nodes + more[1]
            pairs += more[2]
        i0, j0 = i + 1, j + 1
    return equal, nodes, pairs


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two nodes of one tag: matched nodes, and the matched pairs of text blocks."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))        # trees may be deep
    for x in (a, b):
        if not x.print:
            _prints(x)
    return _match(a, b)[1:]


def matched_blocks(main: Node, references: list[Node]) -> tuple[list[tuple[list[int], str, bool]], list[tuple[int, list[int]]]]:
    """Content blocks as (slots of the same text, text, whether it is a heading), and each reference's such slots.

    In the blocks a slot is numbered with its reference: ``reference << 32 | slot``.
    """
    own = blocks(main)
    headings = _heading_blocks(main)
    slots: dict[int, list[int]] = {id(x): [] for x in own}
    aligned = []
    for k, reference in enumerate(references):
        number = {id(x): i for i, x in enumerate(blocks(reference))}
        found = align(reference, main)[1]
        same = [(number[id(r)], x) for r, x in found if r.text == x.text]
        for slot, x in same:
            slots[id(x)].append(k << 32 | slot)
        if found:
            aligned.append((k, [slot for slot, _ in same]))
    return [(slots[id(x)], x.text, id(x) in headings) for x in own], aligned


def _heading_blocks(main: Node) -> set[int]:
    out, todo = set(), [main]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            out.update(id(b) for b in blocks(x))
        else:
            todo += x.kids
    return out


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
LAID_OUT = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("html", T.StringType()), T.StructField("layout", T.StringType())])
PARTS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("layout", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("same", T.ArrayType(T.LongType())), T.StructField("text", T.StringType()),
        T.StructField("heading", T.BooleanType()), T.StructField("section", T.IntegerType())]))),
    T.StructField("aligned", T.ArrayType(T.StructType([
        T.StructField("ref", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType()))])))])
_BLOCKS = pa.list_(pa.struct([("same", pa.list_(pa.int64())), ("text", pa.string()), ("heading", pa.bool_()), ("section", pa.int32())]))
_ALIGNED = pa.list_(pa.struct([("ref", pa.int32()), ("slots", pa.list_(pa.int32()))]))


def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the layout of each page; null if it has no content."""
    for b in batches:
        found = []
        for html in b.column(3).to_pylist():
            root = parse(html)
            main = article(root)
            found.append(layout(root, main) if blocks(main) else None)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(found, pa.string())], names=LAID_OUT.names)


def templates(parts: DataFrame) -> DataFrame:
    """h, l, constant: the slots of a host's and layout's references that are template."""
    key = ["host", "layout", "ref"]
    pairs = parts.select("host", "layout", F.explode("aligned").alias("a")).select("host", "layout", "a.*")
    pages = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    slots = pairs.select(*key, F.explode("slots").alias("slot")).groupBy(*key, "slot").agg(F.count(F.lit(1)).alias("n"))
    varies = F.col("n") <= F.col("pages") * F.lit(COPY_SHARE)
    # the reference is one of the pages, so every slot is counted
    judged = written(slots.join(pages, key).groupBy(*key).agg(
        F.collect_list(F.when(varies, F.col("slot"))).alias("varying"), F.count(F.lit(1)).alias("total")), "wrapper-slots")
    few = F.when(F.size("varying") > 0, F.size(F.array_intersect("slots", "varying")) <= F.size("varying") * F.lit(COPY_SHARE))
    counted = pairs.join(judged, key).filter(few.otherwise(F.size("slots") <= F.col("total") * F.lit(COPY_SHARE)))
    enough = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    same = counted.select(*key, F.explode("slots").alias("slot")).groupBy(*key, "slot").agg(F.count(F.lit(1)).alias("n"))
    slot = F.shiftleft(F.col("ref").cast("long"), 32) + F.col("slot")
    return written(same.join(enough, key).filter(F.col("n") >= F.col("pages") * F.lit(SAME_SHARE))
                   .groupBy(F.col("host").alias("h"), F.col("layout").alias("l")).agg(F.collect_set(slot).alias("constant")),
                   "wrapper-templates")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    ``text`` joins the article's blocks by a newline; it is empty if there is none.  Null html is an empty
    page.  Pages whose url has no host (null, relative) form one group.  Repeated rows get equal results;
    references are drawn by hash.  An empty table gives an empty result.
    Other columns are not read.
    """
    text_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    laid = base.mapInArrow(lay_out, LAID_OUT)
    # references by hash, so that they do not follow the ids; two longs, combined on the map side
    draw = F.xxhash64("page_id", "url", "html")
    drawn = written(laid.filter(F.col("layout").isNotNull()).select("host", "layout", draw.alias("draw"))
                    .groupBy("host", F.col("layout").alias("l"), F.pmod("draw", F.lit(REFERENCES)).alias("k"))
                    .agg(F.min("draw").alias("draw"), F.count(F.lit(1)).alias("n")), "wrapper-drawn")
    many = drawn.groupBy("host", "l").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", "l")
    first = drawn.join(many, ["host", "l"]).select("host", "l", "draw")
    refs = written(base.withColumn("draw", draw).join(first, ["host", "draw"]).groupBy(F.col("host").alias("h"), "l", "draw")
                   .agg(F.min("html").alias("html")).groupBy("h", "l")
                   .agg(F.array_sort(F.collect_list("html")).alias("references")), "wrapper-references")
    entry = F.struct("l", "references")
    several = written(refs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_LAYOUTS).select("h"), "wrapper-several")
    by_host = written(refs.join(several, "h", "left_anti").groupBy("h").agg(F.collect_list(entry).alias("references")), "wrapper-by-host")
    by_layout = written(refs.join(several, "h", "left_semi").select("h", "l", F.array(entry).alias("references")), "wrapper-by-layout")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        for b in batches:
            ids, urls, hosts, htmls, references = (b.column(i) for i in range(5))
            layouts, found, aligned = [], [], []
            for html, refs in zip(htmls.to_pylist(), references.to_pylist()):
                root = parse(html)
                main = article(root)
                path = layout(root, main)
                own = next((r["references"] for r in refs or () if r["l"] == path), [])
                if len(trees) >= 256:
                    trees.clear()
                for ref in own:
                    if ref not in trees:
                        trees[ref] = article(parse(ref))
                out, at = matched_blocks(main, [trees[ref] for ref in own])
                layouts.append(path)
                numbers = accumulate(int(heading) for _, _, heading in out)
                found.append([{"same": s, "text": t, "heading": h, "section": k} for (s, t, h), k in zip(out, numbers)])
                aligned.append([{"ref": k, "slots": s} for k, s in at])
            yield pa.RecordBatch.from_arrays([ids, urls, hosts, pa.array(layouts, pa.string()), pa.array(found, _BLOCKS),
                                              pa.array(aligned, _ALIGNED)], names=PARTS.names)

    # no page takes the references of many layouts along
    size = refs.agg(F.sum(F.aggregate("references", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    sent = F.broadcast if size <= SENT_BYTES else lambda df: df
    at_host = F.col("host") == F.col("h")
    columns = ("page_id", "url", "host", "html", "references")
    both = base.join(several, at_host, "left_anti").join(sent(by_host), at_host, "left").select(*columns)
    if several.take(1):
        some = base.join(several, at_host, "left_semi").mapInArrow(lay_out, LAID_OUT)
        both = both.union(some.join(sent(by_layout), at_host & (F.col("layout") == F.col("l")), "left").select(*columns))
    parts = written(both.mapInArrow(match, PARTS), "wrapper-blocks")
    done = parts.join(templates(parts), (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")), "left")
    # a heading goes with the template if all below it, up to the next one, is template too
    constant = lambda b: F.coalesce(F.arrays_overlap(b["same"], F.col("constant")), F.lit(False))
    done = done.withColumn("live", F.transform(F.filter("blocks", lambda b: ~b["heading"] & ~constant(b)), lambda b: b["section"]))
    slots = F.filter("blocks", lambda b: ~constant(b) | (b["heading"] & F.array_contains("live", b["section"])))
    return done.select("page_id", "url", F.array_join(F.transform(slots, lambda b: b["text"]), "\n").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
