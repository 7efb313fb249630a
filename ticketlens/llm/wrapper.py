"""HTML main text by wrapper induction (operator 10).

Pages of one host are aligned as DOM trees by simple tree matching: two nodes
match if their labels (tag and class) do, their children are aligned in order
so that the matched weight is greatest, equal own text weighing double, however
wide the pages are. Equal children at both ends are matched first; the table of
what is left between is held whole up to ``EXACT_CELLS`` pairs of children. Of a
larger one only some rows are held and the others made again on the way back:
the same match in little memory, in time that grows with the product of the two
numbers of children. Each
host has one reference page (the one nearest to the host's mean size), and so
has each of its layouts (pages with the same outer elements) if it has several.
A reference node that is matched with the same text on most of the different
pages of the host, or of the layout, is template; the slots whose text varies
are content, as far as they lie in the main part: inside article or main if the page has one, and not
inside menus, headers, footers, asides, forms, adverts, notices or comments
(told by element or by class, id and role). A class or id does not speak for an
article or main inside: it may be the page's wrapper ("content with-sidebar").
Only where a whole class or id says so ("comments", "related") do the articles
inside stay out, and only if the page has main text elsewhere.

Pages are parsed once for their layout (on hosts with several layouts once more)
and once for their blocks: the blocks of a page with the reference nodes they
match are written as a table, nodes are counted per host and layout by
aggregation, and the template nodes are taken out by a join. References travel by broadcast while
their measured size allows, else by a join on the host.

Cases: null or empty html gives an empty text; broken markup (unclosed or
crossed tags, unclosed comments or quotes) is read leniently in linear time; of
an unclosed svg, object, noscript and the like only the tag is skipped; a
host with too few different pages has no template; a page all of whose blocks
are template keeps them; null urls form one host; repeated pages count once as
evidence and are all returned; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import process_cache, written

#: A node is template on a host with at least so many different pages ...
MIN_PAGES = 4
#: ... if at least this share (percent) of them carry it unchanged.
TEMPLATE_PERCENT = 60
#: References are broadcast up to this size in bytes, measured before.
BROADCAST_BYTES = 48 << 20
#: Templates are broadcast up to so many nodes of all hosts (8 per host counted for its row).
BROADCAST_NODES = 4_000_000
#: The prints of the reference pages are broadcast up to this many hosts or layouts.
BROADCAST_HOSTS = 500_000
#: The table of a match is held whole up to so many pairs of children (the match is the same beyond it).
EXACT_CELLS = 100_000
#: A text on more nodes of the reference than this says little about which subtrees are worth a closer look.
_TELLING = 8
#: Matches of pairs of kinds that are remembered, and rows of weights.
_KNOWN, _ROWS_OF_WEIGHTS = 2_000_000, 64
#: Elements that make a layout, and how deep they are looked at in a page without article or main.
STRUCTURE = frozenset("html body div section article main table center".split())
LAYOUT_DEPTH = 5

# Fixed values of HTML: elements without content, raw text, blocks, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
CLOSE_SCOPE = frozenset("ul ol dl table article section div body html main nav aside header footer form td th li".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "li", "dt", "dd"} | {"li"}
#: Raw elements that may hold others of their name, and those that swallow the rest of the page if never closed.
NESTED = frozenset("object svg math template".split())
UNENDING = frozenset("script style textarea title".split())
#: Elements that never belong to the main text, and names that say so.
ASIDE = frozenset("head nav footer aside form button dialog menu".split()) | RAW
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer masthead topbar cookie cookies consent notice alert popup modal overlay newsletter "
    "subscribe share sharing social comment comments disqus related recommended widget toolbar pagination".split()
)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_TAG_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")

MAIN = frozenset(("article", "main"))

#: Why an element is aside: not at all, by a part of its class or id, by a whole one, by element or role.
NO, PART, WHOLE, SURE = range(4)


class Node:
    """An element: label, children in order, own text pieces (with their block), place and role.

    ``depth`` counts the elements around that are aside by a whole class or id.
    """

    __slots__ = ("tag", "label", "children", "text", "index", "aside", "parent", "main", "depth")

    def __init__(self, tag, label, parent, index, aside, main, depth=0):
        self.tag, self.label, self.parent, self.index = tag, label, parent, index
        self.children, self.text, self.aside, self.main, self.depth = [], "", aside, main, depth


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}


def _aside(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    if tag in ASIDE or (tag == "header" and not in_main):
        return SURE
    if not attributes:
        return NO
    role = attributes.get("role", "").lower()
    if role in ASIDE_ROLES or "hidden" in attributes:
        return SURE
    if tag in MAIN or tag in ("body", "html") or role == "main":
        return NO
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    if ASIDE_NAMES.isdisjoint(_NAME_PARTS.split(names)):
        return NO
    return PART if ASIDE_NAMES.isdisjoint(names.split()) else WHOLE


def parse(source: str) -> tuple[Node, list[tuple[Node, str]], int | None]:
    """(root, text pieces in page order with their element - a piece of None ends a block -, depth of the main parts).

    The depth is None if there is no main part.
    """
    root = Node("#root", 0, None, 0, NO, False)
    here, index, pieces, has_main = root, 0, [], False
    at, end, quotes = 0, len(source), True
    closes: dict[str, dict[int, int]] = {}
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not here.aside:
            pieces.append((here, source[at:lt]))
        if lt >= end:
            break
        nxt = source[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if source.startswith("<!--", lt):
                stop = source.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            else:
                stop = source.find(">", lt)
                at = end if stop < 0 else stop + 1
            continue
        name = _TAG_NAME.match(source, lt + 1)
        if name is None:  # a lone "<"
            if not here.aside:
                pieces.append((here, "<"))
            at = lt + 1
            continue
        rest = _TAG_REST.match(source, name.end()) if quotes else None
        if rest is None:
            quotes = False  # an unclosed quote somewhere: from here on tags end at the next ">"
            stop = source.find(">", name.end())
            if stop < 0:
                break
            at = stop + 1
        else:
            at = rest.end()
        tag = name[1].lower()
        if nxt == "/":
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            if tag in BLOCK:
                pieces.append((here, None))
            continue
        if tag in BLOCK:
            pieces.append((here, None))
        if tag in VOID:
            continue
        if tag in RAW:
            if tag in ("svg", "math") and source.startswith("/>", at - 2):
                continue  # closed in itself
            if tag not in closes:
                closes[tag] = _raw_ends(source, tag)
            close = closes[tag].get(lt)
            if close is None:
                if tag in UNENDING:
                    break
                continue  # never closed: the tag alone is skipped
            stop = source.find(">", close)
            at = end if stop < 0 else stop + 1
            continue
        if tag in CLOSES_P:
            here = _closed(here, root, ("p",))
        if tag in CLOSES:
            here = _closed(here, root, CLOSES[tag])
        body = source[name.end() : at - 1]
        attributes = _attributes(body) if "=" in body else {}
        index += 1
        opens = tag in MAIN or attributes.get("role", "").lower() == "main"
        main = here.main or opens
        has_main = has_main or main
        label = (tag, attributes.get("class", ""))
        own = _aside(tag, attributes, main)
        aside = own if opens and here.aside != SURE else max(here.aside, own)
        node = Node(tag, label, here, index, aside, main, here.depth + (own == WHOLE))
        here.children.append(node)
        if not body.endswith("/"):
            here = node
    for node, piece in pieces:
        if piece:
            node.text += piece
    if not has_main:
        return root, pieces, None
    return root, pieces, min((n.depth for n, piece in pieces if n.main and not n.aside and piece and not piece.isspace()), default=0)


def _raw_ends(source: str, tag: str) -> dict[int, int]:
    """Start of a raw element of this name -> end of the name in its close tag; starts never closed are left out."""
    out: dict[int, int] = {}
    opened: list[int] = []
    fresh = False  # inside the start tag opened last
    ends = "|/?>" if tag in ("svg", "math") else ""
    for m in re.compile(rf"<(/?){re.escape(tag)}(?![^\s/>]){ends}", re.I).finditer(source):
        if m[1] is None:
            if fresh and m[0] == "/>":
                opened.pop()
            fresh = False
        elif not m[1]:
            opened.append(m.start())
            fresh = True
        elif opened:
            fresh = False
            if tag in NESTED:
                out[opened.pop()] = m.end()
            else:
                out.update(dict.fromkeys(opened, m.end()))
                opened.clear()
    return out


def _closed(here: Node, root: Node, tags: tuple[str, ...]) -> Node:
    """``here`` after the open element of ``tags`` in scope, if any, has been closed."""
    node = here
    while node is not root:
        if node.tag in tags:
            here = node.parent
        elif node.tag in CLOSE_SCOPE:
            break
        node = node.parent
    return here


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


class _Matcher:
    """Simple tree matching of a page and its reference, by kinds of subtrees.

    Two subtrees are of one kind if label, text and the kinds of the children
    are equal; texts that the other page does not have say no more than that.
    A pair of kinds is matched once.
    """

    def __init__(self, page: Node, reference: Node, shared: set[str] | None = None):
        """``shared``: the texts that may be equal (default: all that both pages have)."""
        self.trees = trees = (_preorder(page), _preorder(reference))
        texts = [{n.text for n in tree} for tree in trees]
        self.coarse: _Matcher | None = None if shared is None else self
        self.shared = shared = texts[0] & texts[1] if shared is None else shared
        kinds: dict[tuple, int] = {}
        self.kind: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.size: list[int] = []
        self.label: list[tuple] = []
        self.text: list[object] = []
        self.below: list[tuple[int, ...]] = []
        for side, tree in enumerate(trees):
            of = self.kind[side]
            for node in reversed(tree):  # children come before their parent
                below = tuple(of[c.index] for c in node.children)
                text = node.text if node.text in shared else side
                k = kinds.setdefault((node.label, text, below), len(kinds))
                of[node.index] = k
                if k == len(self.size):
                    self.size.append(1 + sum(self.size[c] for c in below))
                    self.label.append(node.label)
                    self.text.append(text)
                    self.below.append(below)
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weight(self, a: int, b: int) -> int:
        """The weight of the match of two kinds: 2 per pair of nodes of equal text, 1 per other pair."""
        if a == b:
            return 2 * self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        return 1 + (self.text[a] == self.text[b]) + self.children(a, b)[0]

    def children(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """(weight, pairs of places) of the match of the children of two kinds."""
        if not self.below[a] or not self.below[b]:
            return 0, []
        if (a, b) not in self.known:
            pairs, total = self._aligned(self.below[a], self.below[b]), 0
            for i, j in pairs:  # no sum(): trees may be deeper than calls through built-ins may nest
                total += self.weight(self.below[a][i], self.below[b][j])
            if len(self.known) >= _KNOWN:
                self.known.clear()
            self.known[a, b] = total, pairs
            return total, pairs
        return self.known[a, b]

    def _aligned(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        # Equal children at both ends are part of some best match, so only what lies between is left to decide.
        n, m, head, tail = len(xs), len(ys), 0, 0
        while head < min(n, m) and xs[head] == ys[head]:
            head += 1
        while tail < min(n, m) - head and xs[n - 1 - tail] == ys[m - 1 - tail]:
            tail += 1
        wide = (n - tail - head) * (m - tail - head) > EXACT_CELLS
        middle = (self._best_wide if wide else self._best)(xs, ys, head, n - tail, head, m - tail)
        return [(i, i) for i in range(head)] + middle + [(n - i, m - i) for i in range(tail, 0, -1)]

    def _best(self, xs, ys, i0, i1, j0, j1) -> list[tuple[int, int]]:
        """The match of greatest weight, by a table of all pairs of places."""
        above = [0] * (j1 - j0 + 1)
        table = [above]
        for x in xs[i0:i1]:
            row, best = [0], 0
            for j, y in enumerate(ys[j0:j1]):
                w = self.weight(x, y)
                best = max(best, above[j + 1], above[j] + w if w else 0)
                row.append(best)
            table.append(row)
            above = row
        out, i, j = [], i1 - i0, j1 - j0
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i0 + i, j0 + j))
        return out[::-1]

    def _best_wide(self, xs, ys, i0, i1, j0, j1) -> list[tuple[int, int]]:
        """As ``_best``; of the table every so-many-th row is held, the others are made again from there on the way back."""
        import numpy as np

        add = self._weights(xs[i0:i1], ys[j0:j1])
        n, m = i1 - i0, j1 - j0

        def follow(above, i, row):
            end = len(row) - 1
            base, where, more, one, last = add(i)
            step = row[1:]
            inside = np.searchsorted(where, end)
            where = where[:inside]
            ahead = above[where] + base[where] + more[:inside]
            if not one:
                np.add(above[:end], base[:end], out=step)
                step[where] = ahead
                np.maximum(step, above[1 : end + 1], out=step)
                np.maximum.accumulate(step, out=step)
                return
            # All weights that are not 0 are the same, so the last of them tells the best: no running maximum.
            first = min(int(last[0]), end)
            np.take(above, last[1][first:end], out=step[first:], mode="clip")
            step[first:] += one
            step[:first] = 0
            np.maximum(step, above[1 : end + 1], out=step)
            for at, value in zip(where, ahead):
                if value > step[at]:
                    step[at : at + np.searchsorted(step[at:], value)] = value

        stride = max(1, int(n**0.5))
        held = np.zeros((-(-n // stride), m + 1), dtype=np.int32)
        rows = np.zeros((stride + 1, m + 1), dtype=np.int32)
        for i in range(n):
            if i % stride == 0:
                held[i // stride] = rows[i % 2]
            follow(rows[i % 2], i, rows[(i + 1) % 2])
        out, j = [], m
        for block in range(len(held) - 1, -1, -1):
            if not j:
                break
            first = block * stride
            table = rows[:, : j + 1]
            table[0] = held[block][: j + 1]
            for i in range(min(n - first, stride)):
                follow(table[i], first + i, table[i + 1])
            i = min(n - first, stride)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i0 + first + i, j0 + j))
        return out[::-1]

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]):
        """A function from a place in xs to (weights with all of ys as far as they are told by common texts, places in order,
        what to add there, their only value besides 0 if they have just one, the first place with it and the last up to each).

        Two subtrees without a telling text in common weigh what they weigh with only the common texts compared, and
        of such kinds there are few; the others are weighed in full.
        """
        import numpy as np

        if self.coarse is None:
            often: dict[str, int] = {}
            for node in self.trees[1]:
                often[node.text] = often.get(node.text, 0) + 1
            self.coarse = _Matcher(self.trees[0][0], self.trees[1][0], {t for t in self.shared if often[t] > _TELLING})
            self.coarse_of: dict[int, int] = {}
            for fine, rough in zip(self.kind, self.coarse.kind):
                self.coarse_of.update((k, rough[node]) for node, k in fine.items())
        coarse, of = self.coarse, self.coarse_of if self.coarse is not self else range(len(self.size))
        places: dict[int, list[int]] = {}
        for j, y in enumerate(ys):
            places.setdefault(y, []).append(j)
        rough, at = np.unique(np.array([of[y] for y in ys]), return_inverse=True)
        rough = rough.tolist()

        def telling(kind: int) -> set:
            found, todo = set(), [kind]
            while todo:
                k = todo.pop()
                if isinstance(self.text[k], str) and self.text[k] not in coarse.shared:
                    found.add(self.text[k])
                todo.extend(self.below[k])
            return found

        holders: dict[str, list[int]] = {}
        if coarse is not self:
            for y in places:
                for text in telling(y):
                    holders.setdefault(text, []).append(y)
        bases: dict[int, tuple] = {}
        extras: dict[int, tuple] = {}
        none = np.empty(0, dtype=np.int64)

        def add(i):
            x = xs[i]
            if (base := bases.get(of[x])) is None:
                if len(bases) >= _ROWS_OF_WEIGHTS:
                    bases.clear()
                weights = np.array([coarse.weight(of[x], r) for r in rough], dtype=np.int32)
                values = np.unique(weights[weights > 0])
                weights = weights[at]
                some = np.flatnonzero(weights)
                first = int(some[0]) if len(some) else len(ys)
                last = np.maximum.accumulate(np.where(weights > 0, np.arange(len(ys)), 0))
                base = bases[of[x]] = weights, (int(values[0]) if len(values) == 1 else 0), (first, last)
            if not holders:
                return base[0], none, none, *base[1:]
            if x not in extras:
                where, more = [], []
                for y in {y for text in telling(x) for y in holders.get(text, ())}:
                    gain = self.weight(x, y) - coarse.weight(of[x], of[y])
                    where += places[y]
                    more += [gain] * len(places[y])
                order = np.argsort(np.array(where, dtype=np.int64))
                extras[x] = np.array(where, dtype=np.int64)[order], np.array(more, dtype=np.int32)[order]
            return base[0], *extras[x], *base[1:]

        return add


def match(page: Node, reference: Node) -> dict[int, tuple[int, bool]]:
    """Page node index -> (reference node index, is the own text the same)."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be as deep as the page is long
    matcher = _Matcher(page, reference)
    kind, other = matcher.kind
    out: dict[int, tuple[int, bool]] = {}
    todo = [(page, reference)]
    while todo:
        x, y = todo.pop()
        out[x.index] = (y.index, x.text == y.text)
        a, b = kind[x.index], other[y.index]
        if a == b:
            todo.extend(zip(x.children, y.children))
        else:
            todo.extend((x.children[i], y.children[j]) for i, j in matcher.children(a, b)[1])
    return out


def layout(source: str | None) -> int | None:
    """Hash of the outer elements' labels: those down to the main parts and one level into them, each kind once."""
    if not source:
        return None
    root, _, depth_of_main = parse(source)
    has_main = depth_of_main is not None
    paths: set[int] = set()
    todo = [(root, 0, 0)]
    while todo:
        node, path, depth = todo.pop()
        for child in node.children:
            if child.tag in STRUCTURE and child.aside <= (WHOLE if has_main and not node.main else NO):
                below = zlib.crc32(repr(child.label).encode(), path)
                if not child.aside and (not has_main or (child.main and child.depth <= depth_of_main)):
                    paths.add(below)
                if not node.main and (has_main or depth < LAYOUT_DEPTH):
                    todo.append((child, below, depth + 1))
    return int.from_bytes(hashlib.blake2b(repr(sorted(paths)).encode(), digest_size=8).digest(), "big", signed=True)


def blocks(source: str | None, *references: Node | None) -> list[tuple]:
    """Blocks of the main part in page order: (text, per reference the node the block equals, else -1)."""
    if not source:
        return []
    root, pieces, depth_of_main = parse(source)
    same = [
        {k: r for k, (r, equal) in match(root, reference).items() if equal} if reference is not None else {}
        for reference in references
    ]
    out: list[tuple] = []
    text: list[str] = []
    owners: set[int] = set()

    def close():
        words = _html.unescape("".join(text)).split()
        if words:
            # A block is a constant of the template if every element that gave text to it is.
            nodes = [[s.get(o, -1) for o in owners] for s in same]
            out.append((" ".join(words), *(max(ns) if min(ns) >= 0 else -1 for ns in nodes)))
        text.clear()
        owners.clear()

    for node, piece in pieces:
        if piece is None:
            close()
        elif not node.aside and (depth_of_main is None or (node.main and node.depth <= depth_of_main)):
            text.append(piece)
            if not piece.isspace():
                owners.add(node.index)
    close()
    return out


def _tree(source: str | None) -> Node | None:
    if not source:
        return None
    trees = process_cache("trees")
    if source not in trees:
        if len(trees) >= 256:
            trees.clear()
        trees[source] = parse(source)[0]
    return trees[source]


def _blocks_udf():
    @F.pandas_udf("array<struct<text: string, node: int, own: int>>")
    def blocks_of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, hosts, layouts in parts:
            yield pd.Series(
                [
                    [{"text": t, "node": n, "own": o} for t, n, o in blocks(p, _tree(h), _tree(l))]
                    for p, h, l in zip(pages, hosts, layouts)
                ],
                dtype=object,
            )

    return blocks_of


def _layout_udf():
    @F.pandas_udf("long")
    def layout_of(pages: pd.Series) -> pd.Series:
        return pd.Series([layout(p) for p in pages], dtype="Int64")

    return layout_of


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def references(pages: DataFrame) -> DataFrame:
    """(host, layout, reference): the page nearest to the mean size (ties: smallest page_id), per host with enough pages
    (layout null) and per layout with enough pages of a host with several layouts.

    Pages without html are no candidates and do not count.
    """
    spark = pages.sparkSession
    filled = pages.filter(F.length("html") > 0).withColumn("print", F.xxhash64("html"))
    slim = filled.select("host", "page_id", "print", F.length("html").alias("size"), _layout_udf()(F.col("html")).alias("layout"))
    slim = written(spark, slim, "wrapper-layouts")
    nearest = F.struct(F.abs(F.col("size") - F.col("mean")).alias("off"), F.col("page_id").isNull().alias("no_id"), "page_id", "print")

    def chosen(keys: list[str]) -> DataFrame:
        mean = slim.groupBy(keys).agg(F.avg("size").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
        return slim.join(mean, keys).groupBy(keys).agg(F.min(nearest).alias("c")).select(*keys, F.col("c.print").alias("print"))

    several = slim.groupBy("host").agg(F.min("layout").alias("a"), F.max("layout").alias("b")).filter("a < b").select("host")
    by_layout = chosen(["host", "layout"]).join(several, "host", "left_semi")
    by_host = chosen(["host"]).select("host", F.lit(None).cast("long").alias("layout"), "print")
    # One print per host and layout: looked up where the pages are while their count allows, so no page is shuffled.
    wanted = written(spark, by_host.unionByName(by_layout), "wrapper-chosen")
    known = F.broadcast(wanted) if wanted.count() <= BROADCAST_HOSTS else wanted
    return filled.join(known, ["host", "print"]).groupBy("host", "layout").agg(F.min("html").alias("reference"))


def _templates(cut: DataFrame, keys: list[str], node: str) -> DataFrame:
    """(keys, nodes): the reference nodes that enough different pages of a group carry unchanged."""
    # Evidence: different pages only, told apart by their text; pages without text are none.
    evidence = cut.filter(F.size("blocks") > 0).select(*keys, F.xxhash64("blocks.text").alias("page"), F.col(f"blocks.{node}").alias("node")).distinct()
    pages_of = evidence.select(*keys, "page").distinct().groupBy(keys).agg(F.count("*").alias("n"))
    constant = (
        evidence.select(*keys, "page", F.explode(F.array_distinct("node")).alias("node")).filter("node >= 0")
        .distinct().groupBy(*keys, "node").agg(F.count("*").alias("seen"))
    )
    return (
        constant.join(pages_of, keys).filter((F.col("n") >= MIN_PAGES) & (F.col("seen") * 100 >= F.col("n") * TEMPLATE_PERCENT))
        .groupBy(keys).agg(F.collect_set("node").alias(f"{node}s"))  # nodes of one page at most
    )


def _small(table: DataFrame, size, most: int) -> DataFrame:
    """``table`` marked for broadcast if the sum of ``size`` allows."""
    total = table.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).first()["s"]
    return F.broadcast(table) if total <= most else table


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars per page."""
    spark = pages.sparkSession
    slim = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")
    ).withColumn("host", host(F.col("url")))
    refs = written(spark, references(slim), "wrapper-references")
    size = F.octet_length("reference") + F.octet_length("host")
    layouts = refs.filter("layout IS NOT NULL")
    mixed = layouts.select("host").distinct().withColumn("mixed", F.lit(True))
    hosts = refs.filter("layout IS NULL").select("host", "reference").join(mixed, "host", "left")
    parsed = slim.join(_small(hosts, size, BROADCAST_BYTES // 2), "host", "left")
    parsed = parsed.withColumn("layout", _layout_udf()(F.when(F.col("mixed"), F.col("html"))))
    own = layouts.withColumnRenamed("reference", "own_reference")
    parsed = parsed.join(_small(own, F.octet_length("own_reference") + F.octet_length("host"), BROADCAST_BYTES // 2), ["host", "layout"], "left")
    # A layout without a reference of its own is no group.
    grouped = F.when(F.col("own_reference").isNotNull(), F.col("layout")).alias("layout")
    cut = written(
        spark,
        parsed.select("page_id", "url", "host", grouped, _blocks_udf()("html", "reference", "own_reference").alias("blocks")),
        "wrapper-blocks",
    )
    of_hosts = written(spark, _templates(cut, ["host"], "node"), "wrapper-templates")
    of_layouts = written(spark, _templates(cut.filter("layout IS NOT NULL"), ["host", "layout"], "own"), "wrapper-layout-templates")
    # Templates go to the pages while they are small, so the texts are not shuffled.
    final = cut.join(_small(of_hosts, F.size("nodes") + 8, BROADCAST_NODES // 2), "host", "left").join(
        _small(of_layouts, F.size("owns") + 8, BROADCAST_NODES // 2), ["host", "layout"], "left"
    )

    def template(nodes: str, node):
        return F.coalesce(F.array_contains(nodes, node), F.lit(False))

    kept = F.filter("blocks", lambda b: ~template("nodes", b["node"]) & ~template("owns", b["own"]))
    main = F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks"))
    return final.select("page_id", "url", F.array_join(F.transform(main, lambda b: b["text"]), " ").alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
