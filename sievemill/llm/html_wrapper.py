"""Main text of web pages by wrapper induction.

1. Each page is parsed once into a tree of blocks and its lines, the runs of text between blocks; inline tags melt into
   their block. The tree's shape has one node for siblings of one label in a row (tag, class, id, role). Shape and lines
   are written as a table, so the later steps parse nothing.
2. For each host the shapes are counted exactly, and so are the pages that have each path of labels. Shapes lose the
   nodes whose path too few pages have, as no wrapper node can have more pages than its path, and then all of them are
   aligned by simple tree matching and merged to the host's wrapper, a few at a time, round by round; nodes that hardly
   any page has are left out of it.
3. Every page is aligned with the wrapper of its host. A line belongs to two slots: the wrapper's node that its block is
   aligned with, and the labels from the root on. For each slot the pages, texts and characters are added up over all
   pages of the host. A text on LEAST_PAGES pages and LEAST_SHARE of the pages that have the slot is constant: template.
   Pages with one and the same article count once, so copies do not pass for template.
4. The varying slots are content. Where a page names its article by tag, that is the region looked at; elsewhere the
   region goes from the first to the last line of a core slot: a heading, a slot with several lines a page, or one with
   a fair share of the host's text. Navigation, adverts, forms and the like are told by tag, class, id or role; within
   an article, headings, paragraphs and inline tags are never told by class, id or role.

The counts are exact sums by host, slot and text, so they do not depend on how pages are dealt to tasks, nor on the
size of a host, and a host with a third of all pages is never gathered in one place: about TOGETHER shapes or merged
trees of it meet in a task, whose size depends on what its pages share, not on their number. Blocks that the wrapper
lacks are told by the node above them and their labels.

Defined cases: null or empty html gives the empty text; a page without a host belongs to the host ''; unclosed and
stray tags are mended as browsers do for p, li and head, and a tag that the end of the page cuts off is no text; a form that holds an article or most of a page's text is
looked into; a host of few pages has no template, so only cues and text shares speak; depth, width and length of a
page have no bound; repeated rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import json
import marshal
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pandas_map, text_of

# HTML's tag classes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
SKIPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "label"}
CUES = r"\b(ad|ads|advert|advertisement|banner|promo|sponsor|sponsored|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|notice|alert|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|reply|replies|respond|popup|modal|overlay|widget|toolbar|pagination|pager|search|copyright|legal|disclaimer)\b"
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: The cues that make even an article something else: a reader's comment, an advert, a teaser.
ARTICLE_CUES = r"\b(ad|ads|advert|advertisement|promo|sponsored|comments?|reply|replies|related|recommended|teaser)\b"

CUE, ARTICLE_CUE = re.compile(CUES), re.compile(ARTICLE_CUES)
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Within an article these are its text, whatever their class or id says.
TEXTUAL = INLINE | HEADINGS | {"p"}
#: A slot's text is template if at least so many pages of the host have it, this share of those that have the slot.
LEAST_PAGES, LEAST_SHARE = 8, 0.5
#: Shapes or trees of a host merged in one task of a round; share of its pages that a node of the wrapper has.
TOGETHER, LEAST_SUPPORT = 16, 0.01
#: Core slots hold such a share of the host's text outside articles, or so many lines a page.
CORE_SHARE, CORE_LINES = 0.2, 1.5


class Node:
    __slots__ = ("tag", "label", "kids", "dropped", "shape")

    def __init__(self, tag: str, label: str, dropped: bool):
        self.tag, self.label, self.kids, self.dropped, self.shape = tag, label, [], dropped, None


def cue_words(attrs: list) -> str:
    named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
    return re.sub(r"[^a-z]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()) if named else ""


class TreeBuilder(HTMLParser):
    """Blocks as nodes, their text runs as string children; inline tags leave no trace."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "noscript", "iframe", "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "html", False)
        self.open = [self.root]
        self.count: Counter = Counter()  # open tags

    def _end_head(self) -> None:
        """What cannot stand in a head ends it, said or not."""
        if self.open[-1].tag == "head" or self.open[-1].tag == "title" and self.open[-2].tag == "head":
            self._close("head", ())

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ("html", "body"):
            return
        if tag in INLINE and not attrs:
            return
        words = cue_words(attrs)
        dropped = tag in SKIPPED or tag in CHROME
        if tag != "main" and not (tag in TEXTUAL and (self.count["article"] or self.count["main"])):
            dropped = dropped or bool(words and (ARTICLE_CUE if tag == "article" else CUE).search(words))
        if tag in INLINE and not dropped:
            return
        if tag in VOID:
            if tag == "br":
                self.open[-1].kids.append(" ")
            elif tag != "wbr":
                self.open[-1].kids.append(Node(tag, tag, True))
            return
        if tag in CLOSES_P:
            self._close("p", ("td", "th", "button", "object"))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, ("ul", "ol", "dl", "table", "select"))
        words = words.strip()
        node = Node(tag, f"{tag}.{words}" if words else tag, dropped)
        self.open[-1].kids.append(node)
        self.open.append(node)
        self.count[tag] += 1

    def _close(self, tag: str, stops: tuple) -> None:
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                for node in self.open[k:]:
                    self.count[node.tag] -= 1
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].kids.append(" ")
        else:
            self._close(tag, ())

    def handle_data(self, data):
        if data:
            if self.open[-1].tag == "head" and data.strip():
                self._end_head()
            self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    if re.match(r"</?[A-Za-z]", builder.rawdata):  # a tag that the page's end cuts off is no text
        builder.rawdata = ""
    builder.close()
    return builder.root


def squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Shape:
    """Node of a shape or wrapper; pages: that have it. digest and size of the tree are filled in when needed."""

    __slots__ = ("label", "kids", "pages", "digest", "size", "at")

    def __init__(self, label: str, kids: list, pages: int, digest: int = 0):
        self.label, self.kids, self.pages, self.digest, self.size, self.at = label, kids, pages, digest, 0, 0


def preorder(root: Shape) -> list[Shape]:
    """All nodes of a tree, parents before kids."""
    out, stack = [], [root]
    while stack:
        s = stack.pop()
        out.append(s)
        stack.extend(reversed(s.kids))
    return out


def placed(root: Shape) -> list[Shape]:
    """All nodes, each told its place among them."""
    out = preorder(root)
    for k, s in enumerate(out):
        s.at = k
    return out


def dump(root: Shape) -> bytes:
    nodes = preorder(root)
    return json.dumps([[s.label for s in nodes], [len(s.kids) for s in nodes], [s.pages for s in nodes]], separators=(",", ":")).encode()


def load(raw: bytes) -> Shape:
    labels, sizes, pages = json.loads(raw)
    made = [Shape(x, [], p) for x, p in zip(labels, pages)]
    left: list[list] = []  # nodes that miss kids, and how many
    for s, n in zip(made, sizes):
        if left:
            left[-1][0].kids.append(s)
            left[-1][1] -= 1
            if not left[-1][1]:
                left.pop()
        if n:
            left.append([s, n])
    return made[0]


def plain(label: str) -> str:
    return label.rstrip("+")


def same(a: Shape, b: Shape) -> bool:
    return plain(a.label) == plain(b.label)


def digest(root: Shape) -> int:
    """Hash of the labels of the tree; equal for trees in which all nodes pair."""
    if not root.digest:
        for s in reversed(preorder(root)):  # kids before their parent
            if not s.digest:
                s.size = 1 + sum([k.size for k in s.kids])
                s.digest = xxhash.xxh3_64_intdigest(np.array([k.digest for k in s.kids], dtype=np.uint64).tobytes() + plain(s.label).encode("utf-8", "surrogatepass")) or 1
    return root.digest


def wraps(node: Node) -> bool:
    """A form that nothing but its tag speaks against, as it may go around a whole page."""
    return node.tag == "form" and not CUE.search(node.label[5:])


def shape_of(root: Node) -> Shape:
    """The shape of a tree: siblings of one label in a row share a node, with a + at its label; in such a node, all kids
    of one label do. What is dropped is a leaf. Each node is told its shape."""
    top = root.shape = Shape(root.label, [], 1)
    stack = [([root], top)]
    while stack:
        group, own = stack.pop()
        kids = [k for g in group if not g.dropped or wraps(g) for k in g.kids if not isinstance(k, str)]
        runs: list[list[Node]] = []
        if len(group) == 1:
            for k in kids:
                if runs and runs[-1][0].label == k.label:
                    runs[-1].append(k)
                else:
                    runs.append([k])
        else:
            by: dict[str, list[Node]] = {}
            for k in kids:
                by.setdefault(k.label, []).append(k)
            runs = list(by.values())
        for run in runs:
            s = Shape(run[0].label + "+" * (len(run) > 1), [], 1)
            own.kids.append(s)
            for k in run:
                k.shape = s
            stack.append((run, s))
    return top


def heaviest(weight: Callable[[int], np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """Pairs in order of the largest total weight; weight(i): those of i with each of m. Every sqrt(n)-th row of the
    table is kept and the others are made again on the way back, so long lists need no square memory."""

    def after(row: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w), out=out[1:])
        return out

    step, row, kept = max(1, math.isqrt(n)), np.zeros(m + 1, dtype=np.int64), []
    for i in range(n):
        if i % step == 0:
            kept.append(row)
        row = after(row, weight(i))
    pairs, i, j = [], n, m
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for x in range(k * step, i):
            rows.append(after(rows[-1], weight(x)))
        while i > k * step and j:
            here, above, w = rows[i - k * step], rows[i - k * step - 1], weight(i - 1)[j - 1]
            if w and here[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        if not j:
            break
    return pairs[::-1]


def pairing(a: list[Shape], b: list[Shape], memo: dict) -> list[tuple[int, int]]:
    """Positions of the paired children, in order. Equal trees at both ends are paired as they stand; between them the
    pairs of the most matching nodes are found by dynamic programming, however many children there are."""
    da, db = [digest(x) for x in a], [digest(y) for y in b]
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and da[lo] == db[lo]:
        lo += 1
    while n > lo and m > lo and da[n - 1] == db[m - 1]:
        n, m = n - 1, m - 1
    mid: list[tuple[int, int]] = []
    if n > lo and m > lo:
        kinds = {d: y for d, y in zip(db[lo:m], b[lo:m])}
        number = {d: k for k, d in enumerate(kinds)}
        at = np.array([number[d] for d in db[lo:m]])
        labelled: dict[str, list[tuple[int, Shape]]] = {}
        for d, y in kinds.items():
            labelled.setdefault(plain(y.label), []).append((number[d], y))
        known: dict[int, np.ndarray] = {}
        for d, x in zip(da[lo:n], a[lo:n]):
            if d not in known:
                w = known[d] = np.zeros(len(kinds), dtype=np.int64)
                for k, y in labelled.get(plain(x.label), ()):
                    w[k] = match(x, y, memo)
        mid = [(lo + i, lo + j) for i, j in heaviest(lambda i: known[da[lo + i]][at], n - lo, m - lo)]
    return [(k, k) for k in range(lo)] + mid + [(n + k, m + k) for k in range(len(a) - n)]


def match(a: Shape, b: Shape, memo: dict) -> int:
    """Simple tree matching: the number of nodes paired when two trees are aligned, 0 for roots of different labels."""
    if not same(a, b):
        return 0
    key = (digest(a), digest(b))
    if key[0] == key[1]:
        return a.size
    if key not in memo:
        total = 1
        for i, j in pairing(a.kids, b.kids, memo):
            total += match(a.kids[i], b.kids[j], memo)
        memo[key] = total
    return memo[key]


def allow_depth(*trees: Shape) -> None:
    """Matching descends both trees at once; plain calls take no room on the C stack."""
    depth = 0
    for tree in trees:
        level, here = [tree], 0
        while level:
            here, level = here + 1, [k for s in level for k in s.kids]
        depth = max(depth, here)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * depth + 1000))


def merged(a: Shape, b: Shape, memo: dict | None = None) -> Shape:
    """One shape for both, in order; page counts are added up."""
    if memo is None:
        memo = {}
        allow_depth(a, b)
    kids, i, j = [], 0, 0
    for p, q in [*pairing(a.kids, b.kids, memo), (len(a.kids), len(b.kids))]:
        kids += a.kids[i:p] + b.kids[j:q]
        if p < len(a.kids):
            kids.append(merged(a.kids[p], b.kids[q], memo))
        i, j = p + 1, q + 1
    return Shape(a.label if a.label.endswith("+") else b.label, kids, a.pages + b.pages)


def counted(root: Shape, pages: int) -> Shape:
    """The tree of so many pages; one that is merged already knows its pages."""
    if root.pages != pages:
        for s in preorder(root):
            s.pages = pages
    return root


def all_merged(shapes: list[tuple[bytes, int]]) -> Shape:
    """One tree of shapes or merged trees with their numbers of pages, merged in this order."""
    made = None
    for raw, pages in shapes:
        one = counted(load(raw), pages)
        made = one if made is None else merged(made, one)
    return made


def supported(made: Shape) -> Shape:
    """The tree without nodes that too few of its pages have."""
    least = LEAST_SUPPORT * made.pages
    for s in preorder(made):
        s.kids = [k for k in s.kids if k.pages >= least]
        s.digest = 0
    return made


@lru_cache(maxsize=1 << 16)
def below(path: int, label: str) -> int:
    """The slot of a block that is told by its label within another slot."""
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=path)


def by_path(shape: Shape) -> Iterator[tuple[Shape, int]]:
    """All nodes, parents before kids, each with its path of labels from the root on."""
    stack = [(shape, below(0, plain(shape.label)))]
    while stack:
        s, path = stack.pop()
        yield s, path
        stack.extend([(k, below(path, plain(k.label))) for k in s.kids])


def slots_of(shape: Shape, wrapper: Shape | None) -> tuple[list[int], list[int]]:
    """For each node of a page's shape its slots: by the labels from the root on, and by its place in the wrapper."""
    nodes = placed(shape)
    paths, places = [0] * len(nodes), [0] * len(nodes)
    if wrapper is not None:
        allow_depth(shape, wrapper)
        placed(wrapper)
    memo: dict = {}
    stack = [(shape, wrapper, 0, 0)]
    while stack:
        s, w, path, place = stack.pop()
        paths[s.at] = path = below(path, plain(s.label))
        places[s.at] = place = below(place, plain(s.label)) if w is None else below(1, str(w.at))
        of = dict(pairing(s.kids, w.kids, memo)) if w is not None else {}
        for i, kid in enumerate(s.kids):
            stack.append((kid, w.kids[of[i]] if i in of else None, path, place))
    return paths, places if wrapper is not None else paths


def mains(root: Node, cued: bool = False) -> list[Node]:
    """The outermost articles that are not inside chrome; cued: also look into what only a class or id speaks against,
    and into any form."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in MAIN:
            out.append(node)
            continue
        for kid in reversed(node.kids):
            if isinstance(kid, str) or kid.dropped and not wraps(kid) and (not cued or kid.tag in MAIN or kid.tag in SKIPPED or kid.tag in CHROME and kid.tag != "form"):
                continue
            stack.append(kid)
    return out


#: A line: the place of its block in the shape, its text, whether it can be template (headings cannot), and lies in a form.
Line = tuple[int, str, bool, bool]


def lines(top: Node, out: list[Line]) -> None:
    """Adds the runs of text between child blocks, in page order."""
    stack = [(top, iter(top.kids), [], False)]
    while stack:
        node, kids, run, inside = stack[-1]
        kid = next(kids, None)
        if isinstance(kid, str):
            run.append(kid)
            continue
        if run:
            if line := squeeze(run):
                out.append((node.shape.at if node.shape else 0, line, node.tag not in HEADINGS, inside))
            run.clear()
        if kid is None:
            stack.pop()
        elif not kid.dropped or wraps(kid):
            stack.append((kid, iter(kid.kids), [], inside or kid.dropped))


def read_page(html: str) -> tuple[Shape, list[Line], bool]:
    """Shape, lines, and whether the page names its article."""
    root = parse(html)
    shape = shape_of(root)
    placed(shape)
    found = mains(root) or mains(root, True)
    out: list[Line] = []
    for node in found or [root]:
        lines(node, out)
    return shape, out, bool(found)


def line_key(path: int, line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"), seed=path)


class Extractor:
    """template: the keys of the host's constant lines; core: its core slots; tree: its wrapper."""

    def __init__(self, template: frozenset | None, core: frozenset | None = None, tree: Shape | None = None):
        self.template, self.core, self.tree = template or frozenset(), core or frozenset(), tree
        self.known: dict = {}

    def slots(self, shape: bytes) -> tuple[list[int], list[int]]:
        if shape not in self.known:
            if len(self.known) >= 1000:
                self.known.clear()
            self.known[shape] = slots_of(load(shape), self.tree)
        return self.known[shape]

    def content(self, shape: bytes, found: list[Line], named: bool) -> str:
        """The lines that are not template and, where no article is named, lie between core slots. Forms stay out unless
        they hold more of the text than the rest does."""
        if self.template or self.core:
            paths, places = self.slots(shape)
            if self.template:
                found = [x for x in found if not (x[2] and (line_key(paths[x[0]], x[1]) in self.template or line_key(places[x[0]], x[1]) in self.template))]
            core = [k for k, x in enumerate(found) if not x[2] or places[x[0]] in self.core] if self.core and not named else []
            if core:
                found = found[core[0] : core[-1] + 1]
        rest = sum([len(line) * (-1 if inside else 1) for _, line, _, inside in found])
        return "\n".join([line for _, line, _, inside in found if rest < 0 or not inside])

    def text(self, html: str) -> str:
        shape, found, named = read_page(html)
        return self.content(dump(shape), found, named)


def _keys(raw: bytes | None) -> frozenset:
    return frozenset(np.frombuffer(raw or b"", dtype=">u8").tolist())


@lru_cache(maxsize=256)
def extractor(tree: bytes | None, template: bytes | None, core: bytes | None) -> Extractor:
    return Extractor(_keys(template), _keys(core), load(tree) if tree else None)


WRAPPER = ("tree", "template", "core")


def _extractors(pdf: pd.DataFrame, shared: dict | None) -> Iterator[Extractor]:
    """That of each row's host: from the broadcast wrappers or else the row's own columns."""
    for host, *own in zip(pdf["host"], *([pdf[c] for c in WRAPPER] if shared is None else ())):
        yield extractor(*(shared.get(host, (None,) * 3) if shared is not None else [None if x is None else bytes(x) for x in own]))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for html in pdf.pop("html"):
            shape, found, named = read_page(html)
            rows.append((np.uint64(digest(shape)).astype(np.int64), dump(shape), marshal.dumps((found, named))))
        yield pdf.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("digest", "shape", "lines"))})


def _survey(shared):
    """(host, slot, key, article, chars, n) of each page: its slots, with key 0, and its lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            host, rows = [], []
            for name, many, shape, raw, own in zip(pdf["host"], pdf["many"], pdf["shape"], pdf["lines"], _extractors(pdf, shared and shared.value)):
                found, named = marshal.loads(raw)
                paths, places = own.slots(bytes(shape))
                article = xxhash.xxh3_64_intdigest("\n".join([x[1] for x in found]).encode("utf-8", "surrogatepass"))
                slots: dict[int, list[int]] = {}
                keys = set()
                for at, line, may, _ in found:
                    for slot in (paths[at], places[at]):
                        slots.setdefault(slot, [0, 0])
                        if may and many:
                            keys.add((slot, line_key(slot, line)))
                    if not named:
                        slots[places[at]][0] += len(line)
                        slots[places[at]][1] += 1
                mine = [(s, 0, article, c, n) for s, (c, n) in slots.items() if many or n] + [(s, k, article, 0, 0) for s, k in keys]
                host += [name] * len(mine)
                rows += mine
            if not rows:
                continue
            numbers = np.array(rows, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"host": host, **{c: numbers[:, k] for k, c in enumerate(("slot", "key", "article", "chars", "n"))}})

    return run


def _extract(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = []
            for shape, raw, own in zip(pdf["shape"], pdf["lines"], _extractors(pdf, shared and shared.value)):
                text.append("" if raw is None else own.content(bytes(shape), *marshal.loads(raw)))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text})

    return run


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path, pages) of each shape: its paths of labels."""
    for pdf in batches:
        found = [np.array(list({p for _, p in by_path(load(bytes(raw)))}), dtype=np.uint64).view(np.int64) for raw in pdf["shape"]]
        if found:
            size = [len(f) for f in found]
            yield pd.DataFrame({"host": np.repeat(pdf["host"].to_numpy(), size), "path": np.concatenate(found), "pages": np.repeat(pdf["pages"].to_numpy(), size)})


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, digest, pages, shape): shapes without the nodes whose path is not among those given."""
    sets: dict[bytes, frozenset] = {}
    for pdf in batches:
        rows = []
        for raw, own in zip(pdf["shape"], map(bytes, pdf.pop("paths"))):
            if own not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[own] = _keys(own)
            root = load(bytes(raw))
            for s, path in by_path(root):  # the kids of a node are listed when it is seen
                s.kids = [k for k in s.kids if below(path, plain(k.label)) in sets[own]]
            rows.append((np.uint64(digest(root)).astype(np.int64), dump(root)))
        yield pdf.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("digest", "shape"))})


def _merge(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["pages", "digest"], ascending=[False, True])
        tree = all_merged([(bytes(s), int(p)) for s, p in zip(own["shape"], own["pages"])])
        return pd.DataFrame({"host": own["host"].iloc[:1], "digest": own["group"].iloc[:1], "pages": [tree.pages], "shape": [dump(supported(tree) if last else tree)]})

    return run


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def with_wrappers(rows: DataFrame, wrappers: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, object | None]:
    """The wrappers as a broadcast value while they are small; beyond that joined to the rows by host."""
    size = wrappers.agg(F.sum(F.octet_length("host") + 200 + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in WRAPPER))).first()[0] or 0
    if size > broadcast_bytes:
        return rows.join(wrappers, "host", "left"), None
    found = {r["host"]: tuple(None if r[c] is None else bytes(r[c]) for c in WRAPPER) for r in wrappers.collect()}  # at most broadcast_bytes
    return rows, rows.sparkSession.sparkContext.broadcast(found)


def merge_all(shapes: DataFrame) -> DataFrame:
    """host, tree: all shapes (host, digest, pages, shape) of a host as one, by rounds that merge about TOGETHER of them
    in a task, the frequent ones first. After the first round, digest is the number of the group that was merged."""
    left = shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while True:
        size = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("groups"))
        dealt = shapes.join(size, "host").withColumn("group", F.pmod(F.xxhash64("digest"), "groups")).drop("groups")
        left = -(-left // TOGETHER)
        done = dealt.groupBy("host", "group").applyInPandas(_merge(left <= 1), "host string, digest long, pages long, shape binary")
        if left <= 1:
            return done.select("host", F.col("shape").alias("tree"))
        shapes = materialise(done, "merged")


def induce_trees(pages: DataFrame) -> DataFrame:
    """host, tree (its wrapper, of all shapes) and null template and core, for hosts of LEAST_PAGES pages or more."""
    shapes = pages.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages"), F.min("shape").alias("shape"))
    shapes = materialise(shapes, "shapes")
    large = shapes.groupBy("host").agg(F.sum("pages").alias("all")).filter(F.col("all") >= LEAST_PAGES)
    shapes = shapes.join(large, "host").select("host", "pages", "shape", "all")
    paths = shapes.select("host", "pages", "shape").transform(pandas_map, _paths, "host string, path long, pages long")
    paths = paths.groupBy("host", "path").agg(F.sum("pages").alias("pages")).join(large, "host").filter(F.col("pages") >= LEAST_SUPPORT * F.col("all"))
    known = shapes.drop("all").join(paths.groupBy("host").agg(packed("path").alias("paths")), "host")
    shapes = known.transform(pandas_map, _pruned, "host string, digest long, pages long, shape binary")
    shapes = shapes.groupBy("host", "digest").agg(F.sum("pages").alias("pages"), F.min("shape").alias("shape"))
    return merge_all(materialise(shapes, "frequent-shapes")).withColumns({c: F.lit(None).cast("binary") for c in WRAPPER[1:]})


def packed(slot: str):
    return F.unhex(F.concat_ws("", F.array_sort(F.collect_set(F.lpad(F.hex(slot), 16, "0")))))


def induce_wrappers(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """host, tree, template (keys of its constant lines) and core (its core slots), eight bytes each, from parsed pages."""
    pages = pages.filter("lines IS NOT NULL")
    trees = materialise(induce_trees(pages), "trees")
    hosts = trees.select("host", F.lit(True).alias("many"))
    rows, shared = with_wrappers(pages.select("host", "shape", "lines"), trees, broadcast_bytes)
    rows = rows.join(hosts, "host", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    seen = rows.transform(pandas_map, _survey(shared), "host string, slot long, key long, article long, chars long, n long")
    seen = seen.groupBy("host", "slot", "key", "article").agg(F.max("chars").alias("chars"), F.max("n").alias("n"))
    counts = seen.groupBy("host", "slot", "key").agg(F.count(F.lit(1)).alias("k"), F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    counts = materialise(counts.filter((F.col("k") >= LEAST_PAGES) | (F.col("n") > 0)), "slots")
    slots = counts.filter("key = 0")
    constant = counts.filter(F.col("key") != 0).filter(F.col("k") >= LEAST_PAGES).join(slots.select("host", "slot", F.col("k").alias("pages")), ["host", "slot"])
    template = constant.filter(F.col("k") >= LEAST_SHARE * F.col("pages")).groupBy("host").agg(packed("key").alias("template"))
    total = slots.groupBy("host").agg(F.sum("chars").alias("total"))
    core = slots.filter("n > 0").join(total, "host").filter((F.col("chars") >= CORE_SHARE * F.col("total")) | (F.col("n") >= CORE_LINES * F.col("k")))
    core = core.groupBy("host").agg(packed("slot").alias("core"))
    return trees.select("host", "tree").join(template, "host", "full").join(core, "host", "full").select("host", *WRAPPER)


def parse_pages(pages: DataFrame) -> DataFrame:
    """The written table of parsed pages: page_id as a string, url, host, digest, shape, lines."""
    rows = pages.select(F.col("page_id").cast("string"), "url", host_of().alias("host"), text_of("html").alias("html"))
    made = rows.transform(pandas_map, _parse, "page_id string, url string, host string, digest long, shape binary, lines binary")
    return materialise(made, "parsed-pages", compression="zstd")


def extract_pages(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars. Wrappers are broadcast while they are small; beyond that they are joined by host."""
    parsed = parse_pages(pages)
    wrappers = materialise(induce_wrappers(parsed, broadcast_bytes), "wrappers")
    rows, shared = with_wrappers(parsed.drop("digest"), wrappers, broadcast_bytes)
    out = rows.transform(pandas_map, _extract(shared), "page_id string, url string, text string")
    out = out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
    return out.withColumn("n_chars", F.length("text").cast("long"))
