"""Main text of web pages by wrapper induction.

Pages become trees of blocks (inline markup melts into its block's text). A wrapper's shape is the alignment of
trees of some pages of a host's layout by simple tree matching. All different pages of the layout are aligned with
it and, for each of its nodes, the texts, the names and the share of linked text are counted: a node whose text is
the same on most pages is template, one that is a list of links on most pages is a menu, the others are slots.

Slots are judged from the root down, by sums over the layout's pages: how much text a slot has beside the others of its
level, whether running text (headings, paragraphs) is in it, whether articles are, what its names and links say. Where one
slot has most of the text and running text in it, short ones beside it without any are adverts, footers and the like; where
most pages mark articles, those are the content. So a tag or a name is a feature in a slot's vote, and pages of the same
layout without telling tags or names read the same (a test writes the given pages' with div alone). Nodes that no slot has
go by what they are themselves, and so do pages of layouts that fewer than LEAST pages have: there, the page is its own
wrapper. Without a wrapper at all nothing is known to be template, and a page's text is all that it shows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import longs_again, longs_as_text, saved
from .url_filters import url_host

#: A wrapper's shape comes from so many pages of the layout at most, those of least hash among different pages. A text
#: that 0.8 of the pages have is in two of them at least with probability 1 - 2e-7; its count is over all pages.
SAMPLE, CHOICES = 12, 48
#: A text is template if so many of the layout's pages have it, and 0.8 of them (inside an article: all of so many).
LEAST, LEAST_INSIDE = 3, 8
#: A list is a menu if so much of its text is links, on so many of the pages that have it.
LINKED, MENU_PAGES, MENU_ITEMS = 0.8, 0.8, 3
#: A feature belongs to a slot if so many of its pages have it. The largest slot of a level must have so much of the level's
#: text, and bare slots beside it no more than so much of its own, to be left out.
VOTE, MOST, SHORT = 0.8, 0.5, 0.2
#: A layout is the labels of blocks that hold blocks, down to so many levels; rarer layouts than SAMPLE share REST.
LAYOUT_DEPTH, REST = 4, "*"
#: The chosen pages' keys are broadcast up to so many, a few MB; wrappers up to so many characters.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 16_000_000
#: Pages of a host that meet their wrapper in one part, where wrappers are too large to be broadcast.
HOT = 20_000

# HTML elements by kind.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead title tr ul".split())
APART = frozenset("audio button canvas datalist embed iframe input map math noframes noscript object option picture script select style svg template textarea video".split())
RAW = frozenset("script style textarea title iframe noframes".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("head title nav header footer aside form menu dialog search fieldset".split()) | APART
ROLE_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo promos respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar".split())
#: Words that may stand beside a role in one name: "ad-box" is an advert, "notice-period" no notice.
BESIDE = frozenset("area bar block bottom box container content footer form global header inner item items left links list main outer page panel primary right secondary section site slot thread top unit widget wrap wrapper zone".split())
ROLE_ATTRIBUTES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Elements of running text, and those that are not measured by themselves: they are parts of lists and tables.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
PARTS = frozenset("li dt dd tr td th caption option".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s>/]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that an open paragraph is not closed across.
SCOPES = frozenset("button object template svg math td th caption table".split())


@lru_cache(4096)
def names_role(name: str) -> bool:
    """Whether a whole class name or id means a part outside the article; one word of it is not enough."""
    parts = {p.lower() for p in _PART.findall(name)}
    return bool(parts & ROLE_WORDS) and parts <= ROLE_WORDS | BESIDE


class Node:
    __slots__ = ("tag", "label", "text", "kids", "out", "buf", "linked", "chars")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.label, self.text, self.kids, self.buf = tag, tag, "", [], []
        self.linked = self.chars = 0  # characters in links, and in all, here and below
        self.out = tag in NOT_TEXT
        if attrs and not attrs.isspace():
            names = []
            for name, *values in _ATTR.findall(attrs):
                value, name = "".join(values), name.lower()
                if name == "role":
                    self.out |= value.lower() in ROLE_ATTRIBUTES
                elif name == "hidden":
                    self.out = True
                else:
                    names.append(value)
            words = _WORD.findall(" ".join(names).lower())
            if words:
                self.label = f"{tag}.{'.'.join(dict.fromkeys(words))}"
                if tag not in ("html", "body"):
                    self.out |= any(map(names_role, " ".join(names).split()))


def parse(html: str) -> Node:
    """A tree of blocks; text beside blocks becomes a child `#`. Unclosed and odd markup is read as browsers do, roughly."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    held: Counter[str] = Counter()  # open elements by tag
    in_link = False

    def add(raw: str) -> None:
        top = stack[-1]
        top.buf.append(raw)
        size = len(raw.strip())
        top.chars += size
        if in_link:
            top.linked += size

    def flush() -> None:
        top = stack[-1]
        if top.buf:
            raw = "".join(top.buf)
            top.buf = []
            text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
            if text:
                kid = Node("#")
                kid.text = text
                top.kids.append(kid)

    def close() -> None:
        flush()
        top = stack.pop()
        held[top.tag] -= 1
        stack[-1].chars += top.chars
        stack[-1].linked += top.linked
        if len(top.kids) == 1 and top.kids[0].tag == "#":
            top.text, top.kids = top.kids[0].text, []

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        end, tag, attrs = m[1], m[2] or m[4], m[3] or m[5] or ""
        if end:
            end = end.lower()
            if end == "a":
                in_link = False
            elif (end in BLOCK or end in APART) and held[end]:
                while stack[-1].tag != end:
                    close()
                close()
        elif tag:
            tag = tag.lower()
            if tag == "br":
                stack[-1].buf.append(" ")
            if tag not in BLOCK and tag not in APART:
                in_link |= tag == "a"
                continue
            if tag in BLOCK and held["p"]:  # a block ends the paragraph that it stands in
                k = len(stack) - 1
                while stack[k].tag not in SCOPES and stack[k].tag not in BLOCK and k:
                    k -= 1
                if stack[k].tag == "p":
                    while len(stack) > k:
                        close()
            if tag in SAME_LEVEL:
                while stack[-1].tag in SAME_LEVEL[tag]:
                    close()
            flush()
            node = Node(tag, attrs)
            stack[-1].kids.append(node)
            if tag in EMPTY or attrs.endswith("/") and tag in APART:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else n
                continue
            stack.append(node)
            held[tag] += 1
    while len(stack) > 1:
        close()
    flush()
    return root


class Slot:
    """A node of a wrapper: texts has the pages with each text (once loaded: the text's number, and the node's in number); seen counts the pages that have the node."""

    __slots__ = ("label", "texts", "seen", "kids", "number")

    def __init__(self, label: str, texts: dict[str, int], seen: int, kids: list[Slot]):
        self.label, self.texts, self.seen, self.kids, self.number = label, texts, seen, kids, 0

    @classmethod
    def of(cls, node: Node) -> Slot:
        top = cls(node.label, {node.text: 1}, 1, [])
        todo = [(top, node)]
        while todo:
            slot, node = todo.pop()
            slot.kids = [cls(k.label, {k.text: 1}, 1, []) for k in node.kids]
            todo += zip(slot.kids, node.kids, strict=True)
        return top

    def dump(self) -> list:
        """Level, label, pages and texts of each node in page order. Nodes and texts that too few pages have can't be template and are left out."""
        out, todo = [], [(0, self)]
        while todo:
            level, slot = todo.pop()
            out.append([level, slot.label, slot.seen, {t: n for t, n in slot.texts.items() if n > 1}])
            todo += [(level + 1, k) for k in reversed(slot.kids) if k.seen >= LEAST]
        return out

    @classmethod
    def load(cls, shape: list) -> tuple[Slot, list[bool], dict[int, int]]:
        """The tree; for each text's number whether it is inside an article; and the pages of each that made the shape, -1 for all."""
        path: list[tuple[Slot, bool]] = []
        inside: list[bool] = []
        counts, nodes = {-1: shape[0][2]}, -1
        for level, label, seen, texts in shape:
            del path[level:]
            slot = cls(label, {t: len(inside) + i for i, t in enumerate(texts)}, seen, [])
            nodes += 1
            slot.number = nodes
            counts |= zip(slot.texts.values(), texts.values(), strict=True)
            within = label.partition(".")[0] in ("article", "main") or bool(path) and path[-1][1]
            inside += [within] * len(texts)
            if path:
                path[-1][0].kids.append(slot)
            path.append((slot, within))
        return path[0][0], inside, counts


def tree_match(a: Slot, b: Node) -> tuple[int, list]:
    """Simple tree matching: the most node pairs in order (equal texts count twice), and the pairs of children matched. Pages nest to any depth, so calls are steps that give what they need and get its result."""
    todo, got = [_match(a, b)], None
    while todo:
        try:
            todo.append(_match(*todo[-1].send(got)))
            got = None
        except StopIteration as e:
            todo.pop()
            got = e.value
    return got


def _match(a: Slot, b: Node) -> Generator[tuple[Slot, Node], tuple[int, list], tuple[int, list]]:
    if a.label != b.label:
        return 0, []
    own = 2 if b.text in a.texts else 1
    x, y = a.kids, b.kids
    if not x or not y:
        return own, []
    if len(x) == 1 and len(y) == 1:
        s, sub = yield x[0], y[0]
        return own + s, [(x[0], y[0], sub)] if s else []
    got: dict[tuple[int, int], tuple[int, list]] = {}
    rows = [[0] * (len(y) + 1)]
    for i, p in enumerate(x):
        last, row = rows[-1], [0]
        label, texts, leaf = p.label, p.texts, not p.kids
        for j, q in enumerate(y):
            best = last[j + 1] if last[j + 1] >= row[j] else row[j]
            if label == q.label:
                if leaf or not q.kids:
                    s = last[j] + (2 if q.text in texts else 1)
                else:
                    got[i, j] = m = yield p, q
                    s = last[j] + m[0]
                if s > best:
                    best = s
            row.append(best)
        rows.append(row)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((x[i], y[j], got.get((i, j), (0, []))[1]))
    return own + rows[-1][-1], pairs[::-1]


def _merge(top: Slot, root: Node, matched: list) -> None:
    todo = [(top, root, matched)]
    while todo:
        slot, node, pairs = todo.pop()
        slot.seen += 1
        slot.texts[node.text] = slot.texts.get(node.text, 0) + 1
        at = {id(q): p for p, q, _ in pairs}
        where = {id(p): i for i, p in enumerate(slot.kids)}
        kids, i = [], 0
        for q in node.kids:
            if id(q) in at:
                p = at[id(q)]
                kids += slot.kids[i : where[id(p)]]
                i = where[id(p)] + 1
                kids.append(p)
            else:
                kids.append(Slot.of(q))
        slot.kids = kids + slot.kids[i:]
        todo += pairs


def induce(pages: list[str]) -> Slot | None:
    """The wrapper of some pages of one host; None without pages."""
    top = None
    for page in pages:
        tree = parse(page)
        if top is None:
            top = Slot.of(tree)
        else:
            _merge(top, tree, tree_match(top, tree)[1])
    return top


def layout_of(root: Node) -> str:
    """Of pages with the same labels of blocks that hold blocks, down to LAYOUT_DEPTH levels and outside articles, the same; repeats count once."""
    out: list[str] = []

    def walk(node: Node, level: int) -> None:
        out.append(f"{level} {node.label}")
        last = None
        if level < LAYOUT_DEPTH and node.tag not in ("article", "main"):
            for k in node.kids:
                if k.kids and k.label != last:
                    walk(k, level + 1)
                    last = k.label

    walk(root, 0)
    return hashlib.md5("\n".join(out).encode("utf-8", "replace")).hexdigest()[:16]


#: What a node of a page is to the counts: a slot, outside the article by its names, or a list of links.
SLOT, OUT, MENU = 0, 1, 2


def _code(number: int, kind: int) -> int:
    return -2 - 3 * number - kind


def _kind(node: Node) -> int:
    if node.out:
        return OUT
    return MENU if len(node.kids) >= MENU_ITEMS and node.linked >= LINKED * node.chars > 0 else SLOT


def _measures(root: Node) -> dict[int, tuple[int, int, int, int]]:
    """By node: whether running text is in it, the characters of its own children of running text, outermost articles and mains in it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    out: dict[int, tuple[int, int, int, int]] = {}
    for node in reversed(order):
        below = [out[id(k)] for k in node.kids]
        prose = node.tag in PROSE or any(m[0] for m in below)
        articles = 0 if node.out else 1 if node.tag == "article" else sum(m[2] for m in below)
        mains = 0 if node.out else 1 if node.tag == "main" else sum(m[3] for m in below)
        out[id(node)] = int(prose), sum(k.chars for k in node.kids if k.tag in PROSE), articles, mains
    return out


def _stat(node: Node, m: tuple[int, int, int, int]) -> list[int]:
    """What a page adds to a slot's sums: pages, characters, pages with running text, characters of it in own children, pages with
    articles, with just one, with mains."""
    prose, direct, articles, mains = m
    return [1, node.chars, prose, direct, int(articles > 0), int(articles == 1), int(mains > 0)]


@dataclass
class Judgement:
    """By number of slot: how the level below it is split (by articles, or by what is bare), which slots are left out there,
    which hold articles, and which are marked as articles themselves."""

    levels: dict[int, str]
    beside: set[int]
    marked: set[int]
    articles: set[int]


def _judge(top: Slot, stats: dict[int, list[int]], apart: frozenset[int]) -> Judgement:
    out = Judgement({}, set(), set(), set())
    todo = [top]
    while todo:
        p = todo.pop()
        if p.number not in stats:
            continue
        pages, chars, _, direct, *_ = stats[p.number]
        kids = [(k, stats[k.number]) for k in p.kids if k.number in stats and k.number not in apart]
        marked = [(k, x) for k, x in kids if x[0] >= VOTE * pages and max(x[4], x[6]) >= VOTE * x[0]]
        if marked:
            out.levels[p.number] = "articles"
            out.marked |= {k.number for k, _ in marked}
            for k, x in marked:
                tag = k.label.partition(".")[0]
                if tag == "article" or tag == "main" and x[5] < VOTE * x[0]:
                    out.articles.add(k.number)
                else:
                    todo.append(k)
            continue
        best = max(kids, key=lambda k: k[1][1], default=None)
        if best is None or direct >= MOST * chars or best[1][1] < MOST * chars or best[1][2] < VOTE * best[1][0]:
            continue
        out.levels[p.number] = "bare"
        out.beside |= {k.number for k, x in kids if x[2] < MOST * x[0] and x[1] / x[0] < SHORT * best[1][1] / best[1][0]}
        todo.append(best[0])
    return out


@dataclass
class Layout:
    """A wrapper's tree; numbers of its texts that are template; of nodes with votes, of those outside the article, of menus;
    and how its slots are judged, None where too few pages are known."""

    top: Slot
    good: frozenset[int]
    voted: frozenset[int]
    out: frozenset[int]
    menus: frozenset[int]
    judged: Judgement | None


@lru_cache(256)
def _loaded(wrapper: str) -> dict[str, Layout]:
    """By layout. A shape alone goes by the pages that made it."""
    out = {}
    of = json.loads(wrapper)
    for layout, x in of.items() if isinstance(of, dict) else [(REST, {"shape": wrapper})]:
        top, inside, counts = Slot.load(json.loads(x["shape"]))
        if x.get("counts"):
            counts = {int(k): v for k, v in x["counts"].items()}
        pages = counts[-1]
        good = frozenset(i for i, n in counts.items() if i >= 0 and n >= (max(LEAST_INSIDE, pages) if inside[i] else max(LEAST, 0.8 * pages)))
        kinds: dict[int, list[int]] = {}
        for i, n in counts.items():
            if i < -1:
                number, kind = divmod(-2 - i, 3)
                kinds.setdefault(number, [0, 0, 0])[kind] += n
        kinds = {j: n for j, n in kinds.items() if sum(n) >= LEAST}
        outside = frozenset(j for j, n in kinds.items() if n[OUT] >= VOTE * sum(n))
        menus = frozenset(j for j, n in kinds.items() if n[MENU] >= MENU_PAGES * sum(n))
        stats = {int(k): v for k, v in (x.get("stats") or {}).items()}
        judged = _judge(top, stats, outside | menus) if stats and pages >= LEAST else None
        out[layout] = Layout(top, good, frozenset(kinds), outside, menus, judged)
    return out


def _aligned(top: Slot, root: Node) -> Iterator[tuple[Slot, Node]]:
    """The wrapper's nodes and the page's nodes that they match."""
    todo = list(tree_match(top, root)[1])
    while todo:
        slot, node, sub = todo.pop()
        yield slot, node
        todo += sub


def _hits(top: Slot, root: Node) -> tuple[set[int], list[list[int]]]:
    """What a page adds to the counts: the texts that the wrapper has at the same node, and what each node is; and to the
    slots' sums (number, sums)."""
    m = _measures(root)
    out, sums = set(), [[top.number, *_stat(root, m[id(root)])]]
    for slot, node in _aligned(top, root):
        if node.text and node.text in slot.texts:
            out.add(slot.texts[node.text])
        if node.kids or node.out:
            out.add(_code(slot.number, _kind(node)))
        if node.tag not in PROSE and node.tag not in PARTS:
            sums.append([slot.number, *_stat(node, m[id(node)])])
    return out, sums


def _own(root: Node, m: dict[int, tuple[int, int, int, int]]) -> tuple[Judgement, dict[int, Slot]]:
    """A page judged as its own wrapper, and its slots by node."""
    top = Slot.of(root)
    slots, stats, apart, todo = {}, {}, set(), [(top, root)]
    while todo:
        slot, node = todo.pop()
        slot.number = len(slots)
        slots[id(node)] = slot
        if node.tag not in PROSE and node.tag not in PARTS:
            stats[slot.number] = _stat(node, m[id(node)])
        if node.out or _kind(node) == MENU:
            apart.add(slot.number)
        todo += zip(slot.kids, node.kids, strict=True)
    return _judge(top, stats, frozenset(apart)), slots


def _content(root: Node, wrapper: str) -> Iterator[Node]:
    """A page's nodes that are content, in page order."""
    of = _loaded(wrapper)
    layout = of.get(layout_of(root)) or of.get(REST)
    at: dict[int, Slot] = {}
    if layout is not None:
        at = {id(node): slot for slot, node in _aligned(layout.top, root)}
        at[id(root)] = layout.top
    m = _measures(root)
    judged, slots = (layout.judged, at) if layout is not None and layout.judged is not None else _own(root, m)
    # (node, whether levels are still split here, whether it is in an article)
    todo = [(root, True, False)]
    while todo:
        node, split, inside = todo.pop()
        yield node
        slot = slots.get(id(node))
        inside |= slot is not None and slot.number in judged.articles
        rule = judged.levels.get(slot.number) if split and slot is not None else None
        for kid in reversed(node.kids):
            known, own = at.get(id(kid)), slots.get(id(kid))
            voted = known is not None and known.number in layout.voted
            if known.number in layout.out if voted else kid.out:
                continue
            if known is not None and (kid.text and known.texts.get(kid.text) in layout.good or known.number in layout.menus and not inside):
                continue
            if rule == "articles" and not (own.number in judged.marked if own is not None else max(m[id(kid)][2:])):
                continue
            if rule == "bare" and (own.number in judged.beside if own is not None else not m[id(kid)][0] and kid.chars < SHORT * node.chars):
                continue
            todo.append((kid, split and rule is not None, inside))


def _shown(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        if node.tag not in APART and node.tag != "head":
            yield node
            todo += reversed(node.kids)


def main_text(html: str | None, wrapper: str | None = None) -> str:
    """The blocks of the content region in page order, one a line; empty for null, empty or textless pages. Without a
    wrapper, all blocks that the page shows."""
    if not html:
        return ""
    root = parse(html)
    if wrapper is None:
        return "\n".join(x.text for x in _shown(root) if x.text)
    return "\n".join(x.text for x in _content(root, wrapper) if x.text)


def _small(df: DataFrame) -> DataFrame:
    df = saved(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shapes(d: DataFrame) -> DataFrame:
    """host, layout, shape: one row for each layout of a host, and one of layout REST where some are rare, from up to SAMPLE different pages each."""

    def layouts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf[["host", "h"]].assign(layout=[layout_of(parse(h)) for h in pdf["html"]])

    keys = saved(d.mapInPandas(layouts, "host string, h long, layout string").distinct())
    sizes = saved(keys.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")))
    hosts = saved(sizes.groupBy("host").agg(F.count(F.lit(1)).alias("layouts"), F.min("n").alias("least")))
    own = sizes.join(hosts, "host").where((F.col("layouts") == 1) | (F.col("n") >= SAMPLE)).select("host", "layout")
    rest = hosts.where((F.col("layouts") > 1) & (F.col("least") < SAMPLE)).select("host")
    keys = keys.join(_small(own), ["host", "layout"], "left_semi").select("host", "layout", "h").unionByName(keys.join(_small(rest), "host", "left_semi").select("host", F.lit(REST).alias("layout"), "h"))
    # The least hash of each of CHOICES parts of a layout, summed up before the shuffle; the window ranks CHOICES rows of a layout.
    least = keys.groupBy("host", "layout", F.pmod("h", F.lit(CHOICES)).alias("part")).agg(F.min("h").alias("h"))
    rank = F.row_number().over(Window.partitionBy("host", "layout").orderBy("h"))
    chosen = least.withColumn("r", rank).where(F.col("r") <= SAMPLE).select("host", "layout", "h")
    few = d.join(_small(chosen), ["host", "h"]).dropDuplicates(["host", "layout", "h"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        top = induce(pdf.sort_values("h")["html"].tolist())
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "layout": [pdf["layout"].iloc[0]], "shape": [json.dumps(top.dump())]})

    return few.groupBy("host", "layout").applyInPandas(build, "host string, layout string, shape string")


def _each(d: DataFrame, wrappers: DataFrame, run: Callable[[pd.DataFrame, list[str | None]], pd.DataFrame], schema: str) -> DataFrame:
    """run(rows, the wrapper of each row's __host) over d. Wrappers of small size in all go to each worker; otherwise they are joined."""
    w = saved(wrappers)
    if (w.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        of = d.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in w.collect()})

        def with_table(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield run(pdf, [of.value.get(h) for h in pdf["__host"]])

        return d.mapInPandas(with_table, schema)
    # A host's pages are dealt to as many parts as HOT goes into their count; its wrapper goes to each.
    parts = saved(d.groupBy("__host").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("__parts")).where("__parts > 1"))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    salt = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*d.columns), F.col("__parts")).cast("int"))
    dealt = d.join(parts, "__host", "left").withColumn("__salt", salt).drop("__parts").select(*d.columns, "__salt")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__part")
    w = w.join(parts.withColumnRenamed("__host", "host"), "host", "left").select(F.col("host").alias("__on"), F.col("wrapper").alias("__wrapper"), every)
    joined = dealt.join(w, (dealt["__host"] == w["__on"]) & (dealt["__salt"] == w["__part"]), "left").drop("__on", "__part", "__salt")

    def with_column(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield run(pdf, pdf["__wrapper"].tolist())

    return joined.mapInPandas(with_column, schema)


def _of_hosts(layouts: DataFrame, *cols: str) -> DataFrame:
    """host, wrapper: the layouts' columns as JSON by layout."""
    return layouts.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layout", F.struct(*cols))))).alias("wrapper"))


def induce_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper: one row for each host: its layouts' shapes, and how many of its different pages have each text of a shape at its node."""
    d = pages.where(F.col(html).isNotNull()).select(url_host(F.col(url)).alias("host"), F.xxhash64(html).alias("h"), F.col(html).alias("html")).where("host IS NOT NULL")
    shapes = saved(_shapes(d))

    def hits(pdf: pd.DataFrame, wrappers: list[str | None]) -> pd.DataFrame:
        out = []
        for host, h, page, wrapper in zip(pdf["__host"], pdf["h"], pdf["html"], wrappers, strict=True):
            root = parse(page)
            of = _loaded(wrapper) if wrapper else {}
            for layout in (layout_of(root), REST):
                if layout in of:
                    seen, sums = _hits(of[layout].top, root)
                    out.append((host, layout, h, [-1, *seen], sums))
        return pd.DataFrame(out, columns=["host", "layout", "h", "hits", "sums"])

    # copies of a page count once
    found = _each(d.withColumnRenamed("host", "__host"), _of_hosts(shapes, "shape"), hits, "host string, layout string, h long, hits array<int>, sums array<array<long>>").dropDuplicates(["host", "layout", "h"])
    counts = found.select("host", "layout", F.explode("hits").alias("i")).groupBy("host", "layout", "i").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("host", "layout").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("counts"))
    sums = found.select("host", "layout", F.explode("sums").alias("s")).groupBy("host", "layout", F.col("s")[0].cast("int").alias("i")).agg(F.array(*[F.sum(F.col("s")[k]) for k in range(1, 8)]).alias("n"))
    stats = sums.groupBy("host", "layout").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("stats"))
    return _of_hosts(shapes.join(counts, ["host", "layout"]).join(stats, ["host", "layout"]), "shape", "counts", "stats")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """The kept columns and the main text of every page, repeated rows included.

    Null and empty html gives empty text; pages without a host share one wrapper; very long and deep pages are read
    whole; no rows give no rows; a kept column of the name `out` is replaced, other columns may have any names.
    """
    keep = tuple(c for c in keep if c != out)
    d, big = longs_as_text(pages.select(*keep, F.col(html).alias("__html"), url_host(F.col(url)).alias("__host")), list(keep))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields if f.name in keep) + f"`{out}` string"

    def run(pdf: pd.DataFrame, wrappers: list[str | None]) -> pd.DataFrame:
        return pdf[list(keep)].assign(**{out: [main_text(h, w) for h, w in zip(pdf["__html"], wrappers, strict=True)]})

    return longs_again(_each(d, induce_wrappers(pages, url, html), run, schema), big)
