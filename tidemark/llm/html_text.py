"""Operator 3: main text by wrapper induction.

1. Each page becomes an outline: the tree of its block elements with a leaf for each run of text, known by its hash.
2. For each host the commonest layouts (upper block structure) give reference pages, two a layout from different halves
   of its pages, short ones first.
3. Pages are aligned with the references of their layout by simple tree matching: the largest order-preserving mapping of
   equal tags. Runs that both pages have word for word carry a label, so that they only match each other. For each run of a
   reference it is counted how many pages match there and how many say the same. A run that hardly varies is template;
   within an article the share must be higher. Exact copies count once, near copies of the reference are no witnesses.
4. For each block of a reference the text is summed up that varies in the blocks matched with it. From the root on, the
   way leads to the inner block that holds at least GATHERED of it, unless prose or the title would stay outside. Where it
   ends the varying slots gather: this is the reference's content region.
5. Each page is aligned again: the block matched with the region holds its content, what matches a template run is dropped.

Markup that names its purpose (menus, headers, footers, sidebars, forms, code ...) marks slots as side matter, and
article or main elements mark content; they decide within the region, and alone where a host has none, a page has no block
for it, or the region misses most of a page's article. Names of classes and ids are the weakest mark; within an article those that may be
a topic as well mark no prose. The marks that leave a page without any text are lifted: those of forms or of names, whichever give
more text, then both. Without an article, runs of nothing but links are menus. Blocks end at block elements and are joined by newlines.

Edge cases: null or empty html gives an empty text; broken or unclosed markup is read as browsers do for the common cases; hosts with
fewer than LEAST_PAGES + 1 different pages have no template; a null or odd url is a host of its own kind; repeated rows are separate
pages; further columns are ignored; an empty table gives an empty result; flat lists of any length are aligned exactly, halved where
the table of the alignment would be large.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, attach, bounded_batches, saved

#: Fixed values of HTML: elements without content, with raw content, that end a block, and that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SIDE = frozenset("head nav aside footer button select menu dialog script style noscript template textarea title iframe svg object canvas".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Names of classes and ids: a purpose, alone or with words of place and shape around it.
PURPOSE = r"(?:ads?|advert\w*|banners?|sponsor\w*|promos?|promotions?|nav|navbar|navigation|menus?|breadcrumbs?|header|masthead|footer|sidebars?|widgets?|cookies?|consent|gdpr|notices?|popups?|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|disqus|replies|login|search)"
AROUND = r"(?:main|site|page|top|bottom|left|right|global|user|reader|post|article|primary|secondary|box|bar|wrap|wrapper|list|block|section|container|area|inner|outer|links?|form|text|body|item|unit|slot|[0-9]+)"
SIDE_NAME = re.compile(rf"(?:{AROUND}[-_])*{PURPOSE}(?:[-_](?:{AROUND}|{PURPOSE}))*", re.I)
#: Names that within an article mark no heading or prose, as they may be its topic, and the elements of prose; a header there holds the title.
TOPICAL = re.compile(r"(?:search|social|navigation|login|notices?|menus?|share|sharing|widgets?|banners?|sponsor\w*)", re.I)
TITLED = re.compile(rf"(?:{AROUND}[-_])*header", re.I)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PROSE = frozenset((*HEADINGS, "p", "blockquote", "pre"))
#: Blocks that may be a content region, and the share of a block's varying text from which on an inner block holds its content.
REGIONS = frozenset("html body div section main article form table tbody tr td center".split())
GATHERED = 0.7
PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
#: Marks of side matter from weak to strong: a name, a form, an element or attribute that says so.
NAME, FORM, TAG = 1, 2, 4
#: Of the pages that match a reference's run, the share that must say the same to make it template (within an article), and the least number.
SAME_SHARE, ARTICLE_SHARE, LEAST_PAGES = 0.6, 0.9, 3
#: Reference pages of a host, and characters of an outline up to which one is as good as another.
REFERENCES, OUTLINE_CHARS = 4, 20_000
#: Word hashes kept of a page to tell near copies, and the similarity from which on pages are near copies.
SKETCH, COPY = 64, 0.6
LONG_WORD = re.compile(r"\S{6,}")
#: Elements nested deeper than this (side matter: 50 more) stand beside each other; their text is kept.
DEPTH = 150
#: Cells of an alignment's table that are held at once.
CELLS = 16_000_000
#: Cells up to which an alignment is made without arrays.
FEW_CELLS = 60
#: Characters from which on a text that both pages have is labelled; shorter ones match by their place alone.
LABELLED = 8
#: Bytes of all references up to which they are broadcast (after adding them up); beyond, they are joined by host.
BROADCAST_BYTES = 32 << 20


class Node:
    __slots__ = ("tag", "mark", "children", "text")

    def __init__(self, tag: str, mark: int = 0, text: str = ""):
        self.tag, self.mark, self.text, self.children = tag, mark, text, []


def side_name(name: str, tag: str, within: bool) -> bool:
    """Whether a name of a class or id marks side matter, also ``within`` an article."""
    if not SIDE_NAME.fullmatch(name):
        return False
    return not within or tag not in HEADINGS and not TITLED.fullmatch(name) and not ((tag in PROSE or tag == "section") and TOPICAL.fullmatch(name))


def mark_of(tag: str, attributes: str, open_tags: list = ()) -> int:
    if tag in SIDE:
        return TAG
    mark = FORM if tag == "form" else 0
    for name, value in NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in SIDE_ROLES or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            mark |= TAG
        elif name in ("class", "id") and tag not in ("body", "html") and any(side_name(x, tag, any(n.tag in ("article", "main") for n in open_tags)) for x in value.split()):
            mark |= NAME
    return mark


def parse(page: str) -> Node:
    """The element tree; text nodes have the tag '#'."""
    root = Node("")
    stack, at = [root], 0
    while m := PIECE.search(page, at):
        tag = (m[2] or "").lower()
        if m.start() > at:
            stack[-1].children.append(Node("#", text=page[at:m.start()]))
        at = m.end()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(Node("#", text=m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "td", "th") and tag in ("p", "li", "b", "i", "span", "a", "em", "strong"):
                    break
            continue
        top = stack[-1].tag
        while top in CLOSES and tag in CLOSES[top]:
            stack.pop()
            top = stack[-1].tag
        if tag in BLOCK:  # an open paragraph ends at a block, even under inline elements
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        node = Node(tag, mark_of(tag, m[3], stack))
        if tag == "header" and not any(x.tag in ("article", "main") for x in stack):
            node.mark |= TAG
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:  # nothing in it is markup; the search goes on behind its end
            close = re.compile(f"</{tag}\\b", re.I).search(page, at)
            end = page.find(">", close.start()) if close else -1
            at = len(page) if end < 0 else end + 1
            continue
        if len(stack) < DEPTH or node.mark and len(stack) < DEPTH + 50:
            stack.append(node)
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<(?:[a-zA-Z/!?])[^>]*$", rest)
        stack[-1].children.append(Node("#", text=rest[:cut.start()] if cut else rest))
    return root


def plain(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


class Run:
    """A run of text between block borders: ``mark`` unites those around it, ``linked`` tells that it is links only."""
    __slots__ = ("text", "mark", "article", "linked")

    def __init__(self, text: str, mark: int, article: bool, linked: bool):
        self.text, self.mark, self.article, self.linked = text, mark, article, linked


def outline(root: Node) -> tuple[list, list[Run]]:
    """The tree of blocks, [tag, child ...] with the numbers of runs as leaves, and the runs in page order."""
    runs: list[Run] = []
    tree: list = [""]
    gather(root, tree, runs, 0, False, False)

    def pruned(block: list) -> list:
        return [block[0], *(c if isinstance(c, int) else p for c in block[1:] if isinstance(c, int) or len(p := pruned(c)) > 1)]

    return pruned(tree), runs


def gather(root: Node, tree: list, runs: list[Run], mark: int, article: bool, link: bool) -> None:
    """Append the blocks and runs below ``root``. Side matter amid a line is a run of its own and doesn't cut the line."""
    held: list[str] = []
    links, others = 0, False  # links in the run, and whether there is text outside them

    # what is open: element, block of the outline, marks, within an article, within a link; no element closes a block
    todo: list = [(None, tree, mark, article, link), *((c, tree, mark, article, link) for c in reversed(root.children))]
    while todo:
        node, block, mark, article, link = todo.pop()
        if node is not None and node.tag not in BLOCK:
            if node.tag == "#":
                held.append(node.text)
                others = others or not link and any(map(str.isalnum, node.text))
            elif node.tag == "br":
                held.append(" ")
            elif node.tag not in RAW and node.tag != "head":
                if node.mark and not mark:
                    gather(node, block, runs, node.mark, article, link)
                    continue
                links += node.tag == "a"
                todo += [(c, block, mark | node.mark, article, link or node.tag == "a") for c in reversed(node.children)]
            continue
        text = plain("".join(held))
        if text:
            block.append(len(runs))
            runs.append(Run(text, mark, article, links > 1 and not others))
        held.clear()
        links, others = 0, False
        if node is not None:
            own = [node.tag]
            block.append(own)
            mark, article = mark | node.mark, article or node.tag in ("article", "main")
            todo += [(None, own, mark, article, link), *((c, own, mark, article, link) for c in reversed(node.children))]


def run_hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


class Shapes:
    """Outlines whose equal subtrees share a number. A leaf's kind is 0 or the label of a text."""

    def __init__(self) -> None:
        self.number: dict = {}
        self.tag: list = []      # None for leaves
        self.kids: list = []     # numbers of the children
        self.leaves: list = []   # leaves below
        self.blocks: list = []   # blocks of it, itself included
        self.size: list = []
        self.memo: dict = {}

    def of(self, key: tuple, tag: str | None, kids: tuple) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.tag)
            self.tag.append(tag)
            self.kids.append(kids)
            self.leaves.append(sum([self.leaves[k] for k in kids]) if tag is not None else 1)
            self.blocks.append(1 + sum([self.blocks[k] for k in kids]) if tag is not None else 0)
            self.size.append(1 + sum([self.size[k] for k in kids]))
        return at

    def add(self, tree: list, kinds: list[int]) -> int:
        """Number of an outline; ``kinds`` has the kind of each of its runs."""
        of, kids = self.of, []
        for c in tree[1:]:
            kids.append(of((None, kinds[c]), None, ()) if type(c) is int else self.add(c, kinds))
        whole = tuple(kids)
        return of((tree[0], whole), tree[0], whole)

    def simple(self, k: int) -> tuple[int, int]:
        """Tag and leaf of a block with nothing but one leaf; (-1, leaf) for a leaf, (-2, k) otherwise."""
        if self.tag[k] is None:
            return -1, k
        kids = self.kids[k]
        return (self.of(("tag", self.tag[k]), self.tag[k], ()), kids[0]) if len(kids) == 1 and self.tag[kids[0]] is None else (-2, k)

    def score(self, a: int, b: int) -> int:
        """Size of the largest simple tree matching."""
        if a == b:
            return self.size[a]
        if self.tag[a] != self.tag[b] or self.tag[a] is None:
            return 0
        if (a, b) not in self.memo:
            n, x, y, _ = self.ends(a, b)
            last = self.last_row(x, y)
            self.memo[a, b] = 1 + n + (int(last[-1]) if len(x) and len(y) else 0)
        return self.memo[a, b]

    def ends(self, a: int, b: int) -> tuple[int, tuple, tuple, tuple[int, int]]:
        """Equal children at both ends belong together in a largest matching: their score, what is between, their numbers."""
        x, y = self.kids[a], self.kids[b]
        i, most = 0, min(len(x), len(y))
        while i < most and x[i] == y[i]:
            i += 1
        j = 0
        while j < most - i and x[len(x) - 1 - j] == y[len(y) - 1 - j]:
            j += 1
        return sum(self.size[k] for k in x[:i]) + sum(self.size[k] for k in x[len(x) - j:]), x[i:len(x) - j], y[i:len(y) - j], (i, j)

    def weights(self, x: tuple, y: tuple) -> Iterator[np.ndarray]:
        """For each child of the one side its scores with all children of the other."""
        tags, leaves = np.array([self.simple(k) for k in y], np.int32).T.copy()
        hard: dict[int, list[int]] = defaultdict(list)
        for j in np.flatnonzero(tags == -2).tolist():
            hard[y[j]].append(j)
        every: dict[int, list[int]] | None = None
        for k in x:
            tag, leaf = self.simple(k)
            row = (tags == tag).astype(np.int32)
            if tag != -2:
                row *= (leaves == leaf).astype(np.int32) + int(tag != -1)
                if tag == -1:
                    yield row
                    continue
            else:
                row[:] = 0
            if tag == -2 and every is None:
                every = defaultdict(list)
                for j, d in enumerate(y):
                    every[d].append(j)
            for d, places in (every if tag == -2 else hard).items():
                row[places] = self.score(k, d)
            yield row

    def last_row(self, x: tuple, y: tuple) -> np.ndarray:
        best = np.zeros(len(y) + 1, np.int32)
        if len(y):
            for row in self.weights(x, y):
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(row > 0, best[:-1] + row, 0)))
        return best

    def few_pairs(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        best, score = [[0] * (len(y) + 1)], []
        for k in x:
            up, row, own = best[-1], [0], [self.score(k, d) for d in y]
            for j, w in enumerate(own):
                row.append(max(up[j + 1], row[j], up[j] + w if w else 0))
            best.append(row)
            score.append(own)
        i, j, out = len(x), len(y), []
        while i and j:
            w = score[i - 1][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def pairs(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        """Places of the children matched in a largest matching of both lists."""
        if not len(x) or not len(y):
            return []
        if len(x) * len(y) <= FEW_CELLS:
            return self.few_pairs(x, y)
        if len(x) * len(y) > CELLS and len(x) > 1:  # halves, whose border is where forward and backward scores add up best
            half = len(x) // 2
            j = int(np.argmax(self.last_row(x[:half], y) + self.last_row(x[:half - 1:-1], y[::-1])[::-1]))
            return self.pairs(x[:half], y[:j]) + [(half + p, j + q) for p, q in self.pairs(x[half:], y[j:])]
        best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        took = np.zeros((len(x), len(y)), bool)
        for i, row in enumerate(self.weights(x, y)):
            with_it = np.where(row > 0, best[i, :-1] + row, 0)
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], with_it))
            took[i] = (row > 0) & (with_it == best[i + 1, 1:])
        i, j, out = len(x), len(y), []
        while i and j:
            if took[i - 1, j - 1]:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def matched(self, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Leaves and blocks (by their numbers in page order) that a largest matching brings together."""
        out, blocks, todo = [], [], [(a, b, 0, 0, 0, 0)]
        while todo:
            a, b, m, n, c, d = todo.pop()
            if a == b:
                out += [(m + k, n + k) for k in range(self.leaves[a])]
                blocks += [(c + k, d + k) for k in range(self.blocks[a])]
                continue
            blocks.append((c, d))
            x, y = self.kids[a], self.kids[b]
            _, p, q, (i, j) = self.ends(a, b)
            both = [(k, k) for k in range(i)] + [(i + k, i + h) for k, h in self.pairs(p, q)] + [(len(x) - j + k, len(y) - j + k) for k in range(j)]
            before_x, before_y = [0, *accumulate([self.leaves[k] for k in x])], [0, *accumulate([self.leaves[k] for k in y])]
            block_x, block_y = (list(accumulate([self.blocks[k] for k in z], initial=e + 1)) for z, e in ((x, c), (y, d)))
            todo += [(x[k], y[h], m + before_x[k], n + before_y[h], block_x[k], block_y[h]) for k, h in both]
        return out, blocks


def spans(tree: list) -> list[tuple[str, int, int, list[int]]]:
    """For each block of an outline, in page order: its tag, its first run and the one behind its last, its inner blocks."""
    out: list = []

    def walk(block: list, first: int) -> int:
        own = len(out)
        out.append(None)
        inner, end = [], first
        for c in block[1:]:
            if isinstance(c, int):
                end = c + 1
            else:
                inner.append(len(out))
                end = walk(c, end)
        out[own] = (block[0], first, end, inner)
        return end

    walk(tree, 0)
    return out


def region_of(tree: list, varying: dict[int, float], template: set[int]) -> int:
    """Number of the block where the slots gather, -1 if it is the whole page. ``varying`` is the varying text of the blocks."""
    blocks, at = spans(tree), 0
    heads = [(tag, first, end) for tag, first, end, _ in blocks if tag in HEADINGS and any(k not in template for k in range(first, end))]
    level = min((h[0] for h in heads), default=None)
    titles = [(first, end) for tag, first, end in heads if tag == level]
    while True:
        tag, _, _, inner = blocks[at]
        if tag == "article" or tag == "main" and not any(blocks[c][0] == "article" for c in inner):
            break
        best = max((c for c in inner if blocks[c][0] in REGIONS), key=lambda c: varying.get(c, 0), default=None)
        if best is None or not varying.get(best) or varying[best] < GATHERED * varying.get(at, varying[best]):
            break
        low, high = blocks[best][1:3]
        if any(c != best and blocks[c][0] in PROSE and varying.get(c) for c in inner) or any(first < low for first, _ in titles) and not any(low <= first and end <= high for first, end in titles):
            break
        at = best
    return at if blocks[at][0] not in ("", "html", "body") else -1


def align(tree: list, hashes: list[int], other: list, labelled: dict[int, int] | set[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of runs and of blocks of two outlines (``other`` is outline and hashes); runs whose hash is labelled match only their like."""
    shapes, kinds = Shapes(), {h: i for i, h in enumerate(labelled, 1)}
    first = shapes.add(tree, [kinds.get(h, 0) for h in hashes])
    second = shapes.add(other[0], [kinds.get(h, 0) for h in other[1]])
    return shapes.matched(first, second) if shapes.tag[first] == shapes.tag[second] else ([], [])


def sketch(runs: list[Run]) -> list[int]:
    """The smallest hashes of the longer words in longer runs, to tell near copies."""
    words = set(LONG_WORD.findall(" ".join([r.text for r in runs if len(r.text) >= 80])))
    return sorted([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words])[:SKETCH]


def near_copies(a: list[int], b: list[int]) -> bool:
    if not a or not b:
        return False
    x, y = set(a), set(b)
    least = sorted(x | y)[:SKETCH]
    return sum(h in x and h in y for h in least) >= COPY * len(least)


def layout(tree: list, depth: int = 4) -> int:
    """A number for the upper block structure; repeats and what text is made of don't count."""
    def shape(t: list, left: int) -> tuple:
        kids = [shape(c, left - 1) for c in t[1:] if not isinstance(c, int) and c[0] in ("html", "body", "div", "section", "main", "article", "header", "footer", "nav", "aside", "form", "table")] if left else []
        return t[0], tuple(k for i, k in enumerate(kids) if not i or k != kids[i - 1])

    return zlib.crc32(repr(shape(tree, depth)).encode())


def chosen(runs: list[Run], dropped: set[int]) -> str:
    """Content of the page by its markup: the runs under the fewest lifted marks that there are, without ``dropped`` ones."""
    article = any(r.article for r in runs)
    for within in (True, False) if article else (False,):
        by_lifted = []
        for lifted in (0, FORM, NAME, NAME | FORM):
            kept = [i for i, r in enumerate(runs) if not r.mark & ~lifted and (r.article or not within and not r.linked)]
            by_lifted.append((sum(len(runs[i].text) for i in kept), kept))
            if not lifted and kept:
                break
        kept = by_lifted[0][1] or max(by_lifted[1:3], key=lambda x: x[0])[1] or by_lifted[3][1]
        if kept:
            return "\n".join(runs[i].text for i in kept if i not in dropped)
    return ""


def within_region(runs: list[Run], low: int, high: int, dropped: set[int]) -> str | None:
    """Content of the page in its region, runs ``low`` to ``high``; None if there is none or most of an article lies elsewhere."""
    common = ~0
    for r in runs[low:high]:
        common &= r.mark
    inside = [i for i in range(low, high) if not runs[i].mark & ~common]
    article = [i for i, r in enumerate(runs) if r.article and not r.mark & ~common]
    held = [i for i in article if low <= i < high]
    if common & TAG or 2 * sum(len(runs[i].text) for i in held) < sum(len(runs[i].text) for i in article):
        return None
    return "\n".join(runs[i].text for i in held or inside if i not in dropped and (held or not runs[i].linked)) or None


def extract(page: str, references: list[tuple[list, list[int], set[int], int]] = ()) -> str:
    """Main text of a page; each reference is an outline, the hashes of its runs, the numbers of its template runs and of its
    content region (-1: none). The first reference whose region has a block in the page tells the page's region."""
    tree, runs = outline(parse(page))
    dropped: set[int] = set()
    region = None
    if runs and references:
        hashes = [run_hash(r.text) for r in runs]
        for other, known, template, place in references:
            labels = {known[k] for k in template}
            if labels.isdisjoint(hashes) and (place < 0 or region):
                continue
            leaves, blocks = align(tree, hashes, [other, known], labels)
            dropped |= {i for i, k in leaves if k in template and known[k] == hashes[i]}
            own = next((c for c, d in blocks if d == place), -1)
            if region is None and own >= 0:
                region = spans(tree)[own][1:3]
    text = within_region(runs, *region, dropped) if region else None
    return chosen(runs, dropped) if text is None else text


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def outlines(rows: DataFrame) -> DataFrame:
    """host, layout, half, form (as JSON: outline, hashes, runs in an article, sketch, hashes of longer runs, characters of
    each run, none if it is marked or of links) of each page that has text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, page in zip(batch["host"], batch["html"]):
                tree, runs = outline(parse(page))
                if runs:
                    hashes = [run_hash(r.text) for r in runs]
                    long = [h for h, r in zip(hashes, runs) if len(r.text) >= LABELLED]
                    form = json.dumps([tree, hashes, [i for i, r in enumerate(runs) if r.article and not r.mark], sketch(runs), long,
                                       [0 if r.linked or r.mark & (TAG | NAME) else len(r.text) for r in runs]], separators=(",", ":"))
                    out.append((host, layout(tree), zlib.crc32(repr(hashes).encode()) % 2, form))
            yield pd.DataFrame(out, columns=["host", "layout", "half", "form"]).astype({"layout": "int64", "half": "int32"})

    return rows.select("host", "html").mapInPandas(run, "host string, layout long, half int, form string")


def with_references(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows and the ``refs`` of their host (null: none); broadcast only after adding up the references' bytes."""
    told = hosts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if told["b"] <= BROADCAST_BYTES:
        right = F.broadcast(hosts.select(F.col("host").alias("__host"), "refs"))
        return rows.join(right, rows["host"] == right["__host"], "left").drop("__host")
    # beyond that hot hosts are dealt to as many parts as they have shares of all pages
    parts = F.least(F.ceil(F.col("n") * 200 / F.lit(max(1, told["n"]))), F.lit(200)).cast("int")
    salts = hosts.withColumn("__k", parts).select("host", "refs", "__k", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("__salt"))
    dealt = attach(rows, hosts.select("host", parts.alias("__k"), "n"), ["host"], "n", told["n"])
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "host"]), F.coalesce("__k", F.lit(1))).cast("int")).drop("__k")
    return dealt.join(salts.drop("__k"), ["host", "__salt"], "left").drop("__salt")


def wrappers(rows: DataFrame) -> DataFrame:
    """host, n, bytes and refs (layout, id, form, template, region) of each host that has text; ``template`` numbers the
    form's runs, ``region`` the block with its content."""
    known = saved(outlines(rows), "outlines")
    size = F.greatest(F.length("form"), F.lit(OUTLINE_CHARS))
    best = known.groupBy("host", "layout", "half").agg(F.count("*").alias("n"), F.min_by("form", F.struct(size, F.xxhash64("form"))).alias("form"))
    by_use = Window.partitionBy("host").orderBy(F.desc("n"), "layout", "half")
    refs = best.withColumn("k", F.row_number().over(by_use)).filter(F.col("k") <= REFERENCES)
    ref = F.struct("layout", F.col("k").alias("id"), "form")
    hosts = saved(refs.groupBy("host").agg(F.sum(F.length("form")).cast("long").alias("bytes"), F.sort_array(F.collect_list(ref)).alias("refs"))
                  .join(known.groupBy("host").agg(F.count("*").alias("n")), "host"), "references")

    def witness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each run of the references how many pages match it and say the same; for each block (as -1 - its number) how
        many match it and how much text varies in them. Summed up in the task."""
        met: dict = defaultdict(lambda: [0, 0])
        loaded: dict = {}
        for batch in batches:
            for host, kind, form, others in zip(batch["host"], batch["layout"], batch["form"], batch["refs"]):
                tree, hashes, _, words, long, chars = json.loads(form)
                own = spans(tree)
                for r in [r for r in others if r["layout"] == kind] or others:
                    if r["form"] == form:
                        continue
                    if r["form"] not in loaded:
                        if len(loaded) > 1000:
                            loaded.clear()
                        loaded[r["form"]] = json.loads(r["form"])
                    other = loaded[r["form"]]
                    if near_copies(words, other[3]):
                        continue
                    leaves, blocks = align(tree, hashes, other, {*long} & {*other[4]})
                    vary = chars.copy()
                    for i, k in leaves:
                        got = met[host, r["id"], k]
                        got[0] += 1
                        if hashes[i] == other[1][k]:
                            got[1] += 1
                            vary[i] = 0
                    below = [0, *accumulate(vary)]
                    for c, d in blocks:
                        tag, first, end, _ = own[c]
                        if tag in REGIONS or tag in PROSE or not c:
                            got = met[host, r["id"], -1 - d]
                            got[0] += 1
                            got[1] += below[end] - below[first]
        yield pd.DataFrame([(h, i, k, n, same) for (h, i, k), (n, same) in met.items()], columns=["host", "id", "run", "met", "same"])

    seen = with_references(known.dropDuplicates(["host", "form"]), hosts).select("host", "layout", "form", "refs").mapInPandas(witness, "host string, id int, run int, met long, same long")
    seen = seen.groupBy("host", "id", "run").agg(F.sum("met").alias("met"), F.sum("same").alias("same")).filter(F.when(F.col("run") < 0, F.col("met")).otherwise(F.col("same")) >= LEAST_PAGES)
    steady = seen.groupBy("host", "id").agg(F.map_from_entries(F.collect_list(F.struct("run", F.when(F.col("run") < 0, F.col("same")).otherwise(F.col("same") / F.col("met")).alias("share")))).alias("shares"))
    each = hosts.select("host", F.explode("refs").alias("r")).select("host", "r.*").join(steady, ["host", "id"], "left")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Template runs of a reference by their shares, within an article by a higher one; its region by the text of its blocks."""
        for batch in batches:
            template, region = [], []
            for form, shares in zip(batch["form"], batch["shares"]):
                tree, _, article, *_ = json.loads(form)
                shares = dict(shares or {})
                steady, inside = [k for k, s in shares.items() if k >= 0 and s >= SAME_SHARE], set(article)
                template.append([k for k in steady if k not in inside or shares[k] >= ARTICLE_SHARE])
                region.append(region_of(tree, {-1 - k: s for k, s in shares.items() if k < 0}, set(steady)))
            yield batch[["host", "layout", "id", "form"]].assign(template=template, region=region)

    told = each.select("host", "layout", "id", "form", "shares").mapInPandas(decide, "host string, layout long, id int, form string, template array<int>, region int")
    told = told.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("layout", "id", "form", F.sort_array("template").alias("template"), "region"))).alias("refs"))
    return saved(hosts.select("host", "n", "bytes").join(told, "host"), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    rows = bounded_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict = {}
        for batch in batches:
            texts = []
            for page, others in zip(batch["html"], batch["refs"]):
                refs = []
                for r in others if others is not None else ():
                    key = r["form"], tuple(r["template"]), r["region"]
                    if key not in loaded:
                        if len(loaded) > 1000:
                            loaded.clear()
                        form = json.loads(r["form"])
                        loaded[key] = (form[0], form[1], set(r["template"]), r["region"])
                    if len(r["template"]) or r["region"] >= 0:
                        refs.append(loaded[key])
                texts.append(extract(page, refs))
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    return with_references(rows, wrappers(rows)).select(as_text("page_id"), "url", "html", "refs").mapInPandas(cut, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
