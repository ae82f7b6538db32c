"""Main text of HTML pages by tag-path ratios.

A page is read once into elements and text nodes. Script, style, navigation, form, aside and
footer elements and hidden ones are left out from the start. Elements whose class, id or role names an advert,
notice, sidebar or comment thread are hinted unless they hold most of the content. Over the rest:

1. text length and punctuation are summed per root-to-leaf tag path and divided by the
   path's number of text nodes (the two tag-path ratios);
2. the two are fused into one value per path, given to each text node, and smoothed along the page;
3. text nodes at or above the standard deviation of these values are content; a hinted path's ratio is
   weighed by ``HINT_WEIGHT``, and its nodes must reach the bound and the mean unsmoothed too;
4. the lowest common ancestor of all content nodes is the article's container; where an ``article`` or ``main``
   element lies on its way to the root, that one.

The container's blocks come out whole: its short blocks (headings, list items) stay although their
own path scores low, except blocks that are links only and hinted nodes below the bound. Headings right
before the container stay.

White space (of Unicode) within a block becomes one space; ``br`` is white space; blocks are joined by two newlines.

Edge cases: null or empty html, and pages of boilerplate only, give the empty text; unclosed and
stray tags are tolerated; an unfinished tag at the end is text; repeated pages each give their row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu search audio video canvas map".split())
CONTAINER = frozenset("html body main article section div center table tbody tr td".split())
#: A start tag closes an open element of these names, up to the first of the barriers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
P_BARRIERS = frozenset("td th table caption object button html body div article section".split())
#: Words in class, id or role that name what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner "
    "sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup social share sharing related recommended recommendations "
    "breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar pager pagination footer comment comments disqus "
    "reply replies respond discussion masthead complementary contentinfo search dialog login paywall disclaimer".split())
OUTSIDE_HINTS = frozenset(["header"])
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|/?[a-zA-Z][^>]*>|[!?/][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
KERNEL = np.array([0.05, 0.25, 0.4, 0.25, 0.05])
HINT_WEIGHT = 0.1
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _left_out(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the element is left out for its name or as hidden, and whether its names hint at boilerplate."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    hint = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True, False
            continue
        words = {w.lower() for w in WORD.findall(value)}
        hint = hint or bool(words & HINTS or not inside and words & OUTSIDE_HINTS)
    return False, hint


class Page:
    """Elements (parent, tag, path, left out) and text nodes (element, block, length, punctuation) of one page."""

    def __init__(self, html: str):
        self.parent, self.tag, self.out, self.inside, self.path = [-1], [""], [False], [False], [0]
        self.hint = [False]
        self.paths: dict[tuple[int, str, bool], int] = {}
        self.nodes: list[tuple[int, int, int, int]] = []
        self.blocks: list[list[tuple[int, str]]] = [[]]  # node (-1: white space) and text
        self.block_at: list[int] = [0]
        #: places in the stack of the open elements of a tag, and of all block elements
        self.open_at: dict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self._read(html)

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        p = stack[-1]
        inside = self.inside[p]
        out, hint = _left_out(tag, attributes, inside)
        key = (self.path[p], tag, hint)
        self.parent.append(p)
        self.tag.append(tag)
        self.out.append(self.out[p] or out)
        self.hint.append(hint)
        self.inside.append(inside or tag in ("article", "main"))
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.open_at[tag].append(len(stack))
        if tag in BLOCK:
            self.open_blocks.append(len(stack))
        stack.append(len(self.tag) - 1)

    def _cut(self, stack: list[int], k: int) -> None:
        """Close the elements from place ``k`` of the stack on."""
        for element in stack[k:]:
            self.open_at[self.tag[element]].pop()
            if self.tag[element] in BLOCK:
                self.open_blocks.pop()
        del stack[k:]

    def _last(self, names) -> int:
        """Place of the last open element of these tags (0: none; the root is never closed)."""
        return max((at[-1] for at in (self.open_at.get(n) for n in names) if at), default=0)

    def _block(self, element: int) -> None:
        if self.blocks[-1]:
            self.blocks.append([])
            self.block_at.append(element)
        else:
            self.block_at[-1] = element

    def _close(self, stack: list[int], names, barriers) -> None:
        k = self._last(names)
        if k and k >= self._last(barriers):
            self._cut(stack, k)

    def _text(self, element: int, raw: str) -> None:
        if self.out[element]:
            return
        words = (unescape(raw) if "&" in raw else raw)
        if words and not words.isspace():
            self.nodes.append((element, len(self.blocks) - 1, len(words), len(PUNCTUATION.findall(words))))
            self.blocks[-1].append((len(self.nodes) - 1, words))
        elif words and self.blocks[-1]:
            self.blocks[-1].append((-1, " "))

    def _read(self, html: str) -> None:
        stack, at, end = [0], 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                self._text(stack[-1], html[at:stop])
            if not m:
                break
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                k = self._last((tag,))
                if tag in BLOCK:
                    if k:
                        self._cut(stack, k)
                    self._block(stack[-1])
                elif k and k > (self.open_blocks[-1] if self.open_blocks else 0):
                    self._cut(stack, k)
                continue
            if tag in RAW:
                if m[3].endswith("/") and tag in ("svg", "math", "object"):
                    continue
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = closing.end() if closing else end
                continue
            if tag == "br":
                self._text(stack[-1], " ")
                continue
            if tag in VOID:
                if tag in BLOCK:
                    self._block(stack[-1])
                continue
            if tag in BLOCK:
                self._close(stack, ("p",), P_BARRIERS)
                if tag in CLOSES:
                    self._close(stack, *CLOSES[tag])
                self._open(stack, tag, m[3])
                self._block(stack[-1])
            else:
                self._open(stack, tag, m[3])

    def _hinted(self, on: np.ndarray) -> np.ndarray:
        """Which text nodes lie in a hinted element that holds at most half of the content ``on``, or no part of the landmarks."""
        weight, marked = [0] * len(self.tag), [0] * len(self.tag)
        for (element, _, length, _), c in zip(self.nodes, on):
            weight[element] += length if c else 0
            marked[element] += length if self.inside[element] else 0
        for e in range(len(self.tag) - 1, 0, -1):
            weight[self.parent[e]] += weight[e]
            marked[self.parent[e]] += marked[e]
        hinted = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            hinted[e] = hinted[self.parent[e]] or self.hint[e] and (2 * weight[e] <= weight[0] or marked[e] == 0 < marked[0])
        return np.array([hinted[e] for e, _, _, _ in self.nodes])

    def content(self) -> tuple[np.ndarray, np.ndarray]:
        """Which text nodes are content, by their smoothed, fused tag-path ratio; which lie in hinted elements."""
        path = np.array([self.path[e] for e, _, _, _ in self.nodes])
        length = np.array([n for _, _, n, _ in self.nodes], dtype=float)
        marks = np.array([p for _, _, _, p in self.nodes], dtype=float)
        count = np.bincount(path).astype(float)
        text_ratio = np.bincount(path, length)[path] / count[path]
        mark_ratio = np.bincount(path, marks)[path] / count[path]
        fused = text_ratio * (1.0 + mark_ratio)

        def above(ratio):
            smooth = np.convolve(np.pad(ratio, 2, mode="edge"), KERNEL, mode="valid")
            bound = min(smooth.std(), smooth.max())
            return smooth >= bound, ratio >= max(bound, smooth.mean())

        hinted = self._hinted(above(fused)[0])
        if not hinted.any():
            return above(fused)[0], hinted
        smooth, own = above(np.where(hinted, HINT_WEIGHT * fused, fused))
        return smooth & (own | ~hinted), hinted

    def article(self, on: np.ndarray) -> int:
        """The element that holds the article: the lowest container above all content nodes, or its landmark."""
        held = [0] * len(self.tag)
        for (element, _, _, _), c in zip(self.nodes, on):
            held[element] += bool(c)
        for e in range(len(self.tag) - 1, 0, -1):  # a parent has the smaller number
            held[self.parent[e]] += held[e]
        # the elements above all content nodes are one line from the root down; the last of them is the lowest
        at = max((e for e in range(len(self.tag)) if held[e] == held[0]), default=0) if held[0] else 0
        while at and self.tag[at] not in CONTAINER:
            at = self.parent[at]
        for names in (("article",), ("main",)):
            e = at
            while e > 0:
                if self.tag[e] in names:
                    return e
                e = self.parent[e]
        return at

    def _heading(self, element: int) -> bool:
        while element > 0 and self.tag[element] not in HEADINGS:
            element = self.parent[element]
        return element > 0

    def text(self) -> str:
        if not self.nodes:
            return ""
        on, hinted = self.content()
        root = self.article(on)
        inside = [False] * len(self.tag)
        inside[root] = True
        for e in range(root + 1, len(self.tag)):
            inside[e] = inside[self.parent[e]]
        in_link = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            in_link[e] = self.tag[e] not in BLOCK and (self.tag[e] == "a" or in_link[self.parent[e]])
        linked: dict[int, int] = defaultdict(int)
        size: dict[int, int] = defaultdict(int)
        kept: set[int] = set()
        marks: dict[int, int] = defaultdict(int)
        stays = [inside[e] and bool(c or not h) for (e, _, _, _), c, h in zip(self.nodes, on, hinted)]
        for i in range(next((i for i, n in enumerate(self.nodes) if inside[n[0]]), 0) - 1, -1, -1):
            if hinted[i] or not self._heading(self.nodes[i][0]):
                break
            stays[i] = True
        for (element, block, length, punctuation), stay in zip(self.nodes, stays):
            if not stay:
                continue
            kept.add(block)
            size[block] += length
            marks[block] += punctuation
            if in_link[element]:
                linked[block] += length
        out = []
        for b in sorted(kept):
            if linked[b] == size[b] and not marks[b] and self.tag[self.block_at[b]] in ("li", "ul", "ol", "td", "div"):
                continue
            out.append(" ".join("".join(x for i, x in self.blocks[b] if i < 0 or stays[i]).split()))
        return "\n\n".join(x for x in out if x)


def main_text(html: str | None) -> str:
    """Main text of one page (empty for null)."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page; a narrow stage without a shuffle."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def batches(it):
        for batch in it:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", pages[html]).mapInArrow(
        batches, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
