"""Main-text extraction from HTML by tag-path ratios.

A page is read into text nodes, one for each block of text, each under its root-to-leaf path of tags with their classes (inline elements of a block belong to its path, unless they are named boilerplate). Per path, text length and punctuation are
summed over its nodes: a path's text ratio and punctuation ratio say how much running text its nodes hold. The ratios, on a log scale, are fused (added up) and smoothed along the page with a
Gaussian; a path's score is the mean over its nodes. Paths above a threshold, drawn from the page's best path, are content, and the smallest part of the page that holds them is the article. An article's mark and a heading
beside a path add to its score; what lies under tags or names of menus, notices, adverts, comments and so on is never content.

The text is that of every block of this part, short or long, but for what lies under such tags or names within it. Where the page has no narrower part than its body, blocks that are nothing but links are menus. What browsers don't show as text (scripts, styles,
hidden elements, controls of forms) is none here either.

Defined results: null and empty html, and pages without content, give an empty text. Character references are decoded; white
space inside a block becomes one space; blocks are trimmed, empty ones left out, and joined in page order by a line feed. Unclosed and
stray tags are put up with: an end tag closes its nearest open element; a new paragraph closes an open one; a quote that nothing closes is no quote; what follows an element
of raw text without an end (but scripts and styles) is read as if its tag were not there. Of paths with the same score none goes before another. Time grows with the page's length, whatever its nesting. Each row is worked on alone:
repeated rows give repeated results, null ids are kept, an empty table gives an empty one, and columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinwork.llm.scratch import map_arrow, table
from veinwork.llm.words import slices

_EDGE = re.compile(r"[>\"']")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")

# What HTML's elements are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text.
RAW = frozenset("script style textarea title noscript template svg iframe math canvas object xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Controls and what they belong to.
CONTROLS = frozenset("button select option input datalist dialog audio video map head".split())
#: What may stand in a page's head; anything else ends it.
_HEAD = frozenset("head html base link meta title script style noscript template".split())
#: Elements and words in class, id or role that speak of menus, page furniture and readers' words.
BOILER = frozenset("nav footer aside menu form fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer sidebar aside complementary contentinfo comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations pagination pager widget toolbar skip search hidden paywall toc masthead topbar".split()
)
MARKED = frozenset(["article", "main"])
MARKED_WORDS = frozenset("article main content post entry story articlebody postcontent maincontent".split())
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dd dt figcaption caption".split())
HEADINGS = frozenset(["h1", "h2", "h3"])
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、¿¡…]")
_CLOSES_P = BLOCK - {"option", "optgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "legend", "body", "html", "head"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Beyond so many characters and marks a node is running text, and more of them is no more so.
MOST_CHARS, MOST_MARKS = 400, 8
#: What a mark and a heading beside a path add to its score (powers of two), and the threshold's distance from the best path.
MARK_WEIGHT, HEADING_WEIGHT, BELOW_BEST = 2.0, 2.0, 3.5
_KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 0.7) ** 2)
_KERNEL /= _KERNEL.sum()


class _Element:
    """An open element. ``cell`` holds the number of the block that text directly in it belongs to; inline elements share their block's."""

    __slots__ = ("tag", "number", "path", "features", "cell", "block", "hidden")

    def __init__(self, tag: str, number: int, path: int, features: tuple[bool, bool, bool], cell: list[int], block: int, hidden: bool):
        self.tag, self.number, self.path, self.features, self.cell, self.block, self.hidden = tag, number, path, features, cell, block, hidden


class Page:
    """The text nodes of a page, in page order, and its elements.

    A node is [path, element, block, plain, marked, boiler, characters in links, texts]. ``parent`` has each element's parent, which has a smaller number; ``headed`` says whether a heading
    stands directly in it, ``tags`` has the tag."""

    def __init__(self, source: str):
        self.nodes: list[list] = []
        self.parent, self.headed, self.tags = [0], [False], ["html"]
        self._paths: dict[tuple, int] = {}
        self._stack = [_Element("", 0, 0, (False, False, False), [0], 0, False)]
        self._open: dict[str, list[int]] = {}
        self._blocks = 0
        self._read(source)

    def _emit(self, raw: str) -> None:
        top = self._stack[-1]
        if raw and not top.hidden:
            marked, boiler, link = top.features
            text, block = entities.unescape(raw), top.cell[0]
            if not self.nodes or self.nodes[-1][0] != top.path or self.nodes[-1][2] != block:
                self.nodes.append([top.path, top.number, block, self._stack[top.block].tag in PLAIN, marked, boiler, 0, []])
            self.nodes[-1][6] += len(text.strip()) * link
            self.nodes[-1][7].append(text)

    def _close(self, upto: int) -> None:
        broken = False
        while len(self._stack) > upto:
            e = self._stack.pop()
            self._open[e.tag].pop()
            broken = broken or e.tag in BLOCK
        if broken:
            self._blocks += 1
            self._stack[-1].cell[0] = self._blocks

    def _last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _read(self, source: str) -> None:
        at, n, dead, lower = 0, len(source), set(), None
        while at < n:
            start = source.find("<", at)
            if start < 0 or start + 1 >= n:
                self._emit(source[at:])
                return
            after = source[start + 1]
            if after in "!?":
                self._emit(source[at:start])
                for opens, closes, cut in (("<!--", "-->", 0), ("<![CDATA[", "]]>", 9), ("<", ">", 0)):
                    if source.startswith(opens, start):
                        end = source.find(closes, start + len(opens))
                        if cut:
                            self._emit(source[start + cut : end if end >= 0 else n])
                        at = n if end < 0 else end + len(closes)
                        break
                continue
            ends = after == "/"
            name = _TAG.match(source, start + 1 + ends)
            if not name:
                self._emit(source[at : start + 1])
                at = start + 1
                continue
            self._emit(source[at:start])
            at = name.end()
            while True:  # quotes after an equals sign may hold a ">"
                edge = _EDGE.search(source, at)
                if not edge:
                    return
                at = edge.end()
                if edge[0] == ">":
                    break
                if edge[0] not in dead and source[max(name.end(), edge.start() - 8) : edge.start()].rstrip().endswith("="):
                    close = source.find(edge[0], at)
                    if close < 0:
                        dead.add(edge[0])
                    else:
                        at = close + 1
            tag = name[0].lower()
            if ends:
                if i := self._last([tag]):
                    self._close(i)
                continue
            if tag in RAW:
                if tag not in dead:
                    lower = source.lower() if lower is None else lower
                    lower = lower if len(lower) == n else re.sub("[A-Z]+", lambda m: m[0].lower(), source)
                    end = lower.find(f"</{tag}", at)
                    if end >= 0:
                        end = source.find(">", end)
                        at = n if end < 0 else end + 1
                    else:
                        dead.add(tag)
                if tag in dead and tag in ("script", "style"):
                    return
                continue
            self._start(tag, source[name.end() : at - 1])

    def _start(self, tag: str, said: str) -> None:
        stack = self._stack
        if tag not in _HEAD and (i := self._last(["head"])):
            self._close(i)
        if tag in _CLOSES_P and (i := self._last(["p"])) and i >= stack[-1].block:
            self._close(i)
        while tag in _SAME and (i := self._last(_SAME[tag])) and i > self._last(_SCOPE[tag]):
            self._close(i)
            if tag != "tr":
                break
        if tag in VOID:
            if tag == "br":
                self._emit(" ")
            elif tag == "hr":
                self._blocks += 1
                stack[-1].cell[0] = self._blocks
            return
        names: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(said):
            names.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        top, classes = stack[-1], sorted(names.get("class", "").lower().split())
        marked, boiler, link = top.features
        # in an article, and of running text anywhere, a part of a name says nothing: a heading may be about comments
        whole = [*classes, *names.get("role", "").lower().split(), *([] if tag in PLAIN else names.get("id", "").lower().split())]
        words = set(whole) if marked or tag in PLAIN else {w for c in whole if not c.startswith(("has-", "with-", "no-")) for w in _NAME.findall(c)}
        hidden = top.hidden or tag in CONTROLS or "hidden" in names or names.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", names.get("style", "")))
        boiler = boiler or tag in BOILER or tag == "header" and not marked or tag not in ("html", "body", *MARKED) and bool(words & BOILER_WORDS)
        marked = marked or not boiler and (tag in MARKED or tag in ("div", "section", "td") and bool({w for c in whole for w in _NAME.findall(c)} & MARKED_WORDS))
        if tag in HEADINGS:
            self.headed[top.number] = True
        path, cell, block = top.path, top.cell, top.block
        if tag in BLOCK or boiler > top.features[1]:
            path = self._paths.setdefault((top.path, tag, *classes), len(self._paths) + 1)
        if tag in BLOCK:
            self._blocks += 1
            cell, block = [self._blocks], len(stack)
        elif said.rstrip().endswith("/"):
            return
        self.parent.append(top.number)
        self.headed.append(False)
        self.tags.append(tag)
        self._open.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, len(self.parent) - 1, path, (marked, boiler, link or tag == "a"), cell, block, hidden))


def ratios(paths: np.ndarray, texts: list[str]) -> np.ndarray:
    """Each path's fused ratio of text and punctuation, smoothed along the page and averaged over the path's nodes, and with it the path's share of the page's text; ``paths`` has numbers from 0."""
    nodes, chars = np.bincount(paths), np.bincount(paths, [len(t) for t in texts])
    size = chars / nodes
    marks = np.bincount(paths, [len(_PUNCTUATION.findall(t)) for t in texts]) / nodes
    fused = np.log2(1 + np.minimum(size, MOST_CHARS)) + np.log2(1 + np.minimum(marks, MOST_MARKS))
    smooth = np.convolve(np.pad(fused[paths], 2, mode="edge"), _KERNEL, "valid")
    return np.bincount(paths, smooth) / nodes + np.log2(chars / chars.sum())


def extract(source: str | None) -> str:
    """The main text of one page."""
    page = Page(source or "")
    full = [x for x in page.nodes if not all(map(str.isspace, x[7]))]
    if not full:
        return ""
    places, paths = np.unique([x[0] for x in full], return_inverse=True)
    texts = ["".join(x[7]).strip() for x in full]
    nodes, chars = np.bincount(paths), np.bincount(paths, list(map(len, texts)))
    share = lambda k: np.bincount(paths, [float(x[k]) for x in full]) / nodes
    plain, linked = share(5) == 0, share(6) * nodes / chars >= 1
    headed = list(page.headed)
    for e in range(1, len(headed)):  # parents come first
        headed[e] = headed[e] or headed[page.parent[e]]
    beside = np.bincount(paths, [float(headed[page.parent[x[1]]]) for x in full]) / nodes
    scores = np.where(plain, ratios(paths, texts) + MARK_WEIGHT * share(4) + HEADING_WEIGHT * beside, -np.inf)
    best = scores.max()
    if not np.isfinite(best):
        return ""
    content = set(places[scores >= best - BELOW_BEST].tolist())

    # the smallest part that holds all content
    below = np.bincount([x[1] for x in full if x[0] in content], minlength=len(page.parent))
    for e in range(len(below) - 1, 0, -1):
        below[page.parent[e]] += below[e]
    root = int(np.flatnonzero(below == below[0])[-1])
    while page.tags[root] in PLAIN or page.tags[root] not in BLOCK:  # what holds a paragraph may hold its heading
        root = page.parent[root]
    inside = [False] * len(page.parent)
    inside[root] = True
    for e in range(root + 1, len(inside)):
        inside[e] = inside[page.parent[e]]
    wanted = set(places[plain & ~(linked & (page.tags[root] in ("html", "body")))].tolist()) | content

    lines: list[str] = []
    last, held = None, []
    for path, element, block, *_, texts in full:
        if path not in wanted or not inside[element]:
            continue
        if block != last:
            lines.append("".join(held))
            held, last = [], block
        held += texts
    lines.append("".join(held))
    done = (_SPACE.sub(" ", t).strip() for t in lines)
    return "\n".join(t for t in done if t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page; a narrow pass."""
    types = {k: pages.schema[k].dataType.simpleString() for k in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
