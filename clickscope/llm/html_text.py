"""Main text of web pages by composite text density.

A page's HTML becomes a DOM (unclosed and misplaced tags are put right the usual way).
Elements that are never article text are cut off while reading: scripts, styles, menus,
forms, and what class, id or role name as advert, notice, sidebar, comment and the like.
For every node left: characters per tag, adjusted by the share of link characters and
link tags (Sun, Song and Liao, "DOM Based Content Extraction via Text Density", 2011).
The block whose child blocks' densities have the greatest sum holds the article (inline
elements are text of their block).  If it lies
in an ``article`` or ``main`` element, all of that element is taken; else the node, and
beside its path from the body all siblings whose density reaches the path's threshold,
the least density on it, the body's own children too.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import fresh, ship

ship(__name__)

# Fixed values of HTML: which elements have no content, hold raw text, form blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split())
#: An opening tag of the first kind ends an open element of the second, up to the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tbody"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "tbody"]), frozenset(["table"])),
}
#: Never article text.
CUT_TAGS = frozenset(
    "head script style noscript template nav menu footer aside form button select textarea input label iframe object svg "
    "canvas audio video map dialog title".split())
CUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|aside|menu\w*|nav\w*|breadcrumbs?|footer\w*|"
    r"header|masthead|cookies?|consent|gdpr|notices?|notification\w*|alert|popup|modal|newsletter|subscribe|signup|login|social|"
    r"shar(?:e|ing)|related|recommend\w*|comments?|disqus|repl(?:y|ies)|respond|widgets?|toolbar|pag(?:er|ination)|skip|search|"
    r"complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
KEEP_TAGS = frozenset(["html", "body", "article", "main"])

_MARKUP = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?=[\s=>/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _cut_off(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CUT_TAGS or tag == "header" and not in_article:
        return True
    if attributes and tag not in KEEP_TAGS:
        for name, *values in _NAMED.findall(attributes):
            name, value = name.lower(), html.unescape("".join(values))
            if name in ("class", "id", "role") and CUT_NAMES.search(value):
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True
    return False


class Page:
    """Nodes in document order (so a subtree is a run of them) and the text in order."""

    def __init__(self, text: str):
        self.tag, self.parent, self.cut, self.article = ["#"], [-1], [False], [-1]
        self.last = [0]  # last node of the subtree
        self.items: list[tuple[int, str | None]] = []  # (node, text) or (node, None) at the edge of a block
        # depths of open elements, by name and of blocks: no tag has to walk the stack
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self._read(text)

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            self.last[i] = len(self.tag) - 1
            if not i:
                continue
            self.depths[self.tag[i]].pop()
            if self.tag[i] in BLOCK:
                self.blocks.pop()
                self.items.append((i, None))

    def _read(self, text: str) -> None:
        stack, at, n = [0], 0, len(text)
        while at < n:
            found = _MARKUP.search(text, at)
            end = found.start() if found else n
            if end > at and not self.cut[stack[-1]]:
                self.items.append((stack[-1], html.unescape(text[at:end])))
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._end(stack, tag)
                continue
            self._start(stack, tag, found[3] if found[2] else found[6])
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
                at = stop.start() if stop else n
        self._close(stack, 0)

    def _start(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in BLOCK and self.blocks and self.tag[stack[self.blocks[-1]]] == "p":  # an open paragraph ends here
            self._close(stack, self.blocks[-1])
        if tag in ENDS:
            ended, scope = ENDS[tag]
            edge = max((self.depths[name][-1] for name in scope if self.depths[name]), default=0)
            inside = [d[k] for name in ended if (k := bisect_right(d := self.depths[name], edge)) < len(d)]
            if inside:
                self._close(stack, min(inside))
        up, i = stack[-1], len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.article.append(i if tag in ("article", "main") and self.article[up] < 0 else self.article[up])
        self.cut.append(self.cut[up] or _cut_off(tag, attributes, self.article[up] >= 0))
        self.last.append(i)
        if tag in BLOCK:
            self.items.append((i, None))
        if tag == "br" and not self.cut[i]:
            self.items.append((i, " "))
        if tag not in VOID:
            self.depths[tag].append(len(stack))
            if tag in BLOCK:
                self.blocks.append(len(stack))
            stack.append(i)

    def _end(self, stack: list[int], tag: str) -> None:
        if not self.depths[tag]:
            return
        at = self.depths[tag][-1]
        if tag not in BLOCK and self.blocks and self.blocks[-1] > at:
            return  # the end of an inline element does not end a block
        self._close(stack, at)

    def main_nodes(self) -> list[int]:
        """Roots, in document order, of the subtrees that hold the article."""
        size = len(self.tag)
        chars, link_chars = [0] * size, [0] * size
        tags, link_tags = [1] * size, [1 if t == "a" else 0 for t in self.tag]
        for i, text in self.items:
            if text is not None:
                chars[i] += len(text.strip())
        for i in range(size):
            if self.tag[i] == "a":
                link_chars[i] = -1
        for i in range(size - 1, 0, -1):  # children come after their parents
            if self.cut[i]:
                continue
            if link_chars[i] < 0 or self.tag[i] == "a":
                link_chars[i] = chars[i]
            up = self.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i]
            link_tags[up] += link_tags[i]
            if link_chars[up] >= 0:
                link_chars[up] += link_chars[i]
        body_share = link_chars[0] / max(chars[0], 1)
        # inline elements are part of their block: neither candidates nor terms of a sum
        block_above = [0] * size
        for i in range(1, size):
            up = self.parent[i]
            block_above[i] = up if self.tag[up] in BLOCK else block_above[up]
        density, child_sum, has_child = [0.0] * size, [0.0] * size, [False] * size
        for i in range(size):
            if chars[i] and not self.cut[i]:
                c, lc = chars[i], max(link_chars[i], 0)
                base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
                spread = math.log(max(c / max(lc, 1) * tags[i] / max(link_tags[i], 1), 1.0))
                density[i] = c / tags[i] * spread / max(1.0, math.log(max(base, math.e)))
                if self.tag[i] in BLOCK:
                    child_sum[block_above[i]] += density[i]
                    has_child[block_above[i]] = True
        score = [child_sum[i] if has_child[i] else density[i] for i in range(size)]
        best = max((i for i in range(size) if not i or self.tag[i] in BLOCK), key=lambda i: (score[i], -i))
        if not chars[best]:
            return []
        if self.article[best] >= 0:
            return [self.article[best]]
        path = [best]
        while self.parent[path[-1]] > 0:
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        on_path, roots = set(path), [best]
        for i in range(1, size):
            if i not in on_path and self.parent[i] in on_path and self.parent[i] != best and not self.cut[i] \
                    and density[i] >= threshold and chars[i]:
                roots.append(i)
        return sorted(roots)

    def main_text(self) -> str:
        blocks, now = [], []
        roots = self.main_nodes()
        k = 0
        for i, text in self.items:
            while k < len(roots) and i > self.last[roots[k]] and text is not None:
                k += 1
            inside = k < len(roots) and roots[k] <= i <= self.last[roots[k]]
            if text is None or not inside:
                if now and (block := " ".join("".join(now).split())):
                    blocks.append(block)
                now = []
            if inside and text is not None and not self.cut[i]:
                now.append(text)
        if now and (block := " ".join("".join(now).split())):
            blocks.append(block)
        return "\n\n".join(blocks)


def main_text(text: str | None) -> str:
    """The article of a page; null, empty and text-free pages have an empty one."""
    return Page(text or "").main_text()


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` plus every page's main text.

    Every row is on its own: repeated rows, null keys and extra columns pass through (not
    ``out_col``, if ``df`` has it: it is replaced, the html itself too); an empty table gives
    an empty one."""
    source = fresh(df, "_html")
    read = df.select(F.col(html_col).alias(source), *[F.col(c) for c in df.columns if c != out_col])
    rest = T.StructType(read.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], [*batch.schema.names[1:], out_col])

    return read.mapInArrow(run, T.StructType([*rest.fields, T.StructField(out_col, T.StringType())]))


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return extract_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
