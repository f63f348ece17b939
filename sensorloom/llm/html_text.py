"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path. Per path the text length and the punctuation of its blocks are
added up and divided by their number (text and punctuation ratio of the path; the text of links does not count). Both ratios, laid out in page
order, are smoothed with a Gaussian, multiplied, and compared with a threshold from their spread. The paths that pass name the content
containers; the blocks of these containers are the text. Parts that say by their element or by a class or id that they are furniture (menus,
footers, adverts, notices, forms, comments) take no part, and article or main elements with text go before the rest of the page: of each outermost
one with a path that passes, all blocks that are not furniture or links alone are text. Inside them only a whole class or role is a name of furniture, as ids
there are mostly headings' slugs and parts of longer names may mean anything.

A page lies in one row and its statistics are its own, so one pass without a shuffle does the work; the helpers below look at one page.

Cases: null or empty html gives an empty text, as does a page without content. An element that never ends reaches to the end of the page.
Repeated rows and null ids make no difference. Empty tables give no rows. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements by the role HTML gives them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
FURNITURE = frozenset(
    "head nav footer aside form button select option datalist dialog menu noscript template svg math object canvas audio video map label fieldset".split()
)
CONTENT_ROOTS = frozenset(("article", "main"))
NEVER_FURNITURE = frozenset(("html", "body", "article", "main"))
# fixed values: words in a class or id that name furniture
FURNITURE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar sidebars rail aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    comment comments commentlist reply replies respond discussion disqus widget widgets pagination pager search form copyright legal
    disclaimer skip hidden""".split()
)
HEADER_NAMES = frozenset(("header", "pageheader", "siteheader"))
CLOSES_PARAGRAPH = frozenset(
    """address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre
    section table ul""".split()
)
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

PUNCTUATION = frozenset(".,;:!?…。，；：！？、")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|<!--|<[!?/][^>]*>")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")

KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)


@dataclass
class Block:
    path: str
    container: tuple[int, ...]
    root: int
    text: str
    plain_chars: int
    punctuation: int


def _is_furniture(name: str, attributes: str, inside_root: bool) -> bool:
    if name in FURNITURE or (name == "header" and not inside_root):
        return True
    if name in NEVER_FURNITURE or not attributes.strip():
        return False
    if _HIDDEN.search(attributes):
        return True
    if inside_root:
        values = " ".join(a or b or c for kind, a, b, c in _NAMES.findall(attributes) if kind.lower() != "id").lower()
        return bool(set(values.split()) & FURNITURE_NAMES)
    values = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attributes)).lower()
    parts = set(_PARTS.split(values))
    return bool(parts & (FURNITURE_NAMES | HEADER_NAMES))


class Page:
    """Reads a page's tags in order and gathers its text blocks."""

    def __init__(self):
        # (name, number, whether it or an ancestor is furniture, number of the outermost article or main or 0)
        self.stack: list[tuple[str, int, bool, int]] = []
        self.number = 0
        self.blocks: list[Block] = []
        self.pieces: list[tuple[str, bool]] = []

    def _top(self):
        return self.stack[-1] if self.stack else ("", 0, False, 0)

    def text(self, raw: str) -> None:
        if not self._top()[2]:
            linked = any(name == "a" for name, *_ in self.stack)
            self.pieces.append((entities.unescape(raw), linked))

    def end_block(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(p for p, _ in self.pieces).split())
        if text:
            own = [s for s in self.stack if s[0] not in INLINE]
            plain = " ".join("".join(p for p, linked in self.pieces if not linked).split())
            self.blocks.append(
                Block(
                    "/".join(name for name, *_ in own),
                    tuple(s[1] for s in own[:-1]),
                    own[-1][3] if own else 0,
                    text,
                    len(plain),
                    sum(map(plain.count, PUNCTUATION)),
                )
            )
        self.pieces = []

    def _pop_to(self, depth: int) -> None:
        del self.stack[depth:]

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name not in INLINE:
            self.end_block()
            self._close_implied(name)
        if name in VOID:
            return
        _, _, inherited, root = self._top()
        self.number += 1
        furniture = inherited or _is_furniture(name, attributes, root > 0)
        if furniture and not inherited:
            self.end_block()
        self.stack.append((name, self.number, furniture, self.number if name in CONTENT_ROOTS and not root else root))

    def _close_implied(self, name: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            at = self.stack[depth][0]
            if at == "p" and name in CLOSES_PARAGRAPH or at == name and name in SAME_LEVEL:
                self._pop_to(depth)
                return
            if at in SAME_LEVEL.get(name, ()) or at not in INLINE and (name not in SAME_LEVEL or at in ("table", "ul", "ol", "dl")):
                return

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        for depth in range(len(self.stack) - 1, -1, -1):
            at, _, furniture, _ = self.stack[depth]
            if at == name:
                if furniture:
                    self.pieces = []
                self._pop_to(depth)
                return
            if name in INLINE and at not in INLINE:
                return


def blocks_of(page: str) -> list[Block]:
    reader, at, lower = Page(), 0, None
    while True:
        found = _TAG.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            reader.text(page[at:end])
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if found[0] == "<!--":
            stop = page.find("-->", at)
            at = len(page) if stop < 0 else stop + 3
        elif name and (found[1] or found[4]):
            reader.close(name)
        elif name in RAW:
            lower = page.lower() if lower is None else lower
            stop = (lower if len(lower) == len(page) else page).find(f"</{name}", at)
            at = len(page) if stop < 0 else stop
        elif name:
            reader.open(name, found[3] or found[6] or "")
    reader.end_block()
    return reader.blocks


def path_scores(blocks: list[Block]) -> np.ndarray:
    """The fused ratio of each block: smoothed text ratio times smoothed punctuation ratio of its path."""
    names = {p: k for k, p in enumerate(dict.fromkeys(b.path for b in blocks))}
    of = np.array([names[b.path] for b in blocks])
    number = np.bincount(of)
    chars = np.bincount(of, [b.plain_chars for b in blocks]) / number
    marks = (np.bincount(of, [b.punctuation for b in blocks]) + 0.1) / number
    weight = np.convolve(np.ones(len(of)), KERNEL, "full")[2 : 2 + len(of)]
    smooth = lambda v: np.convolve(v[of], KERNEL, "full")[2 : 2 + len(of)] / weight
    return smooth(chars) * smooth(marks)


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by empty lines."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = path_scores(blocks)
    rooted = any(b.root for b in blocks)
    taken = [(b, s) for b, s in zip(blocks, scores) if b.root or not rooted]
    values = np.array([s for _, s in taken])
    threshold = min(values.max(), values.std())
    by_path: dict[str, list[float]] = {}
    for b, s in taken:
        by_path.setdefault(b.path, []).append(s)
    content = {p for p, s in by_path.items() if max(s) >= threshold}
    containers = {b.container for b, _ in taken if b.path in content}
    whole = {b.root for b, _ in taken if b.root and b.path in content}
    inside = lambda c: any(c[:k] in containers for k in range(len(c) + 1))
    links_only = lambda b: b.plain_chars * 2 < len(b.text) and b.path not in content
    return "\n\n".join(b.text for b, _ in taken if (b.root in whole or inside(b.container)) and not links_only(b))


def extracted(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Each page's id, url and text."""

    def run(batches):
        for batch in batches:
            found = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], [id_col, url_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")
