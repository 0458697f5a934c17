"""The main block of a page, by the density of text and links in its tree.

A page's markup becomes a tree of blocks. From the leaves up every block is scored by the text
it holds itself or through blocks worth keeping, less what is in links; the best block is the
page's main text. Pages are independent, so this is a function over Arrow batches of pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements that hold no text of a page, elements that never hold anything, elements that begin a block.
DROPPED = frozenset(("script", "style", "noscript", "template", "nav", "header", "footer", "aside", "svg", "iframe", "form"))
EMPTY = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCKS = frozenset(("html", "body", "main", "article", "section", "div", "table", "tbody", "tr", "td", "th", "ul", "ol", "li", "dl", "dd", "dt", "blockquote", "pre", "p", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "address"))
#: Names of classes, ids and roles whose blocks are no content.
NOISE = ("nav", "menu", "breadcrumb", "footer", "header", "sidebar", "skip", "social", "share", "promo", "banner", "cookie", "advert", "subscribe", "newsletter", "comment", "related")


@dataclass
class Block:
    """A block of the tree: its own pieces of text and its children in order, and the characters in links."""

    tag: str
    noise: bool = False
    parts: list = field(default_factory=list)  # str or Block
    linked: int = 0


class _Tree(HTMLParser):
    """Builds blocks; unclosed and stray tags are forgiven."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Block("root")
        self.open: list[tuple[str, Block]] = [("root", self.root)]
        self.dropped = self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in EMPTY:
            if tag == "br" and not self.dropped:
                self.open[-1][1].parts.append(" ")
            return
        if tag == "p":
            self._close_until({"p"}, {"td", "th", "li", "div", "article", "section", "body"})
        if tag == "li":
            self._close_until({"li"}, {"ul", "ol"})
        block = self.open[-1][1]
        if tag in DROPPED:
            self.dropped += 1
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS:
            said = " ".join((v or "").lower() for k, v in attrs if k in ("class", "id", "role"))
            block = Block(tag, any(word.startswith(NOISE) or word in ("ad", "ads") for word in said.replace("-", " ").replace("_", " ").split()))
            self.open[-1][1].parts.append(block)
        self.open.append((tag, block))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open[1:]):
            while True:
                last = self.open[-1][0]
                self._pop()
                if last == tag:
                    break

    def _close_until(self, which: set, stop: set) -> None:
        for t, _ in reversed(self.open[1:]):
            if t in stop:
                return
            if t in which:
                self.handle_endtag(t)
                return

    def _pop(self) -> None:
        tag, _ = self.open.pop()
        self.dropped -= tag in DROPPED
        self.links -= tag == "a"

    def handle_data(self, data):
        if not self.dropped:
            block = self.open[-1][1]
            block.parts.append(data)
            if self.links:
                block.linked += len(data.strip())


def _text(block: Block, skip: bool) -> str:
    """All text of a block in order, with blanks at its own and its children's edges; noisy blocks are skipped if asked."""
    out, stack = [], [iter(block.parts)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            out.append(" ")
        elif isinstance(part, str):
            out.append(part)
        elif not (skip and part.noise):
            out.append(" ")
            stack.append(iter(part.parts))
    return " ".join("".join(out).split())


def main_block(html: str | None, least: int = 200) -> tuple[str, str, float]:
    """(tag, text, density) of a page's main block; density is the share of its text outside links.

    Scores go from the leaves up: a block counts its own text outside links in full and what its children count at
    ``KEPT``, so a wrapper around one good block is worth less than that block, and one around several is worth more than
    each. Noisy blocks count nothing. The best block of at least ``least`` characters wins, the first of equals; if
    there is none, the whole page's text is taken. A null or empty page has the tag "root" and no text.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    order, stack = [], [tree.root]
    while stack:
        block = stack.pop()
        order.append(block)
        stack += [p for p in reversed(block.parts) if isinstance(p, Block)]
    score: dict[int, float] = {}
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for block in reversed(order):  # children before parents
        kids = [p for p in block.parts if isinstance(p, Block) and not p.noise]
        own = sum(len(p.strip()) for p in block.parts if isinstance(p, str))
        at = id(block)
        size[at] = own + sum(size[id(k)] for k in kids)
        linked[at] = block.linked + sum(linked[id(k)] for k in kids)
        score[at] = 0.0 if block.noise else max(0, own - 2 * block.linked) + KEPT * sum(score[id(k)] for k in kids)
    good = [b for b in order if not b.noise and size[id(b)] >= least and b.tag != "root"]
    best = max(good, key=lambda b: score[id(b)], default=tree.root)
    text = _text(best, True)
    return best.tag, text, (size[id(best)] - linked[id(best)]) / size[id(best)] if size[id(best)] else 0.0


#: What of its children's score a block keeps.
KEPT = 0.9


def main_blocks(pages: DataFrame, html: str, keep: list[str], least: int = 200) -> DataFrame:
    """The columns ``keep`` of every page with tag, main and density of its main block (see :func:`main_block`)."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("tag", T.StringType()), T.StructField("main", T.StringType()), T.StructField("density", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_block(t, least) for t in batch.column(batch.num_columns - 1).to_pylist()]
            tags, texts, density = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tags, pa.string()), pa.array(texts, pa.string()), pa.array(density, pa.float64())], schema.names)

    return pages.select(*keep, html).mapInArrow(run, schema)
