"""Marked-up pages: a small tree builder with implied end tags, and what is read off the tree.

One pass over a page gives its anchors (with the landmarks they stand in), its
headings, its text blocks, its frames and its visible text, laid out as a reader
sees it: blocks on lines of their own, list marks, table cells in columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, elements that end another one, and elements that are never shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "thead": {"tbody"}, "tfoot": {"tbody"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
UNSEEN = frozenset("script style noscript template head title".split())
BLOCK = ENDS_P | frozenset("li tr dt dd body html caption figure figcaption".split())
# Parts of attribute values that tell of a landmark.
LANDMARKS = {"header": ("head", "Head"), "footer": ("bottom", "foot", "Bottom", "Foot"), "other": ("banner", "crumb", "Banner", "Crumb", "off-canvas", "global", "Global"), "menu": ("menu", "Menu"), "nav": ("nav", "Nav"), "kept": ("sticky", "no-bottom")}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    children: list = field(default_factory=list)

    def landmarks(self) -> frozenset[str]:
        """The landmarks that this element or one above it makes."""
        out, at = set(), self
        while at is not None:
            if at.tag in ("header", "footer", "nav"):
                out.add(at.tag + "_tag")
            for value in at.attrs.values():
                out |= {name for name, marks in LANDMARKS.items() if any(m in (value or "") for m in marks)}
            at = at.parent
        return frozenset(out)


class Builder(HTMLParser):
    """Tree of a page; missing end tags are implied as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        at = self.at
        while at.parent is not None and closes:  # the nearest element that this one ends, unless a container is between
            if at.tag in closes:
                self.at = at.parent
                if tag != "tr":
                    break
            elif at.tag in ("ul", "ol", "dl", "table", "div", "body", "section", "article") and at.tag != tag:
                break
            at = at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def _walk(node: Node):
    for child in node.children:
        yield child, node
        if isinstance(child, Node):
            yield from _walk(child)


def _text(node: Node) -> str:
    return "".join(c for c, _ in _walk(node) if isinstance(c, str))


def _hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return node.tag in UNSEEN or "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style or node.attrs.get("aria-hidden") == "true"


def rendered(html: str) -> str:
    """The visible text as it is laid out."""
    lines: list[str] = [""]

    def fresh() -> None:
        if lines[-1].strip():
            lines.append("")

    def show(node: Node, depth: int, cells: bool) -> None:
        number = 0
        for child in node.children:
            if isinstance(child, str):
                lines[-1] += child if node.tag == "pre" else re.sub(r"\s+", " ", child)
                continue
            if _hidden(child):
                continue
            if child.tag == "br":
                lines.append("")
                continue
            block = child.tag in BLOCK
            if block:
                fresh()
            if child.tag == "li":
                number += 1
                lines[-1] = "  " * depth + (f"{number}. " if node.tag == "ol" else "• ")
            if child.tag in ("td", "th") and lines[-1].strip():
                lines[-1] = lines[-1].rstrip(" ") + "\t"
            show(child, depth + (child.tag in ("ul", "ol") and node.tag == "li"), cells)
            if block:
                fresh()
                if child.tag in ("p", "h1", "h2", "h3", "h4", "ul", "ol", "table", "pre", "blockquote") and len(lines) > 1 and lines[-2].strip():
                    lines.append("")

    show(tree(html), 0, False)
    text = "\n".join(x.rstrip() if "\t" in x else re.sub(r" +", " ", x).rstrip() for x in lines)
    return re.sub(r"\n{3,}", "\n\n", _aligned(text)).strip()


def _aligned(text: str) -> str:
    """Runs of lines with tabs with their cells in columns."""
    out, block = [], []

    def flush() -> None:
        if block:
            rows = [[c.strip() for c in x.split("\t")] for x in block]
            widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows)))]
            out.extend("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)
            block.clear()

    for line in text.split("\n"):
        if "\t" in line:
            block.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


PAGE = T.StructType([
    T.StructField("anchors", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("href", T.StringType()), T.StructField("marks", T.ArrayType(T.StringType()))]))),
    T.StructField("frames", T.ArrayType(T.StringType())),
    T.StructField("title", T.ArrayType(T.StringType())), T.StructField("h1", T.ArrayType(T.StringType())), T.StructField("h2", T.ArrayType(T.StringType())), T.StructField("h3", T.ArrayType(T.StringType())),
    T.StructField("blocks", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("main_lines", T.ArrayType(T.StringType())), T.StructField("visible", T.StringType()),
])


def read_page(url: str | None, html: str | None) -> tuple:
    """Everything of :data:`PAGE`; empty for a null page."""
    if not html:
        return ([], [], [], [], [], [], [], [], [], "")
    root = tree(html)
    anchors, frames, blocks, lines, main = [], [], [], [], []
    heads: dict[str, list[str]] = {k: [] for k in ("title", "h1", "h2", "h3")}
    for node, parent in _walk(root):
        if isinstance(node, str):
            if node.strip() and not any(p.tag in ("script", "style") for p in _up(parent)):
                lines.append(_squeezed(node))
                if not parent.landmarks() & {"header_tag", "header", "footer_tag", "footer", "other", "menu", "nav", "nav_tag"}:
                    main.append(_squeezed(node))
            continue
        if node.tag == "a" and "href" in node.attrs and "#" not in node.attrs["href"]:
            anchors.append((len(anchors), _squeezed(_text(node)), urljoin(url or "", "".join(node.attrs["href"].split())), sorted(node.landmarks())))
        elif node.tag == "iframe" and node.attrs.get("src"):
            frames.append(urljoin(url or "", node.attrs["src"]))
        elif node.tag in heads:
            heads[node.tag].append(_squeezed(_text(node)))
        if node.tag in ("p", "li", "ol", "dl", "tr", "span"):
            parts = [_squeezed(c) for c, p in _walk(node) if isinstance(c, str)]
            parts = [p for p in parts if p]
            if parts:
                blocks.append(parts)
        elif node.tag == "div":
            parts = [_squeezed(c) for c in node.children if isinstance(c, str) and c.strip()]
            if parts:
                blocks.append(parts)
    return (anchors, frames, heads["title"], heads["h1"], heads["h2"], heads["h3"], blocks, lines, main, rendered(html))


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


@F.pandas_udf(PAGE)
def page(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    """H1, H2, H3, H5, H6, H7, S11 of a page in one pass."""
    return pd.DataFrame([read_page(u, h) for u, h in zip(url, html)], columns=[f.name for f in PAGE])
