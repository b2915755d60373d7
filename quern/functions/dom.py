"""The main text of an HTML page by its elements: furniture out, the longest block among the content elements."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements, names (of id or class), parts of class names and roles of what is no content.
TAGS = {"script", "style", "noscript", "iframe", "svg", "canvas", "video", "audio"}
NAMES = ["header", "footer", "nav", "menu", "sidebar"]
CLASS_PARTS = ["advertisement", "ads", "cookie", "consent", "popup", "modal"]
ROLES = {"navigation", "banner", "contentinfo"}
# Elements and names of content, in order; elements that begin a line; elements without an end.
CONTENT = ["main", "article", "#content", "#main-content", "#entry-content", "#post-content", "#article-content", "#page-content", "#container", "@main", "body"]
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "br"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Elements as [name, attributes, children]; an end tag closes up to its element, others are left out."""

    def __init__(self) -> None:
        super().__init__()
        self.open = [["", {}, []]]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _furniture(node: list) -> bool:
    own, of = node[1].get("class") or "", node[1].get("id") or ""
    return node[0] in TAGS or node[1].get("role") in ROLES or any(n in (own, of) or f"{n}-" in own for n in NAMES) or any(p in own for p in CLASS_PARTS)


def _nodes(node: list) -> list:
    """All elements below a node that are no furniture, in the order of the page."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n[2]) if isinstance(c, list) and not _furniture(c)]
    return out[1:]


def _text(node: list) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif not _furniture(n):
            edge = ["\n"] if n[0] in BLOCKS else []
            stack += [*edge, *reversed(n[2]), *edge]
        if isinstance(n, str) and n != "\n":
            out.append(" ")
    return "".join(out)


def _is(node: list, rule: str) -> bool:
    if rule[0] == "#":
        return rule[1:] in (node[1].get("class"), node[1].get("id"))
    return node[1].get("role") == rule[1:] if rule[0] == "@" else node[0] == rule


def main_block(page: str) -> str:
    """The text of the longest content element of the first kind that has more than 100 bytes, on one line; of the whole page if there is none."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    root = tree.open[0]
    best, nodes = "", _nodes(root)
    for rule in CONTENT:
        best = max([best, *(_text(n) for n in nodes if _is(n, rule))], key=lambda t: len(t.encode()))
        if len(best.encode()) > 100:
            break
    return re.sub(r"\s+", " ", best or _text(root)).strip()


@F.pandas_udf(StringType())
def clean_dom(page: pd.Series) -> pd.Series:
    """main_block() of every page; null stays null."""
    return page.map(main_block, na_action="ignore")
