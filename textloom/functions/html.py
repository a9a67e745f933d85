"""T22 and T23 on the parsed document: Arrow-batched, as no built-in reads a tag tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_DROP = {"script", "style", "noscript"}
_CLOSES = {"p", "li"}
_BLOCK = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """All nodes under this one, in document order, by a stack: depth is no limit."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def fold(self, close, root: bool = True) -> str:
        """Text of the tree from the leaves up: close(node, content) gives the text of a node from that of its children."""
        open_, parts = [(self, iter(self.children))], [[]]
        while True:
            node, rest = open_[-1]
            for c in rest:
                if isinstance(c, Node):
                    open_.append((c, iter(c.children)))
                    parts.append([])
                    break
                parts[-1].append(c)
            else:
                open_.pop()
                inside = "".join(parts.pop())
                if not open_:
                    return close(node, inside) if root else inside
                parts[-1].append(close(node, inside))

    def text(self) -> str:
        return self.fold(lambda n, s: s)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES and self.open[-1].tag == tag:  # an open p or li ends where the next one begins
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def content(html: str) -> Node:
    """The article's area: by id, by the two known classes, the article element, the body, or everything; no scripts or styles."""
    t = _Tree()
    t.feed(html)
    t.close()

    for n in [t.root, *t.root.walk()]:
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in _DROP]
    nodes = list(t.root.walk())
    wanted = (
        lambda n: n.tag == "div" and n.attrs.get("id") == "js_content",
        lambda n: n.tag == "div" and "rich_media_content" in n.attrs.get("class", "").split(),
        lambda n: n.tag == "div" and "rich_media_area_primary" in n.attrs.get("class", "").split(),
        lambda n: n.tag == "article",
        lambda n: n.tag == "body",
    )
    return next((n for w in wanted for n in nodes if w(n)), t.root)


def _lines(s: str) -> str:
    return "\n".join(x for x in (line.strip() for line in s.splitlines()) if x)


def to_text(html: str | None) -> str:
    """Text with a line per block element, without blank lines; null and empty give empty text."""
    return _lines(content(html).fold(lambda n, s: s + "\n" if n.tag in _BLOCK else s, root=False)) if html else ""


def _markdown(n: Node, s: str) -> str:
    if re.fullmatch("h[1-6]", n.tag):
        return f"\n{'#' * int(n.tag[1])} {n.text().strip()}\n"
    if n.tag == "strong":
        return f"**{s.strip()}**"
    if n.tag == "em":
        return f"*{s.strip()}*"
    if n.tag == "a":
        return f"[{s.strip()}]({n.attrs['href']})" if n.attrs.get("href") and s.strip() else s.strip()
    if n.tag == "img":
        src = n.attrs.get("data-src") or n.attrs.get("src", "")
        return f"\n![{n.attrs.get('alt', '')}]({src})\n" if src else ""
    if n.tag == "br":
        return "\n"
    if n.tag == "p":
        return s + "\n"
    if n.tag == "li":
        return f"- {s.strip()}\n"
    return s


def to_markdown(html: str | None) -> str:
    """Headings, strong, em, links, images (data-src first), line breaks, paragraphs and list items as Markdown."""
    return _lines(content(html).fold(_markdown, root=False)) if html else ""


def html_dom_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(to_text)

    return run(html)


def html_dom_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(to_markdown)

    return run(html)
