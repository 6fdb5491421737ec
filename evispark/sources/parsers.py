"""Parsers as table functions: each file's text becomes the rows of its syntax tree (``schema.AST_NODES``).

A parser is a class with ``nodes(path, text)``, which yields a ``Node`` for every named node in preorder; ``parsed`` runs it over
a table of files, each file in one task. Parsers of programming languages bring their own grammar; ``Markup`` reads the
elements of web pages.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.schema import AST_NODES


@dataclass
class Node:
    """A named node; parent and preorder are numbers of nodes of the file, and texts are null where nobody needs them."""

    node_id: int
    parent_id: int | None
    preorder: int
    type: str
    text: str | None
    start_index: int
    start_row: int
    end_row: int
    name_text: str | None = None
    function_text: str | None = None
    constructor_text: str | None = None


class Markup:
    """Elements of a page. Types name the nodes that elements stand for (others are called as their tags are), and only those
    have a text. An end closes all that is open in its element, one without a beginning closes nothing, and what is still
    open at the end of the page ends there."""

    types: dict[str, str] = {}
    #: Elements that are named by the first word behind their tag, and those that call it.
    named: tuple[str, ...] = ()
    calling: tuple[str, ...] = ()
    # Elements without an end, and elements whose content isn't markup.
    EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
    TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>|<[!?][^>]*>", re.S)
    RAW = re.compile(r"</(?:script|style)\s*>", re.I)

    def nodes(self, path: str, text: str) -> Iterator[Node]:
        breaks = [m.start() for m in re.finditer("\n", text)]
        row = lambda at: bisect_left(breaks, at)
        found: list[Node] = []
        open_: list[tuple[str, Node]] = []

        def close(tag: str, node: Node, end: int) -> None:
            node.end_row, node.text = row(end), text[node.start_index : end] if tag in self.types else None

        at = 0
        while m := self.TAG.search(text, at):
            at = m.end()
            tag = (m[2] or "").lower()
            if m[1]:
                depth = max((k for k, (t, _) in enumerate(open_) if t == tag), default=None)
                for t, node in reversed(open_[depth:] if depth is not None else []):
                    close(t, node, m.end() if t == tag else m.start())
                del open_[len(open_) if depth is None else depth :]
            elif tag:
                word = re.match(r"[^\s<]+", text[at : at + 200])
                first = word[0] if word else None
                node = Node(len(found), open_[-1][1].node_id if open_ else None, len(found), self.types.get(tag, tag), None, m.start(), row(m.start()), 0)
                node.name_text, node.function_text = first if tag in self.named else None, first if tag in self.calling else None
                found.append(node)
                if tag in self.EMPTY:
                    close(tag, node, m.end())
                else:
                    open_.append((tag, node))
                if tag in ("script", "style"):
                    end = self.RAW.search(text, at)
                    at = end.start() if end else len(text)
        for tag, node in open_:
            close(tag, node, len(text))
        yield from found


def parsed(files: DataFrame, parser: type) -> DataFrame:
    """The nodes of all files (path, content); null content has none."""
    fields = AST_NODES.split(", ", 1)[1]

    @F.udtf(returnType=fields)
    class Parsing:
        def eval(self, path: str, content: str):
            if content is not None:
                yield from map(astuple, parser().nodes(path, content))

    held = files.select(F.col("path").alias("file_path"), "content")
    return held.lateralJoin(Parsing(F.col("file_path").outer(), F.col("content").outer())).drop("content")
