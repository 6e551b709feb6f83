"""Nodes of a document tree while it is built; tables hold them as flat rows (operators.nodes)."""

from __future__ import annotations

import gc
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from foliospark.kernel.grammar import Attribute

#: Error levels from least to most severe.
LEVELS = ["debug", "info", "warning", "error", "critical"]

# The node types.
TYPES = [
    "document", "heading", "paragraph", "hr", "image", "fence", "blockquote", "list", "item", "strong", "link", "code", "em", "s",
    "text", "inline", "table", "thead", "tbody", "tr", "td", "th", "tag", "hardbreak", "softbreak", "comment", "error", "node",
]


def deep() -> None:
    """Room for deep and large documents: Python frames live on the heap, so the interpreter's limit is only a number; trees have no cycles, so the collector may look seldom."""
    if sys.getrecursionlimit() < 60_000:
        sys.setrecursionlimit(60_000)
        gc.set_threshold(100_000, 20, 20)


@dataclass
class Problem:
    """A validation error: id, level, message and an optional (start, end) in characters of the source."""

    id: str
    level: str
    message: str
    span: tuple[int, int] | None = None


@dataclass(slots=True)
class Node:
    type: str
    attributes: dict[str, Any] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    tag: str | None = None
    slots: dict[str, Node] = field(default_factory=dict)
    errors: list[Problem] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    annotations: list[Attribute] = field(default_factory=list)
    inline: bool = False
    span: tuple[int, int] | None = None

    @property
    def name(self) -> str:
        return self.tag or self.type

    def walk(self) -> Iterator[Node]:
        """Every node below, slots before children."""
        stack = [iter([*self.slots.values(), *self.children])]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            yield node
            stack.append(iter([*node.slots.values(), *node.children]))


def annotate(node: Node, attributes: list[Attribute]) -> None:
    """Apply written attributes: classes add up in one hash, a repeated attribute replaces the first and warns."""
    for a in attributes:
        node.annotations.append(a)
        if a.kind == "class":
            known = node.attributes.get("class")
            node.attributes["class"] = {**(known if isinstance(known, dict) else {}), a.name: True}
            continue
        if a.name in node.attributes:
            node.errors.append(Problem("duplicate-attribute", "warning", f"Attribute '{a.name}' already set"))
        node.attributes[a.name] = a.value


class Positions:
    """Lines and byte columns of character offsets."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0]
        at = source.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = source.find("\n", at + 1)
        self.ascii = source.isascii()
        if not self.ascii:
            total, self.bytes = 0, []
            for a, b in zip(self.starts, [*self.starts[1:], len(source)], strict=True):
                self.bytes.append(total)
                total += len(source[a:b].encode())

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def place(self, at: int) -> tuple[int, int, int]:
        """(line, column, offset), columns and offsets in bytes."""
        at = min(at, len(self.source))
        line = self.line(at)
        if self.ascii:
            return line, at - self.starts[line], at
        column = len(self.source[self.starts[line] : at].encode())
        return line, column, self.bytes[line] + column
