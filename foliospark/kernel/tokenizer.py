"""The seam between Markdown and the document tree: what reads blocks and inline runs can be swapped.

A tokenizer gives the blocks of a source and the events of an inline run, with offsets in
characters.  The builder above it owns everything about tags: it parses their bodies, closes them,
applies annotations and rewrites tables.  A host's own tokenizer reports a tag as a block of kind
"tagline" (data["body"]) or as an inline event ("tag", body, span); one that knows nothing of tags
reads a masked copy instead and finds the tags by their offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from foliospark.kernel.blocks import Block, Blocks
from foliospark.kernel.grammar import find_tag_end
from foliospark.kernel.inline import Inline

_BODY = re.compile(r"[^ \t\n\r]")
_BLANK_LINE = re.compile(r"\n[ \t\r>]*(?=\n)")
_CONTINUED = re.compile(r"\n[ \t>]*")


@dataclass
class Tokens:
    """The blocks of a source under one root, its link definitions by label, and how many lines it has."""

    root: Block
    n_lines: int
    references: dict[str, tuple[str, str | None]] = field(default_factory=dict)


class Tokenizer(Protocol):
    """What a host implements; it is sent to the workers with the options, so it must pickle."""

    def blocks(self, source: str, comments: bool) -> Tokens: ...
    def inline(self, text: str, references: dict[str, tuple[str, str | None]], comments: bool) -> list[list]: ...


class Markdown:
    """The bundled tokenizer."""

    def blocks(self, source: str, comments: bool) -> Tokens:
        reader = Blocks(source, comments)
        root = reader.parse()
        return Tokens(root, len(reader.lines), reader.references)

    def inline(self, text: str, references: dict[str, tuple[str, str | None]], comments: bool) -> list[list]:
        return Inline(text, references, comments).run()


MARKDOWN = Markdown()


def masked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with the bodies of its tags written over, and where the tags stand.

    Every character of a body but white space and the quote markers that its later lines begin with
    becomes x, so lengths and lines stay and nothing inside a tag looks like markup.  A tag that is
    not closed, or that a blank line parts, is text.
    """
    out, tags, done, at = [], [], 0, text.find("{%")
    while at >= 0:
        end = find_tag_end(text, at)
        if end is None or _BLANK_LINE.search(text, at, end):
            at = text.find("{%", at + 2)
            continue
        out.append(text[done : at + 2])
        kept = at + 2
        for m in _CONTINUED.finditer(text, at + 2, end):
            out += [_BODY.sub("x", text[kept : m.start()]), m[0]]
            kept = m.end()
        out.append(_BODY.sub("x", text[kept:end]))
        tags.append((at, end + 2))
        done, at = end, text.find("{%", end + 2)
    return "".join(out) + text[done:], tags
