"""Block Markdown with block tags, by the container algorithm: each line first continues the open
containers, then opens new ones, then adds to a leaf.

No setext headings and no raw HTML exist here.  A tag alone on its lines is a block of its own at
any indentation, inside the container that its line belongs to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from foliospark.kernel.grammar import find_tag_end
from foliospark.kernel.inline import blanks, destination, label_key, title, unescape, unsafe_link

_BULLET = re.compile(r"([*+-])(?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
#: First characters of whatever is no paragraph.
_OPENERS = frozenset("#>`~*_-+0123456789<{")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass(slots=True)
class Block:
    """An open or finished block; kind is a node type, "tagline" or "plain" (paragraph text of a tight item)."""

    kind: str
    line: int
    start: int
    data: dict[str, Any] = field(default_factory=dict)
    children: list[Block] = field(default_factory=list)
    text: list[tuple[str, int]] = field(default_factory=list)  # (text of a line, its offset in the source)
    end_line: int = 0
    end: int = 0
    open: bool = True
    blank_after: bool = False


class Line:
    """A cursor over one source line that knows columns, so that tabs count as they should."""

    def __init__(self, text: str, offset: int):
        self.text, self.offset, self.at, self.column, self.pending = text, offset, 0, 0, 0

    def indent(self) -> int:
        """Columns of white space from here to the next other character."""
        column, k = self.column, self.at
        pending = self.pending
        while k < len(self.text):
            if self.text[k] == " ":
                column += 1
            elif self.text[k] == "\t":
                column += 4 - column % 4 if not (k == self.at and pending) else pending
            else:
                break
            k += 1
        self.next = k
        return column - self.column

    def blank(self) -> bool:
        return not self.text[self.at :].strip(" \t")

    def skip(self, columns: int) -> None:
        """Pass over white space of so many columns; part of a tab may stay."""
        while columns > 0 and self.at < len(self.text) and self.text[self.at] in " \t":
            width = 1 if self.text[self.at] == " " else self.pending or 4 - self.column % 4
            if width > columns:
                self.pending = width - columns
                self.column += columns
                return
            columns -= width
            self.column += width
            self.pending = 0
            self.at += 1

    def rest(self) -> str:
        if self.pending and self.at < len(self.text):
            return " " * self.pending + self.text[self.at + 1 :]
        return self.text[self.at :]

    def take(self, n: int) -> None:
        self.at += n
        self.column += n


class Blocks:
    def __init__(self, source: str, comments: bool = False):
        self.source, self.comments = source, comments
        self.lines = source.split("\n")
        if self.lines and self.lines[-1] == "":
            self.lines.pop()
        self.offsets = []
        at = 0
        for text in self.lines:
            self.offsets.append(at)
            at += len(text) + 1
        self.references: dict[str, tuple[str, str | None]] = {}
        self.root = Block("document", 0, 0)
        self.stack = [self.root]
        self.skip_until = 0  # lines before this were read by a tag or a comment
        self.text_until = 0  # lines before this continue a paragraph whatever they look like

    def parse(self) -> Block:
        for number, text in enumerate(self.lines):
            self.number = number
            if number >= self.skip_until:
                self.add_line(text.removesuffix("\r"), number)
        while self.stack:
            self.close()
        return self.root

    # ---- the stack

    @property
    def tip(self) -> Block:
        return self.stack[-1]

    def close(self) -> None:
        block = self.stack.pop()
        block.open = False
        block.end_line = max(block.end_line, block.line + 1)
        if block.kind == "paragraph":
            self.definitions(block)
        if block.kind == "code" and not block.data.get("fenced"):
            while block.text and not block.text[-1][0].strip():
                block.text.pop()
        if block.kind == "list":
            block.data["tight"] = not self.loose(block)
        if block.children:
            block.end_line, block.end = max(block.end_line, block.children[-1].end_line), max(block.end, block.children[-1].end)

    def loose(self, block: Block) -> bool:
        items = block.children
        for i, item in enumerate(items):
            if i + 1 < len(items) and self.ends_blank(item):
                return True
            for k, child in enumerate(item.children):
                if self.ends_blank(child) and (i + 1 < len(items) or k + 1 < len(item.children)):
                    return True
        return False

    def ends_blank(self, block: Block) -> bool:
        while True:
            if block.blank_after:
                return True
            if block.kind in ("list", "item") and block.children:
                block = block.children[-1]
                continue
            return False

    def definitions(self, block: Block) -> None:
        """Take link reference definitions off the front of a paragraph."""
        while block.text and block.text[0][0].startswith("["):
            text = "\n".join(t for t, _ in block.text)
            k = 1
            while k < len(text) and text[k] not in "[]":
                k += 2 if text[k] == "\\" else 1
            label = text[1:k]
            if not text.startswith("]:", k) or not label.strip() or len(label) > 999:
                return
            at = blanks(text, k + 2)
            got = destination(text, at)
            if got is None or (got[1] == at):
                return
            url, at = got
            gap = blanks(text, at)
            heading = title(text, gap) if gap > at else None
            end = None
            if heading is not None and (m := re.compile(r"[ \t]*(?:\n|$)").match(text, heading[1])):
                end = m.end()
            elif m := re.compile(r"[ \t]*(?:\n|$)").match(text, at):
                heading, end = None, m.end()
            if end is None:
                return
            if not unsafe_link(unescape(url)):
                self.references.setdefault(label_key(label), (unescape(url), None if heading is None else unescape(heading[0])))
            used = text[:end].count("\n") + (0 if text[:end].endswith("\n") else 1)
            block.text = block.text[used:]

    def add_block(self, kind: str, start: int, **data: Any) -> Block:
        while self.tip.kind in ("paragraph", "code", "table") or (self.tip.kind == "list" and kind != "item"):
            self.close()
        block = Block(kind, self.number, start, data, end_line=self.number + 1)
        self.tip.children.append(block)
        self.stack.append(block)
        return block

    # ---- one line

    @staticmethod
    def keep_lead(block: Block, line: Line) -> None:
        """White space that a paragraph's line loses, by the line's place: an inline comment keeps it."""
        whole = line.pending and line.text[line.at - 1 : line.at] == ">"  # a tab behind the last quote mark stays a tab
        rest = line.text[line.at :] if whole else line.rest()
        if block.text and (lead := rest[: len(rest) - len(rest.lstrip(" \t"))]):
            block.data.setdefault("leads", {})[len(block.text)] = lead

    def add_line(self, text: str, number: int) -> None:
        line = Line(text, self.offsets[number])
        stop = line.offset + len(text)
        depth = 1
        for block in self.stack[1:]:  # continue the open containers
            if block.kind == "blockquote":
                if line.indent() <= 3 and text[line.next : line.next + 1] == ">":
                    line.skip(3)
                    line.take(1)
                    line.skip(1)
                else:
                    break
            elif block.kind == "item":
                if line.blank():
                    if not block.children:
                        break
                    line.skip(10**6)
                elif line.indent() >= block.data["width"]:
                    line.skip(block.data["width"])
                else:
                    break
            elif block.kind != "list":
                break
            depth += 1
        containers = depth
        matched = containers == len(self.stack) or (containers == len(self.stack) - 1 and self.tip.kind in ("paragraph", "code", "table"))
        leaf = self.tip if self.tip.kind in ("paragraph", "code", "table") else None
        if matched and leaf is not None and leaf.kind == "code":
            if leaf.data["fenced"]:
                m = re.match(r"(`+|~+)[ \t]*$", text[line.next :]) if line.indent() <= 3 else None
                if m and m[1][0] == leaf.data["marker"][0] and len(m[1]) >= len(leaf.data["marker"]):
                    leaf.end_line, leaf.end = number + 1, stop
                    self.close()
                    return
                line.skip(leaf.data["indent"])
                leaf.text.append((line.rest(), line.offset + line.at))
                leaf.end_line, leaf.end = number + 1, stop
                return
            if line.blank():
                line.skip(4)
                leaf.text.append((line.rest(), line.offset + line.at))
                return
            if line.indent() >= 4 and not self.tag_at(line, line.next):
                line.skip(4)
                leaf.text.append((line.rest(), line.offset + line.at))
                leaf.end_line, leaf.end = number + 1, stop
                return
            self.close()
            leaf = None
        lazy = leaf is not None and leaf.kind == "paragraph" and not matched
        if leaf is not None and leaf.kind == "paragraph" and number < self.text_until and not line.blank():
            self.keep_lead(leaf, line)
            leaf.text.append((text[line.at :].lstrip(" \t"), line.offset + len(text) - len(text[line.at :].lstrip(" \t"))))
            leaf.end_line, leaf.end = number + 1, stop
            return
        # open new blocks
        opened = False
        while True:
            if line.blank():
                break
            indent = line.indent()
            at = line.next
            rest = text[at:]
            if indent < 4 and rest[0] not in _OPENERS:
                break
            tag = self.tag_at(line, at)
            if tag is not None:
                self.unwind(containers, opened)
                end, last = tag
                block = self.add_block("tagline", line.offset + at, body=self.tag_body(line.offset + at, end))
                block.end_line, block.end = last + 1, end + 2
                self.skip_until = last + 1
                self.close()
                return
            if indent >= 4:
                if leaf is not None and leaf.kind == "paragraph" and not opened:
                    break
                self.unwind(containers, opened)
                line.skip(4)
                block = self.add_block("code", line.offset + at, fenced=False, marker="", info=None)
                block.text.append((line.rest(), line.offset + line.at))
                block.end = stop
                return
            in_table = matched and not opened and leaf is not None and leaf.kind == "table"  # there the line is a row
            if self.comments and not in_table and rest.startswith("<!--") and (close := self.source.find("-->", line.offset + at)) >= 0:
                last = self.source.count("\n", 0, close)  # the container goes on behind this line, whose end is dropped
                self.unwind(containers, opened)
                block = self.add_block("comment", line.offset + at, content=re.sub(r"\r\n?", "\n", self.source[line.offset + at + 4 : close]).strip())
                block.end_line, block.end = last + 1, close + 3
                self.skip_until = last + 1
                self.close()
                return
            if rest.startswith(">"):
                self.unwind(containers, opened)
                self.add_block("blockquote", line.offset + at)
                line.skip(indent)
                line.take(1)
                line.skip(1)
                opened, leaf, lazy = True, None, False
                containers = len(self.stack)
                continue
            if m := _HEADING.match(rest):
                self.unwind(containers, opened)
                body = rest[m.end() :].rstrip(" \t")
                cut = re.sub(r"(?:^|[ \t]+)#+$", "", body)
                block = self.add_block("heading", line.offset + at, level=len(m[1]))
                block.text.append((cut.rstrip(" \t") if cut != body else body, line.offset + at + m.end()))
                block.end = stop
                self.close()
                return
            if (m := _FENCE.match(rest)) and not (m[1] and "`" in (m[2] or "")):
                self.unwind(containers, opened)
                block = self.add_block("code", line.offset + at, fenced=True, marker=m[1] or m[3], info=(m[2] if m[1] else m[4]).strip(), indent=indent)
                block.end = stop
                return
            if _RULE.match(rest):
                self.unwind(containers, opened)
                self.add_block("hr", line.offset + at).end = stop
                self.close()
                return
            if self.list_item(line, indent, at, rest, leaf, opened, containers):
                opened, leaf, lazy = True, None, False
                containers = len(self.stack)
                continue
            break
        self.finish_line(line, text, containers, leaf, lazy, opened, stop)

    def unwind(self, containers: int, opened: bool) -> None:
        """Close what this line did not continue."""
        while len(self.stack) > containers:
            self.close()

    def list_item(self, line: Line, indent: int, at: int, rest: str, leaf, opened: bool, containers: int) -> bool:
        m = _BULLET.match(rest)
        ordered = None if m else _ORDERED.match(rest)
        if not m and not ordered:
            return False
        marker = (m or ordered)[0]
        content = rest[len(marker) :]
        in_text = leaf is not None and leaf.kind == "paragraph" and not opened and containers >= len(self.stack) - 1
        if in_text and (not content.strip(" \t") or (ordered and int(ordered[1]) != 1)):
            return False
        kind = ordered[2] if ordered else marker
        self.unwind(containers, opened)
        while self.tip.kind in ("paragraph", "code", "table"):
            self.close()
        start = line.offset + at
        if self.tip.kind != "list" or self.tip.data["marker"] != kind or self.tip.data["ordered"] != bool(ordered):
            if self.tip.kind == "list":
                self.close()
            self.add_block("list", start, marker=kind, ordered=bool(ordered), first=int(ordered[1]) if ordered else None)
        line.skip(indent)
        line.take(len(marker))
        after = line.indent()
        width = indent + len(marker)
        if not content.strip(" \t"):
            gap = 1
        elif after > 4:
            gap = 1
        else:
            gap = after
        self.add_block("item", start, width=width + gap)
        line.skip(gap)
        return True

    def finish_line(self, line: Line, text: str, containers: int, leaf, lazy: bool, opened: bool, stop: int) -> None:
        if line.blank():
            while len(self.stack) > containers and self.tip.kind not in ("code",):
                self.close()
            if leaf is not None and leaf.open:
                self.close()
            tip = self.tip
            if tip.children and tip.kind != "list":
                tip.children[-1].blank_after = True
            if tip.kind == "list":
                tip.children[-1].blank_after = True
            if tip.kind == "item" and not tip.children and not opened:
                tip.blank_after = True
            return
        if lazy and not opened:
            self.extend(leaf, line, text, stop)
            return
        if not opened:
            self.unwind(containers if leaf is None or not leaf.open else max(containers, len(self.stack)), opened)
        if self.tip.kind == "table":
            if self.row(self.tip, line, text, stop):
                return
            self.close()
        if self.tip.kind == "paragraph":
            self.extend(self.tip, line, text, stop)
            return
        line.indent()
        start = line.offset + line.next
        if self.table_start(line, text, stop):
            return
        block = self.add_block("paragraph", start)
        self.extend(block, line, text, stop)

    def extend(self, block: Block, line: Line, text: str, stop: int) -> None:
        line.indent()
        body = text[line.next :]
        self.keep_lead(block, line)
        block.text.append((body, line.offset + line.next))
        block.end_line, block.end = self.number + 1, stop
        at = body.find("{%")  # a tag left open on this line holds the next ones
        while at >= 0:
            end = find_tag_end(self.source, line.offset + line.next + at)
            if end is None:
                return
            if end < stop:
                at = body.find("{%", end - line.offset - line.next)
                continue
            last = self.source.count("\n", 0, end)
            if all(self.lines[k].strip(" \t>") for k in range(self.number + 1, last + 1)):
                self.text_until = max(self.text_until, last + 1)
            return

    # ---- tags

    def tag_at(self, line: Line, at: int) -> tuple[int, int] | None:
        """(offset of the closing `%}`, its line) if a tag stands alone on the lines from here."""
        if not line.text.startswith("{%", at):
            return None
        start = line.offset + at
        end = find_tag_end(self.source, start)
        if end is None or self.source[start + 2 : end].lstrip().startswith("$"):
            return None
        last = self.number
        while last + 1 < len(self.offsets) and self.offsets[last + 1] <= end:
            last += 1
        if self.source[end + 2 : self.offsets[last] + len(self.lines[last])].strip():
            return None
        return end, last

    def tag_body(self, start: int, end: int) -> str:
        """Between the delimiters, quote markers of continuation lines blanked so that offsets stay."""
        body = self.source[start + 2 : end]
        quotes = sum(1 for b in self.stack if b.kind == "blockquote")
        if not quotes or "\n" not in body:
            return body
        first, *later = body.split("\n")

        def blank(text: str) -> str:
            m = re.match(r"(?:[ \t]*>){0,%d}" % quotes, text)
            return m[0].replace(">", " ") + text[m.end() :]

        return "\n".join([first, *map(blank, later)])

    # ---- pipe tables

    def cells(self, text: str) -> list[tuple[int, str]]:
        """(offset, text) of each cell of a row; escaped pipes and pipes inside tags do not split."""
        body = text.rstrip(" \t")
        at = len(body) - len(body.lstrip(" \t"))
        if body.startswith("|", at):
            at += 1
        out, begin, k = [], at, at
        while k < len(body):
            if body.startswith("{%", k) and (end := find_tag_end(body, k)) is not None:
                k = end + 2
                continue
            if body[k] == "\\":
                k += 2
                continue
            if body[k] == "|":
                out.append((begin, body[begin:k]))
                begin = k + 1
            k += 1
        if begin < len(body):
            out.append((begin, body[begin:]))
        trimmed = []
        for offset, cell in out:
            lead = len(cell) - len(cell.lstrip(" \t"))
            trimmed.append((offset + lead, cell.strip(" \t")))
        return trimmed

    def table_start(self, line: Line, text: str, stop: int) -> bool:
        """A header row is one whose next line, in the same containers, is a row of delimiters with as many cells."""
        number = self.number
        if "|" not in text[line.next :] or number + 1 >= len(self.lines):
            return False
        follow = Line(self.lines[number + 1].removesuffix("\r"), self.offsets[number + 1])
        for block in self.stack[1:]:
            if block.kind == "blockquote":
                if follow.indent() > 3 or follow.text[follow.next : follow.next + 1] != ">":
                    return False
                follow.skip(3)
                follow.take(1)
                follow.skip(1)
            elif block.kind == "item":
                if follow.indent() < block.data["width"]:
                    return False
                follow.skip(block.data["width"])
        if follow.indent() > 3:
            return False
        rule = follow.text[follow.next :]
        if not _DELIMITERS.match(rule) or ("|" not in rule and ":" not in rule):
            return False
        marks = [c for _, c in self.cells(rule)]
        head = self.cells(text[line.next :])
        if len(marks) != len(head):
            return False
        align = [("center" if m[0] == m[-1] == ":" and len(m) > 1 else "left" if m[0] == ":" else "right" if m[-1] == ":" else None) for m in marks]
        block = self.add_block("table", line.offset + line.next, align=align)
        block.data["rows"] = [(self.number, [(line.offset + line.next + o, c) for o, c in head], line.offset + line.next, stop)]
        block.end_line, block.end = number + 2, follow.offset + len(follow.text)
        self.skip_until = number + 2
        return True

    def row(self, block: Block, line: Line, text: str, stop: int) -> bool:
        line.indent()
        base = line.offset + line.next
        block.data["rows"].append((self.number, [(base + o, c) for o, c in self.cells(text[line.next :])], base, stop))
        block.end_line, block.end = self.number + 1, stop
        return True
