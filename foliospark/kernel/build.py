"""From blocks and inline events to a document tree."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from foliospark.kernel.blocks import Block
from foliospark.kernel.grammar import Attribute, TagError, find_tag_end, known_tag, parse_tag, tag_in_url
from foliospark.kernel.inline import unescape
from foliospark.kernel.tokenizer import MARKDOWN, Tokenizer
from foliospark.kernel.tree import Node, Positions, Problem, annotate, deep


@dataclass(frozen=True)
class ParseOptions:
    file: str | None = None
    slots: bool = False
    location: bool = True
    allow_comments: bool = False
    validated_protocols: tuple[str, ...] = ()
    conditional_tags: tuple[str, ...] = ("if",)
    tokenizer: Tokenizer = MARKDOWN
    bare: bool = False  # no lines and places of inline nodes: for trees that are only rendered


@dataclass
class Run:
    """Text of one inline run and where its pieces stand in the source."""

    text: str
    starts: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, pieces: list[tuple[str, int]], end: str = "") -> Run:
        run = cls("\n".join(t for t, _ in pieces) + (end if pieces else ""))
        at = 0
        for text, offset in pieces:
            run.starts.append(at)
            run.offsets.append(offset)
            at += len(text) + 1
        return run

    def at(self, k: int) -> int:
        i = max(0, bisect_right(self.starts, k) - 1)
        return self.offsets[i] + k - self.starts[i] if self.starts else 0


class Builder:
    def __init__(self, source: str, options: ParseOptions):
        self.source, self.options = source, options
        self.positions = Positions(source)
        self.stack = [Node("document", lines=[0, 0], span=(0, len(source)))]
        self.owner: int | None = None  # place on the stack of the block that owns the inline run

    def parse(self) -> Node:
        tokens = self.options.tokenizer.blocks(self.source, self.options.allow_comments)
        self.references = tokens.references
        self.stack[0].lines = [0, tokens.n_lines] if tokens.n_lines else []
        for block in tokens.root.children:
            self.block(block, False)
        self.close_tags(0)
        rewrite_tables(self.stack[0], self.options.conditional_tags)
        return self.stack[0]

    # ---- the stack

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def attach(self, node: Node) -> None:
        top = self.top
        if node.type == "text" and top.children and (last := top.children[-1]).type == "text" and last.inline == node.inline and not node.errors:
            text = node.attributes.get("content")
            if isinstance(text, str) and isinstance(last.attributes.get("content"), str):
                last.attributes["content"] += text
                if last.span and node.span:
                    last.span = (last.span[0], node.span[1])
                return
        if self.options.slots and node.tag == "slot" and isinstance(name := node.attributes.get("primary"), str):
            top.slots[name] = node
            return
        top.children.append(node)

    def finish(self) -> None:
        node = self.stack.pop()
        self.attach(node)

    def close_tags(self, depth: int) -> None:
        """Close what is open above `depth`; a tag among it lacks its closing."""
        while len(self.stack) > depth + 1:
            node = self.top
            if node.type == "tag":
                node.errors.append(Problem("missing-closing", "critical", f"Node '{node.name}' is missing closing"))
            self.finish()

    def lines(self, span: tuple[int, int]) -> list[int]:
        return [self.positions.line(span[0]), self.positions.line(max(span[0], span[1] - 1)) + 1]

    # ---- blocks

    def block(self, b: Block, tight: bool) -> None:
        span = (b.start, max(b.start, b.end))
        lines = [b.line, max(b.end_line, b.line + 1)]
        make = lambda kind, **attributes: Node(kind, attributes, lines=list(lines), span=span)
        if b.kind == "tagline":
            self.tag(b.data["body"], span, False)
        elif b.kind == "paragraph":
            if not b.text:
                return
            last, offset = b.text[-1]
            run = Run.of([*b.text[:-1], (last.rstrip(" \t"), offset)])
            if not run.text.strip():
                return
            leads = b.data.get("leads")
            if tight and self.top.type == "item":
                self.run(run, leads)
            else:
                self.stack.append(make("paragraph"))
                self.run(run, leads)
                self.finish()
        elif b.kind == "heading":
            self.stack.append(make("heading", level=float(b.data["level"])))
            run = Run.of(b.text)
            if run.text:
                self.run(run)
            self.finish()
        elif b.kind == "hr":
            self.attach(make("hr"))
        elif b.kind == "comment":
            self.attach(make("comment", content=b.data["content"]))
        elif b.kind == "code":
            self.code(b, make)
        elif b.kind == "table":
            self.table(b, make)
        elif b.kind in ("blockquote", "item"):
            self.stack.append(make(b.kind))
            depth = len(self.stack) - 1
            for child in b.children:
                self.block(child, tight)
            self.close_tags(depth)
            self.finish()
        elif b.kind == "list":
            attributes = {"ordered": b.data["ordered"]}
            if b.data["ordered"] and b.data["first"] != 1:
                attributes["start"] = float(b.data["first"])
            self.stack.append(make("list", **attributes, marker=b.data["marker"]))
            for item in b.children:
                self.block(item, b.data["tight"])
            self.finish()

    def code(self, b: Block, make) -> None:
        run = Run.of(b.text, "\n")
        node = make("fence", content=run.text)
        info = unescape(b.data["info"] or "")
        language = info.split(" ")[0]
        if language and language != "{%":
            node.attributes["language"] = language
        start = info.find("{%")
        end = find_tag_end(info, start) if start >= 0 else None
        if end is not None:
            try:
                item = parse_tag(info[start + 2 : end].strip())
                if item.kind in ("annotation", "open"):
                    annotate(node, item.attributes)
            except TagError as e:
                node.errors.append(Problem("fence-tag-error", "error", f"Syntax error in fence tag: {e.message}"))
        if node.attributes.get("process") is not True:
            self.attach(node)
            return
        self.stack.append(node)
        depth, text, done, at = len(self.stack) - 1, run.text, 0, 0
        while (at := text.find("{%", at)) >= 0:
            end = find_tag_end(text, at)
            if end is None:
                at += 2
                continue
            head = text.rfind("\n", 0, at)
            tail = text.find("\n", end)
            alone = head >= 0 and text[head : tail if tail >= 0 else len(text)].strip() == text[at : end + 2]
            self.plain(run, done, head if alone else at)
            self.tag(text[at + 2 : end], (run.at(at), run.at(end + 1) + 1), False)
            done = at = end + 2
        self.plain(run, done, len(text))
        self.close_tags(depth)
        self.finish()

    def plain(self, run: Run, start: int, end: int) -> None:
        if end > start:
            self.attach(Node("text", {"content": run.text[start:end]}, lines=self.lines((run.at(start), run.at(end - 1) + 1)), span=(run.at(start), run.at(end - 1) + 1)))

    def table(self, b: Block, make) -> None:
        self.stack.append(make("table"))
        align = b.data["align"]
        for k, (number, cells, start, stop) in enumerate(b.data["rows"]):
            place = {"lines": [number, number + 1], "span": (start, stop)}
            if k == 0:
                self.stack.append(Node("thead", **place))
            elif k == 1:
                self.stack.append(Node("tbody", **place))
            self.stack.append(Node("tr", **place))
            cells = (cells + [(stop, "")] * len(align))[: len(align)]
            for (offset, text), side in zip(cells, align, strict=True):
                cell = Node("th" if k == 0 else "td", {"align": side} if side else {}, lines=[number, number + 1], span=(offset, offset + len(text)))
                self.stack.append(cell)
                if text:
                    # an escaped pipe is one before the inline rules read it
                    self.run(Run.of([(text.replace("\\|", "|"), offset)]))
                self.finish()
            self.finish()
            if k == 0:
                self.finish()
        if len(b.data["rows"]) > 1:
            self.finish()
        self.finish()

    # ---- inline runs

    def run(self, run: Run, leads: dict[int, str] | None = None) -> None:
        """leads: white space that lines lost, by their number in the run."""
        wrapped = self.top.type == "tag" and not self.top.inline
        bare = self.options.bare
        span = None if bare else (run.at(0), run.at(max(0, len(run.text) - 1)) + 1)
        if wrapped:
            self.stack.append(Node("paragraph", lines=[] if bare else self.lines(span), span=span))
        self.owner = len(self.stack) - 1
        inline = Node("inline", lines=[] if bare else list(self.top.lines), span=span)
        self.stack.append(inline)
        depth = len(self.stack) - 1
        for event in self.options.tokenizer.inline(run.text, self.references, self.options.allow_comments):
            if leads and event[0] == "comment":
                event = ["comment", with_leads(run.text, *event[-1], leads), event[-1]]
            self.event(event, run, depth)
        self.close_tags(depth)
        protocols = list(self.options.validated_protocols)
        if protocols and tag_in_url(run.text, protocols):
            inline.errors.append(Problem("href-format-invalid", "error", HREF_MESSAGE))
        self.owner = None
        self.finish()
        if wrapped:
            self.finish()

    def event(self, event: list, run: Run, depth: int) -> None:
        kind, a = event[0], event[-1]
        if self.options.bare and kind != "tag":
            span, lines = None, []
        else:
            span = (run.at(a[0]), run.at(max(a[0], a[1] - 1)) + 1)
            lines = self.lines(span)
        if kind in ("text", "code", "comment"):
            self.attach(Node(kind, {"content": event[1]}, lines=lines, inline=True, span=span))
        elif kind in ("soft", "hard"):
            self.attach(Node(kind + "break", lines=lines, inline=True, span=span))
        elif kind == "image":
            self.attach(Node("image", dict(event[1]), lines=lines, inline=True, span=span))
        elif kind == "open":
            self.stack.append(Node(event[1], dict(event[2]), lines=lines, inline=True, span=span))
        elif kind == "close":
            at = next((k for k in range(len(self.stack) - 1, depth, -1) if self.stack[k].type == event[1]), None)
            if at is not None:
                self.close_tags(at)
                self.finish()
        elif kind == "tag":
            self.tag(event[1], span, True)

    # ---- tags

    def tag(self, body: str, span: tuple[int, int], inline: bool) -> None:
        trimmed = body.strip()
        lines = [] if self.options.bare else [self.positions.line(span[0]), self.positions.line(max(span[0], span[1] - 1)) + 1]
        start = span[0] + 2 + len(body) - len(body.lstrip())
        item = known_tag(trimmed)
        if isinstance(item, TagError):
            node = Node("error", lines=lines, inline=inline, span=span)
            node.errors.append(Problem("parse-error", "critical", item.message, (start + item.start, start + item.end)))
            self.attach(node)
            return
        moved = lambda at: None if at is None else at + start
        attributes = item.attributes if self.options.bare else [Attribute(a.kind, a.name, a.value, a.start + start, a.end + start, moved(a.value_start), moved(a.value_end)) for a in item.attributes]
        if item.kind == "value":
            self.attach(Node("text", {"content": item.value}, lines=lines, inline=inline, span=span))
        elif item.kind == "open":
            node = Node("tag", tag=item.name, lines=lines, inline=inline, span=span)
            annotate(node, attributes)
            self.stack.append(node)
            if item.self_closing:
                self.finish()
        elif item.kind == "close":
            if self.top.type == "tag" and self.top.tag == item.name:
                self.top.lines += lines
                self.top.span = (self.top.span[0], span[1])
                self.finish()
                return
            node = Node("tag", tag=item.name, lines=lines, inline=inline, span=span)
            node.errors.append(Problem("missing-opening", "critical", f"Node '{item.name}' is missing opening"))
            self.attach(node)
        elif self.owner is not None:
            annotate(self.stack[self.owner], attributes)
        else:
            self.top.errors.append(Problem("no-inline-annotations", "error", f"Can't apply inline annotations to '{self.top.name}'", span))


# Fixed value: the message of href-format-invalid.
HREF_MESSAGE = "The 'href' format cannot contain a tag or variable. URLs must be static strings."


def with_leads(text: str, start: int, stop: int, leads: dict[int, str]) -> str:
    """A comment's content with the white space before its later lines."""
    first = text.count("\n", 0, start)
    lines = text[start + 4 : stop - 3].split("\n")
    return "\n".join(leads.get(first + k, "") * (k > 0) + line for k, line in enumerate(lines)).strip()


def _is_comment(node: Node) -> bool:
    return node.type == "comment" or node.type == "tag" and node.tag == "comment"


def rewrite_tables(document: Node, conditional: tuple[str, ...]) -> None:
    """Rows written as lists inside table tags become a table with head and body."""

    def misplaced(node: Node) -> Problem:
        what = f"{node.type} {node.tag}" if node.tag else node.type
        return Problem("table-syntax", "critical", f"Found {what} where a list was expected. Make sure all content inside table cells is indented.", node.span)

    def as_row(node: Node, cell: str) -> Node:
        node.type, node.attributes = "tr", {}
        for child in node.children:
            child.type = cell
        return node

    wraps = lambda n: n.type == "tag" and n.tag in conditional
    todo = [document]
    while todo:
        node = todo.pop()
        if node.type == "tag" and node.tag == "table" and node.children and node.children[0].type != "table":
            first, *others = node.children
            head, body = Node("thead"), Node("tbody")
            if first.type == "list":
                head.children.append(as_row(first, "th"))
            for row in others:
                if row.type == "list":
                    body.children.append(as_row(row, "td"))
                elif wraps(row):
                    kept = []
                    for child in row.children:
                        if child.type == "list":
                            kept.append(as_row(child, "td"))
                        elif _is_comment(child) or child.tag == "else" or wraps(child):
                            kept.append(child)
                        elif child.type != "hr":
                            row.errors.append(misplaced(child))
                    row.children = kept
                    body.children.append(row)
                elif row.type != "hr" and not _is_comment(row):
                    node.errors.append(misplaced(row))
            node.children = [Node("table", dict(node.attributes), [head, body])]
        todo += [*node.slots.values(), *node.children][::-1]


def parse(source: str, options: ParseOptions | None = None) -> Node:
    """The tree of one document."""
    deep()
    return Builder(source, options or ParseOptions()).parse()


def outline(node: Node, depth: int = 0) -> str:
    """One indented line a node, for tests and inspection."""
    from foliospark.kernel.values import encode

    own = "  " * depth + node.name + "".join(f" {k}={encode(v)}" for k, v in node.attributes.items())
    return "\n".join([own, *(outline(c, depth + 1) for c in [*node.slots.values(), *node.children])])
