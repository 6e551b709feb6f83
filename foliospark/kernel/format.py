"""Canonical source of a tree.

Each printer returns pieces: text, or a list of cells for a table row.  Where printing a node the
plain way would not read back as the same node, the reading wins: inline comments end no line,
closing fences carry their indent, tags whose children print nothing close themselves, only
absolute addresses become autolinks, table rows keep their item's indent and escape their pipes.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any, NamedTuple

from foliospark.functions.numbers import js_number
from foliospark.kernel.build import ParseOptions, parse
from foliospark.kernel.grammar import Attribute
from foliospark.kernel.tree import Node, deep
from foliospark.kernel.values import UNDEFINED, Function, Variable, is_number, js_string, js_truthy

MAX_DEPTH, MAX_HASHES, PASSES = 128, 1024, 4
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20\x7f<>]*")
_EMAIL = re.compile(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@(?!-)[A-Za-z0-9-]{1,63}(?<!-)(?:\.(?!-)[A-Za-z0-9-]{1,63}(?<!-))*")
_REFERENCE = re.compile(r"(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);")
Pieces = list


@dataclass(frozen=True)
class FormatOptions:
    max_tag_opening_width: int = 80
    ordered_list_mode: str = "repeat"
    allow_comments: bool = False


class Place(NamedTuple):
    """Where a node is printed."""

    indent: int = 0
    wraps: bool = False  # inside strong, em or s
    in_table_tag: bool = False
    cell: bool = False
    depth: int = 0


def width(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def joined(pieces: Pieces) -> str:
    return "".join(p if isinstance(p, str) else ",".join(p) for p in pieces)


def left_trimmed(pieces: Pieces) -> Pieces:
    for k, p in enumerate(pieces):
        if isinstance(p, str):
            if p.strip():
                return [p.lstrip(), *pieces[k + 1 :]]
        else:
            return pieces[k:]
    return []


def scalar_text(value: Any, depth: int = 0) -> str | None:
    """One value as source; None for undefined."""
    if value is UNDEFINED:
        return None
    if isinstance(value, Variable):
        return "$" + "".join(p if k == 0 else f".{p}" if isinstance(p, str) and _NAME.fullmatch(p) else f"[{js_number(p)}]" if is_number(p) else f'["{p}"]' for k, p in enumerate(value.path))
    if isinstance(value, Function):
        return f"{value.name}({', '.join(t for v in value.parameters.values() if (t := scalar_text(v, depth + 1)) is not None)})"
    if isinstance(value, list):
        return "[" + (", ".join(scalar_text(v, depth + 1) or "" for v in value) if depth < MAX_DEPTH else "") + "]"
    if isinstance(value, dict):
        rows = (f'{k if _NAME.fullmatch(k) else json.dumps(k, ensure_ascii=False)}: {scalar_text(v, depth + 1)}' for k, v in value.items())
        return "{" + (", ".join(rows) if depth < MAX_DEPTH else "") + "}"
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if is_number(value):
        return js_number(float(value))
    return json.dumps(value, ensure_ascii=False)


def annotation_text(a: Attribute) -> str | None:
    if a.kind == "class" and _NAME.fullmatch(a.name):
        return "." + a.name
    text = scalar_text(a.value)
    if text is None or a.name == "primary":
        return text
    if a.name == "id" and isinstance(a.value, str) and _NAME.fullmatch(a.value):
        return "#" + a.value
    return f"{a.name}={text}"


def escape_part(text: str, special: str) -> str:
    """Part of a destination or title: what would read as something else is escaped."""
    out = []
    for k, ch in enumerate(text):
        if ch == "\n":
            out.append("&#10;")
        elif ch == "\r":
            out.append("&#13;")
        elif ch == "\xa0":
            out.append("&nbsp;")
        elif ch == "\\" and (k + 1 == len(text) or not (text[k + 1].isalnum() or text[k + 1].isspace()) or text[k + 1] in "\n\r\xa0"):
            out.append("\\\\")
        elif ch == "&" and _REFERENCE.match(text, k + 1):
            out.append("\\&")
        elif ch in special:
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


class Printer:
    def __init__(self, options: FormatOptions):
        self.options = options

    def node(self, n: Node, at: Place) -> Pieces:
        if at.depth >= MAX_DEPTH:
            return []
        inner = Place(at.indent, n.type in ("strong", "em", "s"), n.type == "tag" and n.tag == "table", at.cell or n.type in ("td", "th"), at.depth + 1)
        return getattr(self, "_" + n.type)(n, at, inner)

    def children(self, n: Node, at: Place) -> Pieces:
        out: Pieces = []
        for c in n.children:
            if c.type == "comment" and not c.inline and out and not self.ends_comment(out):
                out.append("\n")
            out += self.node(c, at)
        return out

    @staticmethod
    def ends_comment(pieces: Pieces) -> bool:
        return isinstance(pieces[-1], str) and pieces[-1].endswith("-->\n")

    @staticmethod
    def annotations(n: Node) -> Pieces:
        texts = [t for a in n.annotations if (t := annotation_text(a)) is not None]
        return ["{% " + " ".join(texts) + " %}"] if n.annotations else []

    def _document(self, n, at, inner):
        front = n.attributes.get("frontmatter")
        head = [f"---\n{front}\n---\n\n"] if isinstance(front, str) and front else []
        return head + left_trimmed(self.children(n, inner))

    def _heading(self, n, at, inner):
        level = n.attributes.get("level")
        hashes = min(int(level), MAX_HASHES) if is_number(level) and level >= 1 else 1
        return ["\n", " " * at.indent, "#" * hashes, " ", *left_trimmed(self.children(n, inner)), *self.annotations(n), "\n"]

    def _paragraph(self, n, at, inner):
        return ["\n", *self.children(n, inner), *self.annotations(n), "\n"]

    def _inline(self, n, at, inner):
        return [" " * at.indent, *self.children(n, inner)]

    def destination(self, value: Any, titled: bool) -> str:
        if isinstance(value, str) and value:
            odd = value.startswith("<") or any(c == " " or (c < " " or c == "\x7f") and c not in "\n\r" for c in value)
            return f"<{escape_part(value, '<>')}>" if odd else escape_part(value, "()")
        if value is UNDEFINED or value == "":
            return "<>" if titled else ""
        return scalar_text(value) or ""

    def titled(self, n: Node) -> str:
        title = n.attributes.get("title", UNDEFINED)
        return f' "{escape_part(js_string(title), chr(34))}"' if js_truthy(title) else ""

    def _image(self, n, at, inner):
        alt = n.attributes.get("alt", "")
        alt = alt if isinstance(alt, str) else scalar_text(alt) or ""
        alt = alt.replace("\n", "\n" + " " * inner.indent)
        title = self.titled(n)
        return [f"![{alt}](", self.destination(n.attributes.get("src", UNDEFINED), bool(title)), title, ")"]

    def _link(self, n, at, inner):
        text, href, title = joined(self.children(n, inner)), n.attributes.get("href", UNDEFINED), self.titled(n)
        if not title and isinstance(href, str):
            if text == href and _ABSOLUTE.fullmatch(href):
                return [f"<{href}>"]
            if href == "mailto:" + text and _EMAIL.fullmatch(text) and any("{%" in c.attributes.get("content", "") for c in n.walk() if isinstance(c.attributes.get("content"), str)):
                return [f"<{text}>"]
        return ["[", text, "](", self.destination(href, bool(title)), title, ")"]

    def _text(self, n, at, inner):
        content = n.attributes.get("content", UNDEFINED)
        if content is UNDEFINED:
            return []
        if isinstance(content, Variable | Function):
            return ["{% ", scalar_text(content), " %}"]
        text = js_string(content)
        text = re.sub(r"[*_~]", r"\\\g<0>", text) if at.wraps else re.sub(r"^\*|#+\s|^>", r"\\\g<0>", text, count=1)
        text = text.replace("\xa0", "&nbsp;")
        return [text.replace("|", "\\|") if at.cell else text]

    def _blockquote(self, n, at, inner):
        prefix = "\n" + " " * at.indent + "> "
        texts = [joined(left_trimmed(self.node(c, inner._replace(indent=0)))).rstrip() for c in n.children]
        # a comment's later lines keep the marks they were read with
        texts = [t if c.type == "comment" else t.replace("\n", prefix) for t, c in zip(texts, n.children, strict=True)]
        return [prefix + f"{prefix}{prefix}".join(texts) + "\n"] if texts else [prefix + "\n"]

    def _hr(self, n, at, inner):
        return ["\n", " " * at.indent, "---", "\n"]

    def _fence(self, n, at, inner):
        content = n.attributes.get("content", "")
        content = content if isinstance(content, str) else js_string(content)
        runs = [len(m) for m in re.findall("`{3,}", content)]
        mark, pad = "`" * (max(runs) + 1 if runs else 3), " " * at.indent
        language = n.attributes.get("language", UNDEFINED)
        out = ["\n", pad, mark, js_string(language) if js_truthy(language) else ""]
        if n.annotations:
            out += [" ", *self.annotations(n)]
        out += ["\n", pad, content.replace("\n", "\n" + pad)]
        return [*out, *([] if content.endswith("\n") else ["\n", pad]), mark, "\n"]

    def attribute_texts(self, n: Node) -> list[str]:
        out = []
        for key, value in n.attributes.items():
            if key == "class" and isinstance(value, dict):
                out += [annotation_text(Attribute("class", name, value)) for name in value]
            else:
                out.append(annotation_text(Attribute("attribute", key, value)))
        return [t for t in out if t is not None]

    def _tag(self, n, at, inner):
        pad = " " * at.indent
        parts = ["{% " + (n.tag or ""), *self.attribute_texts(n)]
        opening = " ".join(parts)
        if not n.inline and width(opening) + 6 > self.options.max_tag_opening_width:
            opening = ("\n   " + pad).join(parts)
        body = self.children(n, inner) if n.children else []
        if n.children and n.children[0].type == "comment" and not n.children[0].inline:
            body = ["\n", *body]
        full = bool(joined(body).strip())
        out = [] if n.inline else ["\n", pad]
        out.append(f"{opening} {'' if full else '/'}%}}")
        if full:
            out += [*body, *([] if n.inline else [pad]), "{% /" + (n.tag or "") + " %}"]
        return [*out, *([] if n.inline else ["\n"])]

    def _list(self, n, at, inner):
        loose = any(c.type == "paragraph" for item in n.children for c in item.children)
        marker, start = n.attributes.get("marker"), n.attributes.get("start", 1.0)
        out: Pieces = []
        for k, item in enumerate(n.children):
            if js_truthy(n.attributes.get("ordered", False)):
                number = int(start) + k if self.options.ordered_list_mode == "increment" else start if k == 0 else 1
                prefix = js_number(float(number)) + (marker if isinstance(marker, str) else ".")
            else:
                prefix = marker if isinstance(marker, str) else "-"
            text = joined(left_trimmed(self.node(item, inner._replace(indent=at.indent + width(prefix) + 1))))
            out.append("\n" + " " * at.indent + prefix + " " + (text.strip() if not loose or k == len(n.children) - 1 else text))
        return [*out, "\n"]

    def _item(self, n, at, inner):
        out: Pieces = []
        for k, c in enumerate(n.children):
            if c.type == "comment" and not c.inline and out and not self.ends_comment(out):
                out.append("\n")
            out += self.node(c, inner)
            if k == 0:
                out += self.annotations(n)
        return out

    def wrapped(self, n, inner, default):
        marker = n.attributes.get("marker")
        marker = marker if isinstance(marker, str) else default
        return [marker, joined(self.children(n, inner)).strip(), marker]

    def _strong(self, n, at, inner):
        return self.wrapped(n, inner, "**")

    def _em(self, n, at, inner):
        return self.wrapped(n, inner, "*")

    def _s(self, n, at, inner):
        return ["~~", joined(self.children(n, inner)).strip(), "~~"]

    def _code(self, n, at, inner):
        content = n.attributes.get("content", "")
        text = (content if isinstance(content, str) else scalar_text(content) or "").strip()
        return ["`", text.replace("|", "\\|") if at.cell else text, "`"]

    def _hardbreak(self, n, at, inner):
        return ["\\\n", " " * at.indent]

    def _softbreak(self, n, at, inner):
        return ["\n", " " * at.indent]

    def _comment(self, n, at, inner):
        content = js_string(n.attributes.get("content", ""))
        if n.inline:
            content = content.replace("\n", "\n" + " " * at.indent)
            return ["<!-- " + (content.replace("|", "\\|") if at.cell else content) + " -->"]
        return [" " * at.indent, f"<!-- {content} -->\n"]

    def _table(self, n, at, inner):
        pad = " " * at.indent
        rows = self.children(n, inner._replace(indent=inner.indent + 2))
        out: Pieces = []
        if at.in_table_tag:
            for k, row in enumerate(rows):
                if isinstance(row, str):
                    out += ["\n", row] if row.strip() else []
                    continue
                out += [f"\n{pad}---"] if k else []
                out += [f"\n{pad}- {cell}" for cell in row]
            return [*out, "\n"]
        grid = [r for r in rows if not isinstance(r, str)]
        if not grid:
            return []
        widths = [max(width(r[k]) for r in grid if k < len(r)) for k in range(max(map(len, grid)))]

        def line(cells: list[str]) -> str:
            return pad + "| " + " | ".join(cells) + " |\n"

        filled = [[c + " " * (w - width(c)) for c, w in zip(r, widths, strict=False)] for r in grid]
        return ["\n", line(filled[0]), line(["-" * w for w in widths[: len(grid[0])]]), *map(line, filled[1:])]

    def _thead(self, n, at, inner):
        return self.children(n, inner)[:1] or [[]]

    def _tbody(self, n, at, inner):
        return self.children(n, inner)

    def _tr(self, n, at, inner):
        return [[joined(self.node(c, inner)) for c in n.children]]

    def _td(self, n, at, inner):
        return [(joined(self.children(n, inner)) + joined(self.annotations(n))).strip()]

    _th = _td

    def _error(self, n, at, inner):
        return []

    _node = _error


def format_node(node: Node, options: FormatOptions | None = None) -> str:
    deep()
    return joined(left_trimmed(Printer(options or FormatOptions()).node(node, Place()))) if node.type == "document" else joined(Printer(options or FormatOptions()).node(node, Place())).lstrip()


def settle(source: str, options: FormatOptions | None = None) -> tuple[str, bool]:
    """(source formatted until it no longer changes, whether it settled within the allowed passes)."""
    options = options or FormatOptions()
    text, parsing = source.replace("\r\n", "\n"), ParseOptions(allow_comments=options.allow_comments, bare=True)
    for _ in range(PASSES):
        new = format_node(parse(text, parsing), options)
        if new == text:
            return text, True
        text = new
    return text, False
