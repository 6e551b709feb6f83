"""The grammar inside `{% ... %}`: tags, closings, annotations, variables and functions.

A body parses as a whole or fails with the message of its furthest failure: what was acceptable
there, described, sorted and without repeats, and what stood there instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from foliospark.kernel.values import Function, Variable, js_truthy

MAX_DEPTH = 64
_IDENT, _DIGITS, _SPACE = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[0-9]+"), " \n\t"
_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
_STRING = re.compile(r'"((?:[^\x00-\x1f"\\]|\\["\\nrt])*)"')
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t"}
_MISS = object()
#: What may stand before a closing `%}`; possessive, so that it never goes back.
_BEFORE_END = re.compile(r'(?:[^"%]++|"(?:[^"\\]++|\\.)*+"|%(?!\}))*+(?=%\})', re.S)


class TagError(ValueError):
    """A body that is no tag; start and end are character offsets into the body."""

    def __init__(self, message: str, start: int, end: int):
        super().__init__(message)
        self.message, self.start, self.end = message, start, end


@dataclass
class Attribute:
    """One written attribute: kind is attribute or class."""

    kind: str
    name: str
    value: Any
    start: int = 0
    end: int = 0
    value_start: int | None = None
    value_end: int | None = None


@dataclass
class Item:
    """What a body is: open, close, annotation or value."""

    kind: str
    name: str = ""
    attributes: list[Attribute] = field(default_factory=list)
    self_closing: bool = False
    value: Any = None


def _shown(text: str) -> str:
    out = []
    for ch in text:
        code = ord(ch)
        if ch in '\\"':
            out.append("\\" + ch)
        elif ch in "\0\t\n\r":
            out.append({"\0": "\\0", "\t": "\\t", "\n": "\\n", "\r": "\\r"}[ch])
        elif code < 0x20 or 0x7F <= code <= 0x9F:
            out.append(f"\\x{code:02X}")
        else:
            out.append(ch)
    return '"' + "".join(out) + '"'


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.far, self.wanted, self.depth, self.too_deep = text, 0, 0, set(), 0, None

    # What would have been accepted here: a name, or a literal shown in quotes.
    def want(self, what: str, at: int | None = None) -> None:
        at = self.at if at is None else at
        if at > self.far:
            self.far, self.wanted = at, set()
        if at == self.far:
            self.wanted.add(what)

    def lit(self, text: str) -> bool:
        self.want(_shown(text))
        if self.text.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def space(self, least: int = 0) -> bool:
        n = 0
        while True:
            self.want("whitespace")
            if self.at >= len(self.text) or self.text[self.at] not in _SPACE:
                return n >= least
            self.at += 1
            n += 1

    def named(self, what: str, pattern: re.Pattern) -> str | None:
        self.want(what)
        m = pattern.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[0]

    def error(self) -> TagError:
        if self.too_deep is not None:
            return TagError(f"Value nesting exceeds the maximum depth of {MAX_DEPTH}.", self.too_deep, min(self.too_deep + 1, len(self.text)))
        names = sorted(self.wanted) or ["end of input"]
        expected = names[0] if len(names) == 1 else " or ".join(names) if len(names) == 2 else ", ".join(names[:-1]) + ", or " + names[-1]
        found = _shown(self.text[self.far]) if self.far < len(self.text) else "end of input"
        return TagError(f"Expected {expected} but {found} found.", self.far, min(self.far + 1, len(self.text)))

    # ---- values

    def string(self):
        got = self.named("string", _STRING)
        return _MISS if got is None else re.sub(r"\\(.)", lambda m: _ESCAPES[m[1]], got[1:-1])

    def number(self):
        got = self.named("number", _NUMBER)
        return _MISS if got is None else float(got)

    def value(self):
        if self.depth >= MAX_DEPTH:
            if self.too_deep is None:
                self.too_deep = self.at
            return _MISS
        self.depth += 1
        try:
            for word, what, value in (("null", "null", None), ("true", "boolean", True), ("false", "boolean", False)):
                self.want(what)
                if self.text.startswith(word, self.at):
                    self.at += len(word)
                    return value
            for read in (self.string, self.number, self.array, self.hash, self.call, self.variable):
                got = read()
                if got is not _MISS:
                    return got
            return _MISS
        finally:
            self.depth -= 1

    def listed(self, item, trailing: bool) -> list | None:
        """Items between commas after the opening sign; None if the first is missing."""
        out, start = [], self.at
        first = item()
        if first is _MISS:
            self.at = start
            if trailing:
                return None
        out.append(first)
        while True:
            mark = self.at
            self.space()
            if not self.lit(","):
                self.at = mark
                break
            after = self.at
            self.space()
            got = item()
            if got is _MISS:
                self.at = after if trailing else mark
                break
            out.append(got)
        return out

    def array(self):
        start = self.at
        if not self.lit("["):
            return _MISS
        self.space()
        items = self.listed(self.value, True)
        self.space()
        if not self.lit("]"):
            self.at = start
            return _MISS
        return items or []

    def hash_item(self):
        start = self.at
        key = self.named("identifier", _IDENT)
        if key is None:
            key = self.string()
        if key is _MISS or not self.lit(":"):
            self.at = start
            return _MISS
        self.space()
        value = self.value()
        if value is _MISS:
            self.at = start
            return _MISS
        return key, value

    def hash(self):
        start = self.at
        if not self.lit("{"):
            return _MISS
        self.space()
        items = self.listed(self.hash_item, True)
        self.space()
        if not self.lit("}"):
            self.at = start
            return _MISS
        return {k: v for k, v in items or [] if k != "$$mdtype"}

    def parameter(self):
        start = self.at
        name = self.named("identifier", _IDENT)
        if name is None or not self.lit("="):
            self.at, name = start, None
        value = self.value()
        if value is _MISS:
            self.at = start
            return _MISS
        return name, value

    def call(self):
        start = self.at
        name = self.named("identifier", _IDENT)
        if name is None or not self.lit("("):
            self.at = start
            return _MISS
        self.space()
        items = self.listed(self.parameter, False)
        if not self.lit(")"):
            self.at = start
            return _MISS
        if items[0] is _MISS:  # a list without its first parameter is none at all
            items = []
        return Function(name, {n or str(i): v for i, (n, v) in enumerate(items)})

    def variable(self):
        start = self.at
        self.want("variable")
        if self.text[start : start + 1] not in ("$", "@") or not (m := _IDENT.match(self.text, start + 1)):
            return _MISS
        path: list[Any] = [m[0]]
        at = m.end()
        while True:
            if self.text.startswith(".", at) and (m := _IDENT.match(self.text, at + 1)):
                path.append(m[0])
                at = m.end()
                continue
            if self.text.startswith("[", at):
                m, s = _NUMBER.match(self.text, at + 1), _STRING.match(self.text, at + 1)
                got = m or s
                if got and self.text.startswith("]", got.end()):
                    path.append(float(m[0]) if m else re.sub(r"\\(.)", lambda e: _ESCAPES[e[1]], s[1]))
                    at = got.end() + 1
                    continue
            break
        self.at = at
        return path if self.text[start] == "@" else Variable(path)

    # ---- tags

    def attribute(self):
        start = self.at
        self.want("id")
        if self.text.startswith("#", start) and (m := _IDENT.match(self.text, start + 1)):
            self.at = m.end()
            return Attribute("attribute", "id", m[0], start, self.at)
        self.want("class")
        if self.text.startswith(".", start) and (m := _IDENT.match(self.text, start + 1)):
            self.at = m.end()
            return Attribute("class", m[0], True, start, self.at)
        name = self.named("identifier", _IDENT)
        if name is not None and self.lit("="):
            begin = self.at
            value = self.value()
            if value is not _MISS:
                return Attribute("attribute", name, value, start, self.at, begin, self.at)
        self.at = start
        return _MISS

    def attributes(self) -> list[Attribute]:
        first = self.attribute()
        if first is _MISS:
            return []
        out = [first]
        while True:
            mark = self.at
            if not self.space(1) or (got := self.attribute()) is _MISS:
                self.at = mark
                return out
            out.append(got)

    def top(self) -> Item | None:
        for read in (self.variable, self.call):
            self.at = 0
            got = read()
            if got is not _MISS:
                return Item("value", value=got)
        self.at = 0
        if attrs := self.attributes():
            self.space()
            return Item("annotation", attributes=attrs)
        self.at = 0
        name = self.named("tag name", _IDENT)
        if name is not None:
            self.space()
            begin = self.at
            primary = self.value()
            found = []
            if primary is not _MISS:
                end = self.at
                self.want("whitespace")
                if self.at < len(self.text) and self.text[self.at] in _SPACE:
                    self.at += 1
                if js_truthy(primary):
                    found.append(Attribute("attribute", "primary", primary, begin, end, begin, end))
            else:
                self.at = begin
            found += self.attributes()
            self.space()
            return Item("open", name, found, self.lit("/"))
        self.at = 0
        if self.lit("/"):
            name = self.named("tag name", _IDENT)
            if name is not None:
                return Item("close", name)
        return None


#: The parts of a plain tag: its name, one attribute behind white space, and what may end it.
_PLAIN_NAME = re.compile(r"[A-Za-z0-9_-]++(?=[ \n\t/]|\Z)")
_PLAIN_ATTRIBUTE = re.compile(
    r"[ \n\t]++(?:#(?P<id>[A-Za-z0-9_-]++)|\.(?P<class>[A-Za-z0-9_-]++)"
    r'|(?P<name>[A-Za-z0-9_-]++)=(?P<value>"(?P<string>(?:[^\x00-\x1f"\\]|\\["\\nrt])*+)"|(?P<number>-?[0-9]++(?:\.[0-9]++)?+)|null|true|false))(?=[ \n\t/]|\Z)'
)
_PLAIN_END = re.compile(r"[ \n\t]*+(/?)\Z")
#: A first attribute that begins so is read as a value before it is read as a name.
_LIKE_VALUE = re.compile(r"null|true|false|[-0-9]")
_WORDS = {"null": None, "true": True, "false": False}


def plain_tag(body: str) -> Item | None:
    """The tag that a body is if it has a name and attributes of strings, numbers and words only, as the reader would give it; None for all others."""
    head = _PLAIN_NAME.match(body)
    if head is None:
        return None
    at, found = head.end(), []
    while (m := _PLAIN_ATTRIBUTE.match(body, at)) is not None:
        at = m.end()
        kind = m.lastgroup
        if kind == "id":
            found.append(Attribute("attribute", "id", m["id"], m.start("id") - 1, at))
            continue
        if kind == "class":
            found.append(Attribute("class", m["class"], True, m.start("class") - 1, at))
            continue
        if not found and _LIKE_VALUE.match(m["name"]):
            return None
        if (text := m["string"]) is not None:
            value = re.sub(r"\\(.)", lambda e: _ESCAPES[e[1]], text) if "\\" in text else text
        else:
            value = float(m["number"]) if m["number"] is not None else _WORDS[m["value"]]
        found.append(Attribute("attribute", m["name"], value, m.start("name"), at, m.start("value"), at))
    end = _PLAIN_END.match(body, at)
    return None if end is None else Item("open", head[0], found, bool(end[1]))


def parse_tag(body: str) -> Item:
    """The item that a trimmed body is; raises TagError."""
    plain = plain_tag(body)
    return read_tag(body) if plain is None else plain


def read_tag(body: str) -> Item:
    """`parse_tag` by the reader, which knows every form."""
    reader = _Reader(body)
    item = reader.top()
    if item is None or reader.at != len(body):
        if item is not None:
            reader.want("end of input")
        raise reader.error()
    return item


@lru_cache(maxsize=8192)
def known_tag(body: str) -> Item | TagError:
    """What parse_tag gives or raises, remembered: corpora repeat their tags.  Results are shared and must not be changed."""
    try:
        return parse_tag(body)
    except TagError as e:
        return e


def parse_value(text: str) -> Any:
    """One value standing alone; raises TagError."""
    reader = _Reader(text)
    got = reader.value()
    if got is _MISS or reader.at != len(text):
        if got is not _MISS:
            reader.want("end of input")
        raise reader.error()
    return got


def find_tag_end(text: str, start: int = 0) -> int | None:
    """Offset of the `%}` that closes the tag begun before `start`, quotes and their escapes passed over."""
    m = _BEFORE_END.match(text, start)
    return m.end() if m else None


def tag_in_url(text: str, protocols: list[str]) -> bool:
    """Whether the first closed tag is glued to text holding `protocol://` for one of the protocols."""
    at = text.find("{%")
    while at >= 0:
        if find_tag_end(text, at) is None:
            at = text.find("{%", at + 2)
            continue
        before = re.split(r"[ \t\n\r\x0b\x0c]", text[:at])[-1]
        return any(f"{p}://" in before for p in protocols)
    return False
