"""Inline Markdown and inline tags of one run of text, as a flat stream of events.

Events are ("text", s, span), ("code", s, span), ("soft",), ("hard",), ("open", type, attributes),
("close", type), ("tag", body, span), ("comment", s, span) and ("image", attributes).  Tags are
taken whole at their `{%`, so nothing inside one is markup.  There is no raw HTML.
"""

from __future__ import annotations

import html
import re
import unicodedata

from foliospark.kernel.grammar import find_tag_end

_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SPECIAL = re.compile(r"[\\`*_~\[\]!<&{\n]")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{1,31}));")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x20]*)>")
_EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_UNSAFE = re.compile(r"(?:javascript|vbscript|file|data):", re.I)
_SAFE_DATA = re.compile(r"data:image/(?:gif|png|jpeg|webp);", re.I)
_BLANKS, _SPACES, _TICKS = re.compile(r"[ \t]*\n?[ \t]*"), re.compile(r" *"), re.compile(r"`+")
_PLAIN_DESTINATION = re.compile(r"[^\x00-\x20\x7f()<{\\]+(?=[) ])")


def _entity(m: re.Match) -> str:
    if m[1] or m[2]:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return html.entities.html5.get(m[3] + ";", m[0])


def entities(text: str) -> str:
    return _ENTITY.sub(_entity, text) if "&" in text else text


def unescape(text: str) -> str:
    """Backslash escapes and entities resolved, tags kept as written."""
    if "\\" not in text and "&" not in text:
        return text
    out, at = [], 0
    while at < len(text):
        if text.startswith("{%", at) and (end := find_tag_end(text, at)) is not None:
            out.append(text[at : end + 2])
            at = end + 2
            continue
        if text[at] == "\\" and at + 1 < len(text) and text[at + 1] in _PUNCTUATION:
            out.append(text[at + 1])
            at += 2
            continue
        if text[at] == "&" and (m := _ENTITY.match(text, at)):
            out.append(_entity(m))
            at = m.end()
            continue
        out.append(text[at])
        at += 1
    return "".join(out)


def unsafe_link(url: str) -> bool:
    """Whether a destination runs code or reads files: case, control characters and blanks in the scheme do not hide it."""
    plain = re.sub(r"[\x00-\x20\x7f-\x9f]", "", url)
    return bool(_UNSAFE.match(plain)) and not _SAFE_DATA.match(plain)


def label_key(label: str) -> str:
    return " ".join(label.split()).casefold()


def destination(text: str, at: int) -> tuple[str, int] | None:
    """(destination as written, offset behind it); tags inside it are opaque."""
    if m := _PLAIN_DESTINATION.match(text, at):
        return m[0], m.end()
    if text.startswith("<", at):
        k = at + 1
        while k < len(text):
            if text[k] == "\\":
                k += 2
                continue
            if text[k] in "\n<":
                return None
            if text[k] == ">":
                return text[at + 1 : k], k + 1
            k += 1
        return None
    k, depth = at, 0
    while k < len(text):
        ch = text[k]
        if text.startswith("{%", k) and (end := find_tag_end(text, k)) is not None:
            if re.search(r"\s", text[k : end + 2]):
                break
            k = end + 2
            continue
        if ch == "\\" and k + 1 < len(text) and text[k + 1] in _PUNCTUATION:
            k += 2
            continue
        if ch <= " " or ch == "\x7f":
            break
        if ch == "(":
            depth += 1
            if depth > 32:
                return None
        elif ch == ")":
            if depth == 0:
                break
            depth -= 1
        k += 1
    return (text[at:k], k) if depth == 0 else None


def title(text: str, at: int) -> tuple[str, int] | None:
    if at >= len(text) or text[at] not in "\"'(":
        return None
    close = {'"': '"', "'": "'", "(": ")"}[text[at]]
    k = at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        if text[k] == close:
            return text[at + 1 : k], k + 1
        if text[k] == "(" and close == ")":
            return None
        k += 1
    return None


def blanks(text: str, at: int) -> int:
    """Offset behind spaces with at most one line end among them."""
    return _BLANKS.match(text, at).end()


def _is_space(ch: str) -> bool:
    return ch == "" or ch.isspace()


def _is_mark(ch: str) -> bool:
    return ch != "" and (ch in _PUNCTUATION or unicodedata.category(ch)[0] in "PS")


class Inline:
    def __init__(self, text: str, references: dict[str, tuple[str, str | None]], comments: bool = False):
        self.text, self.references, self.comments = text, references, comments
        self.out: list[list] = []
        self.marks: list[dict] = []  # delimiter runs
        self.brackets: list[dict] = []

    def push(self, *event) -> None:
        self.out.append(list(event))

    def add_text(self, s: str, start: int, end: int) -> None:
        self.push("text", s, (start, end))

    def run(self) -> list[list]:
        text, at, n = self.text, 0, len(self.text)
        self.ticks: dict[int, list[int]] | None = None
        if text and not _SPECIAL.search(text):
            return [["text", text, (0, n)]]
        while at < n:
            m = _SPECIAL.search(text, at)
            stop = m.start() if m else n
            if stop > at:
                piece = text[at:stop]
                if stop < n and text[stop] == "\n":
                    piece = piece.rstrip(" ")
                if piece:
                    self.add_text(piece, at, at + len(piece))
                at = stop
                continue
            at = self.special(text[at], at)
        self.emphasis(0)
        return self.out

    def special(self, ch: str, at: int) -> int:
        text = self.text
        if ch == "\n":
            spaces = at - len(text[:at].rstrip(" "))
            self.push("hard", None, (at - spaces, at)) if spaces >= 2 else self.push("soft", None, (at, at + 1))
            return _SPACES.match(text, at + 1).end()
        if ch == "\\":
            if text.startswith("\n", at + 1):
                self.push("hard", None, (at, at + 1))
                return _SPACES.match(text, at + 2).end()
            if at + 1 < len(text) and text[at + 1] in _PUNCTUATION:
                self.add_text(text[at + 1], at, at + 2)
                return at + 2
        elif ch == "{":
            if text.startswith("{%", at) and (end := find_tag_end(text, at)) is not None:
                self.push("tag", text[at + 2 : end], (at, end + 2))
                return end + 2
        elif ch == "`":
            return self.code(at)
        elif ch == "&":
            if m := _ENTITY.match(text, at):
                self.add_text(_entity(m), at, m.end())
                return m.end()
        elif ch == "<":
            if self.comments and text.startswith("<!--", at) and (end := text.find("-->", at + 4)) >= 0:
                self.push("comment", text[at + 4 : end].strip(), (at, end + 3))
                return end + 3
            for pattern, prefix in ((_AUTOLINK, ""), (_EMAIL, "mailto:")):
                m = pattern.match(text, at)
                if m and not unsafe_link(m[1]):
                    self.push("open", "link", {"href": prefix + m[1]}, (at, m.end()))
                    self.add_text(m[1], at + 1, m.end() - 1)
                    self.push("close", "link", (at, m.end()))
                    return m.end()
        elif ch in "*_~":
            return self.delimiter(ch, at)
        elif ch == "!":
            if text.startswith("![", at):
                self.brackets.append({"out": len(self.out), "at": at + 2, "image": True, "live": True, "marks": len(self.marks)})
                self.add_text("![", at, at + 2)
                return at + 2
        elif ch == "[":
            self.brackets.append({"out": len(self.out), "at": at + 1, "image": False, "live": True, "marks": len(self.marks)})
            self.add_text("[", at, at + 1)
            return at + 1
        elif ch == "]":
            return self.close_bracket(at)
        self.add_text(ch, at, at + 1)
        return at + 1

    def code(self, at: int) -> int:
        text = self.text
        if self.ticks is None:
            self.ticks = {}
            for m in _TICKS.finditer(text):
                self.ticks.setdefault(len(m[0]), []).append(m.start())
        size = _TICKS.match(text, at).end() - at
        close = next((p for p in self.ticks.get(size, ()) if p > at), None)
        if close is None:
            self.add_text("`" * size, at, at + size)
            return at + size
        body = text[at + size : close].replace("\n", " ")
        if body.strip(" ") and body[0] == body[-1] == " ":
            body = body[1:-1]
        self.push("code", body, (at, close + size))
        return close + size

    def delimiter(self, ch: str, at: int) -> int:
        text = self.text
        end = at
        while end < len(text) and text[end] == ch:
            end += 1
        before, after = text[at - 1 : at], text[end : end + 1]
        left = not _is_space(after) and (not _is_mark(after) or _is_space(before) or _is_mark(before))
        right = not _is_space(before) and (not _is_mark(before) or _is_space(after) or _is_mark(after))
        if ch == "_":
            opens, closes = left and (not right or _is_mark(before)), right and (not left or _is_mark(after))
        else:
            opens, closes = left, right
        if ch == "~" and end - at > 2:
            opens = closes = False
        self.marks.append({"ch": ch, "n": end - at, "size": end - at, "out": len(self.out), "opens": opens, "closes": closes, "live": True})
        self.add_text(text[at:end], at, end)
        return end

    def close_bracket(self, at: int) -> int:
        text = self.text
        if not self.brackets:
            self.add_text("]", at, at + 1)
            return at + 1
        opener = self.brackets.pop()
        if not opener["live"]:
            self.add_text("]", at, at + 1)
            return at + 1
        label = text[opener["at"] : at]
        found = self.target(at, label)
        if found is None or unsafe_link(found[0]):
            self.add_text("]", at, at + 1)
            return at + 1
        href, heading, end = found
        start = opener["at"] - (2 if opener["image"] else 1)
        if opener["image"]:
            del self.out[opener["out"] :]
            del self.marks[opener["marks"] :]
            attributes = {"src": href, "alt": label} | ({"title": heading} if heading is not None else {})
            self.push("image", attributes, (start, end))
        else:
            self.emphasis(opener["marks"])
            self.out[opener["out"]] = ["open", "link", {"href": href} | ({"title": heading} if heading is not None else {}), (start, end)]
            self.push("close", "link", (start, end))
            for b in self.brackets:
                if not b["image"]:
                    b["live"] = False
        return end

    def target(self, at: int, label: str) -> tuple[str, str | None, int] | None:
        """(destination, title, offset behind) of what follows a closing bracket."""
        text = self.text
        if text.startswith("(", at + 1):
            k = blanks(text, at + 2)
            got = destination(text, k)
            if got is not None:
                url, k = got
                gap = blanks(text, k)
                heading = title(text, gap) if gap > k else None
                if heading is not None:
                    k = blanks(text, heading[1])
                else:
                    k = gap
                if text.startswith(")", k):
                    return unescape(url), None if heading is None else unescape(heading[0]), k + 1
        if text.startswith("[", at + 1):
            end = text.find("]", at + 2)
            if end > 0:
                inner = text[at + 2 : end]
                if inner.strip() and "[" not in inner:
                    if (ref := self.references.get(label_key(inner))) is not None:
                        return ref[0], ref[1], end + 1
                    return None
                if not inner and (ref := self.references.get(label_key(label))) is not None:
                    return ref[0], ref[1], end + 1
        if "[" not in label and (ref := self.references.get(label_key(label))) is not None:
            return ref[0], ref[1], at + 1
        return None

    def emphasis(self, bottom: int) -> None:
        """Match delimiter runs from `bottom` on; opens and closes go into the events around their text."""
        marks = self.marks
        if len(marks) == bottom:
            return
        inserts: dict[int, tuple[list, list]] = {}  # event: (closes before its text, opens after it)
        floor: dict[tuple, int] = {}
        k = bottom
        while k < len(marks):
            c = marks[k]
            if not c["closes"] or not c["n"]:
                k += 1
                continue
            key = (c["ch"], c["opens"], c["size"] % 3, c["n"] if c["ch"] == "~" else 0)
            j, found = k - 1, None
            while j >= max(bottom, floor.get(key, bottom)):
                o = marks[j]
                if o["live"] and o["n"] and o["opens"] and o["ch"] == c["ch"]:
                    odd = (o["closes"] or c["opens"]) and (o["size"] + c["size"]) % 3 == 0 and (o["size"] % 3 or c["size"] % 3)
                    if (c["ch"] == "~" and o["n"] == c["n"]) or (c["ch"] != "~" and not odd):
                        found = o
                        break
                j -= 1
            if found is None:
                floor[key] = k
                if not c["opens"]:
                    c["live"] = False
                k += 1
                continue
            use = c["n"] if c["ch"] == "~" else 2 if found["n"] >= 2 and c["n"] >= 2 else 1
            kind = "s" if c["ch"] == "~" else "strong" if use == 2 else "em"
            attributes = {} if kind == "s" else {"marker": c["ch"] * use}
            for m in marks[j + 1 : k]:
                m["live"] = False
            found["n"] -= use
            c["n"] -= use
            inserts.setdefault(found["out"], ([], []))[1].insert(0, ["open", kind, attributes, self.out[found["out"]][2]])
            inserts.setdefault(c["out"], ([], []))[0].append(["close", kind, self.out[c["out"]][2]])
            if not c["n"]:
                k += 1
        if inserts:
            left = {m["out"]: m for m in marks[bottom:]}
            first = min(inserts)
            fresh = []
            for i in range(first, len(self.out)):
                closes, opens = inserts.get(i, ((), ()))
                event = self.out[i]
                if i in left and left[i]["n"] != left[i]["size"]:
                    event = ["text", event[1][: left[i]["n"]], event[2]]
                mine = left.get(i)
                body = [event] if event[0] != "text" or event[1] else []
                if mine is not None and (closes or opens):
                    fresh += [*closes, *body, *opens]
                else:
                    fresh += body
            self.out[first:] = fresh
        del marks[bottom:]
