"""Destinations as browsers receive them: percent-encoded parts and punycode hosts."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Characters that stay as they are, schemes whose host is recoded, schemes that need slashes for a host.
KEEP = ";/?:@&=+$,-_.!~*'()#"
RECODED = ("http:", "https:", "mailto:")
SLASHED = ("http:", "https:", "ftp:", "gopher:", "file:")

_KEPT = re.compile(r"%[0-9a-fA-F]{2}|[A-Za-z0-9;/?:@&=+$,\-_.!~*'()#]+|.", re.S)
_NOT_HOST = re.compile(r"[%/?;#'{}|\\^`<>\" \r\n\t]")
_SCHEME = re.compile(r"[A-Za-z0-9.+-]+:")
_PORT = re.compile(r":([0-9]*)$")
#: Destinations that normalize_link leaves as they are: an ASCII origin or none, then only characters that stay.
SETTLED = r"^(?:https?://[A-Za-z0-9_-]{1,63}(?:\.[A-Za-z0-9_-]{1,63}){0,3}(?::[0-9]{1,5})?(?:[/?#][A-Za-z0-9;/?:@&=+$,_.!~*'()#-]*)?|/?(?:[?#][A-Za-z0-9;/?:@&=+$,_.!~*'()#-]*)?|/[A-Za-z0-9;?:@&=+$,_.!~*'()#-][A-Za-z0-9;/?:@&=+$,_.!~*'()#-]*)\z"
_PART = re.compile(r"[+A-Za-z0-9_-]{0,63}")


def percent(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        return s if len(s) > 1 or s in KEEP or (s.isascii() and s.isalnum()) else "".join(f"%{b:02X}" for b in s.encode())

    return _KEPT.sub(one, text)


@dataclass
class Url:
    protocol: str = ""
    slashes: bool = False
    auth: str = ""
    host: str = ""
    port: str = ""
    path: str = ""
    query: str = ""
    hash: str = ""

    @classmethod
    def of(cls, text: str) -> Url:
        u = cls()
        rest = text.strip(" \t\n\r\x0b\x0c\xa0                　﻿")
        if m := _SCHEME.match(rest):
            u.protocol, rest = m[0], rest[m.end() :]
        hostless, two = u.protocol == "javascript:", rest.startswith("//")
        if two and not hostless:
            u.slashes, rest = True, rest[2:]
        if not hostless and (two or (u.protocol and u.protocol not in SLASHED)):
            ending = re.search(r"[/?#]", rest)
            sign = rest.rfind("@", 0, ending.start() + 1 if ending else len(rest))
            if sign >= 0:
                u.auth, rest = rest[:sign], rest[sign + 1 :]
            m = _NOT_HOST.search(rest)
            end = m.start() if m else len(rest)
            if end and rest[end - 1] == ":":
                end -= 1
            host, rest = rest[:end], rest[end:]
            if m := _PORT.search(host):
                u.port, host = m[1], host[: m.start()]
            if host.startswith("[") and host.endswith("]") and len(host) > 1:
                host = host[1:-1]
            else:
                host, behind = _valid_host(host)
                rest = behind + rest
            u.host = host if len(host.encode("utf-16-le")) // 2 <= 255 else ""
        for name, sign in (("hash", "#"), ("query", "?")):
            k = rest.find(sign)
            if k >= 0:
                setattr(u, name, rest[k:])
                rest = rest[:k]
        u.path = rest
        return u

    def text(self) -> str:
        host = f"[{self.host}]" if ":" in self.host else self.host
        return self.protocol + "//" * self.slashes + (self.auth + "@" if self.auth else "") + host + (":" + self.port if self.port else "") + self.path + self.query + self.hash


def _valid_host(host: str) -> tuple[str, str]:
    """(the labels that can be a host, what follows them)."""
    labels = host.split(".")
    for k, label in enumerate(labels):
        plain = "".join(c if c.isascii() else "x" for c in label)
        if not label or (_PART.fullmatch(plain) and len(label.encode("utf-16-le")) <= 126):
            continue
        lead = _PART.match(label)[0]
        return ".".join([*labels[:k], lead]), ".".join([label[len(lead) :], *labels[k + 1 :]])
    return host, ""


def host_ascii(host: str) -> str:
    """Each label that is not ASCII as punycode, without case folding."""
    before, sign, name = host.rpartition("@")
    labels = re.split("[.。．｡]", name)
    return before + sign + ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)


def normalize_link(url: str) -> str:
    u = Url.of(url)
    if u.host and (not u.protocol or u.protocol in RECODED):
        u.host = host_ascii(u.host)
    for part in ("auth", "host", "path", "query", "hash"):
        setattr(u, part, percent(getattr(u, part)))
    return u.text()
