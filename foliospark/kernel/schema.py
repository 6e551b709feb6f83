"""Schemas and configuration: what tags and nodes may hold and what they render.

A schema is data, and its hooks are plain Python callables; `Config.tables()` lays the data out
as rows for the DataFrame plans, and `Config.is_relational` says whether no hook needs the kernel.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from foliospark.functions.document import BUILTIN
from foliospark.functions.document import Function as ConfigFunction
from foliospark.kernel.tree import TYPES, Node, Problem
from foliospark.kernel.values import UNDEFINED, Variable, encode, is_number, js_truthy, type_name

PRIMITIVES = ("String", "Number", "Boolean", "Object", "Array")


@dataclass(frozen=True)
class AttributeType:
    """A custom attribute type: validate(value, config, name) -> problems, transform(value, config) -> value; either may be missing."""

    name: str
    validate: Callable[[Any, Config, str], list[Problem]] | None = None
    transform: Callable[[Any, Config], Any] | None = None


@dataclass(frozen=True)
class Pattern:
    """A pattern for `matches`: a test and how messages show it."""

    test: Callable[[str], bool]
    shown: str


@dataclass(frozen=True)
class Attribute:
    """type: a primitive's name, an AttributeType, a tuple of them (union) or None; render: True, False or another name."""

    type: Any = None
    render: bool | str = True
    default: Any = UNDEFINED
    required: bool = False
    matches: Any = None  # list of strings, Pattern, or callable(config) -> either
    validate: Callable[[Any, Config, str], list[Problem]] | None = None
    error_level: str | None = None
    description: str | None = None

    def output_name(self, key: str) -> str | None:
        return key if self.render is True else None if self.render is False else self.render


@dataclass(frozen=True)
class Slot:
    render: bool | str = True
    required: bool = False

    output_name = Attribute.output_name


@dataclass(frozen=True)
class Schema:
    render: str | None = None
    children: tuple[str, ...] | None = None
    attributes: dict[str, Attribute] = field(default_factory=dict)
    slots: dict[str, Slot] = field(default_factory=dict)
    self_closing: bool = False
    inline: bool | None = None
    transform: Callable[[Node, Config], Any] | None = None
    validate: Callable[[Node, Config], list[Problem]] | None = None
    description: str | None = None

    @cached_property
    def rendered(self) -> list[tuple[str, Attribute, str, bool]]:
        """(key, attribute, output name, whether it may have a value without being written), class and id first."""
        named = [(key, a, a.output_name(key)) for key, a in (GLOBAL | self.attributes).items()]
        return [(key, a, name, a.default is not UNDEFINED or isinstance(a.type, AttributeType) and a.type is not CLASS and a.type.transform is not None) for key, a, name in named if name is not None]


def _class_check(value: Any, config: Config, name: str) -> list[Problem]:
    if isinstance(value, bool) or is_number(value):
        return [Problem("attribute-type-invalid", "error", f"Attribute '{name}' must be type 'string | object'")]
    return []


def _class_value(value: Any, config: Config) -> Any:
    if isinstance(value, dict):
        return " ".join(k for k, v in value.items() if js_truthy(v))
    return "" if js_truthy(value) and not isinstance(value, str) else value


def _id_check(value: Any, config: Config, name: str) -> list[Problem]:
    if isinstance(value, str) and value[:1].isascii() and value[:1].isalpha():
        return []
    return [Problem("attribute-value-invalid", "error", "The 'id' attribute must start with a letter")]


def _condition_check(value: Any, config: Config, name: str) -> list[Problem]:
    if isinstance(value, str) or is_number(value):
        return [Problem("attribute-type-invalid", "error", f"Attribute '{name}' must be type 'boolean | object' (null or undefined are also allowed)")]
    return []


def typed(value: Any) -> str:
    """A value as the partial's message names it: every part with its kind."""
    if value is None:
        return "Null"
    if isinstance(value, bool):
        return f"Boolean({'true' if value else 'false'})"
    if is_number(value):
        text = encode(value)
        return f"Number({text}{'' if '.' in text or 'e' in text else '.0'})"
    if isinstance(value, str):
        return f"String({json.dumps(value, ensure_ascii=False)})"
    if isinstance(value, list):
        return f"Array([{', '.join(map(typed, value))}])"
    if isinstance(value, dict):
        return "Hash({" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {typed(v)}" for k, v in value.items()) + "})"
    return str(type_name(value))


def _partial_check(value: Any, config: Config, name: str) -> list[Problem]:
    if isinstance(value, str) and value in config.partials:
        return []
    shown = value if isinstance(value, str) else typed(value)
    return [Problem("attribute-value-invalid", "error", f"Partial `{shown}` not found. The 'file' attribute must be set in `config.partials`")]


CLASS = AttributeType("Class", _class_check, _class_value)
ID = AttributeType("Id", _id_check)
CONDITIONAL = AttributeType("ConditionalAttributeType", _condition_check)
PARTIAL_FILE = AttributeType("PartialFile", _partial_check)

#: Attributes that every node accepts, rendered first.
GLOBAL = {"class": Attribute(CLASS), "id": Attribute(ID)}

# Which children the built-in schemas allow.
_BLOCKS = ("heading", "paragraph", "image", "table", "tag", "fence", "blockquote", "list", "hr")
_DOCUMENT = (*_BLOCKS, "comment")
_CELL = ("inline", *_BLOCKS)
_SPANS = ("strong", "em", "s", "link", "code", "text", "tag")
_INLINE = ("strong", "em", "s", "code", "text", "tag", "link", "image", "hardbreak", "softbreak", "comment")


def _but(names: tuple[str, ...], *without: str) -> tuple[str, ...]:
    return tuple(n for n in names if n not in without)


def _required(kind: str, render: bool | str = True) -> Attribute:
    return Attribute(kind, render, required=True)


def _hidden(kind: Any = None, **more: Any) -> Attribute:
    return Attribute(kind, False, **more)


_SPAN_ATTRIBUTES = {"colspan": Attribute("Number", "colSpan"), "rowspan": Attribute("Number", "rowSpan")}

#: Built-in node schemas; heading, list, fence, code, text and softbreak get their hooks in kernel.transform.
NODES: dict[str, Schema] = {
    "document": Schema("article", _DOCUMENT, {"frontmatter": _hidden()}),
    "heading": Schema(None, ("inline",), {"level": _required("Number", False)}),
    "paragraph": Schema("p", ("inline",)),
    "image": Schema("img", None, {"src": _required("String"), "alt": Attribute("String"), "title": Attribute("String")}),
    "fence": Schema("pre", None, {"content": _required("String", False), "language": Attribute("String", "data-language"), "process": _hidden("Boolean", default=True)}),
    "blockquote": Schema("blockquote", _BLOCKS),
    "item": Schema("li", _CELL),
    "list": Schema(None, ("item",), {"ordered": _required("Boolean", False), "start": Attribute("Number"), "marker": _hidden("String")}),
    "hr": Schema("hr"),
    "table": Schema("table"),
    "td": Schema("td", _CELL, {"align": Attribute("String"), **_SPAN_ATTRIBUTES}),
    "th": Schema("th", None, {"width": Attribute("String"), "align": Attribute("String"), **_SPAN_ATTRIBUTES}),
    "tr": Schema("tr", ("th", "td")),
    "tbody": Schema("tbody", ("tr", "tag")),
    "thead": Schema("thead", ("tr",)),
    "strong": Schema("strong", _but(_SPANS, "strong"), {"marker": _hidden("String")}),
    "em": Schema("em", _but(_SPANS, "em"), {"marker": _hidden("String")}),
    "s": Schema("s", _but(_SPANS, "s")),
    "inline": Schema(None, _INLINE),
    "link": Schema("a", _but(_SPANS, "link"), {"href": _required("String"), "title": Attribute("String")}),
    "code": Schema("code", None, {"content": _required("String", False)}),
    "text": Schema(None, None, {"content": _required("String")}),
    "hardbreak": Schema("br"),
    "softbreak": Schema(),
    "comment": Schema(None, None, {"content": _required("String")}),
    "error": Schema(),
    "node": Schema(),
}

#: Built-in tags; if and partial get their hooks in kernel.transform.
TAGS: dict[str, Schema] = {
    "if": Schema(attributes={"primary": _hidden(CONDITIONAL)}),
    "else": Schema(attributes={"primary": _hidden(CONDITIONAL)}, self_closing=True),
    "partial": Schema(attributes={"file": _hidden(PARTIAL_FILE, required=True), "variables": _hidden("Object")}, self_closing=True, inline=False),
    "slot": Schema(attributes={"primary": _required("String")}),
    "table": Schema(children=("table",), inline=False),
}


@dataclass(frozen=True)
class Config:
    """Vocabulary and scope of a run: own tags and nodes replace built-in ones of the same name."""

    tags: dict[str, Schema] = field(default_factory=lambda: dict(TAGS))
    nodes: dict[str, Schema] = field(default_factory=lambda: dict(NODES))
    variables: dict[str, Any] | None = None
    functions: dict[str, ConfigFunction] = field(default_factory=lambda: dict(BUILTIN))
    partials: dict[str, Node] = field(default_factory=dict)
    validate_functions: bool = False
    parents: tuple[Node, ...] = ()
    source: Callable[[str, str], Schema | None] | None = None  # (kind, name) -> schema, asked first

    @classmethod
    def of(cls, tags: dict[str, Schema] | None = None, nodes: dict[str, Schema] | None = None, functions: dict[str, ConfigFunction] | None = None, **rest: Any) -> Config:
        return cls(TAGS | (tags or {}), NODES | (nodes or {}), functions=BUILTIN | (functions or {}), **rest)

    def schema(self, node: Node) -> Schema | None:
        kind, name = ("tag", node.tag) if node.tag else ("node", node.type)
        if self.source is not None and (found := self.source(kind, name)) is not None:
            return found
        return (self.tags if kind == "tag" else self.nodes).get(name)

    def scoped(self, variables: dict[str, Any]) -> Config:
        made = object.__new__(type(self))  # what replace does, which a partial or a row's variables need too often for its pace
        made.__dict__.update(self.__dict__, variables=variables)
        return made

    def within(self, parents: tuple[Node, ...]) -> Config:
        """The configuration as hooks of a node below these see it."""
        made = object.__new__(type(self))
        made.__dict__.update(self.__dict__, parents=parents)
        return made

    @property
    def is_relational(self) -> bool:
        """Whether validation needs no hook: only data that tables can hold, and built-in attribute types."""
        own = (CLASS, ID, CONDITIONAL, PARTIAL_FILE)

        def plain(kind: Any) -> bool:
            return kind is None or kind in own or isinstance(kind, str) or isinstance(kind, tuple) and all(map(plain, kind))

        for schema in [*self.tags.values(), *self.nodes.values()]:
            if schema.validate is not None:
                return False
            for a in schema.attributes.values():
                if a.validate is not None or not plain(a.type) or not (a.matches is None or isinstance(a.matches, list | tuple)):
                    return False
        return self.source is None and not self.validate_functions

    def tables(self) -> dict[str, list[tuple]]:
        """Rows of the relational plan: schemas, attributes, slots and allowed children by (kind, name)."""
        schemas, attributes, slots, children = [], [], [], []
        for kind, named in (("tag", self.tags), ("node", self.nodes)):
            for name, s in named.items():
                schemas.append((kind, name, s.render, s.inline, s.self_closing, s.children is not None))
                merged = GLOBAL | s.attributes
                for k, (key, a) in enumerate(merged.items()):
                    matches = list(a.matches) if isinstance(a.matches, list | tuple) else None
                    attributes.append((kind, name, key, k, a.output_name(key), a.required, type_text(a.type) if a.type is not None else None, matches, a.error_level or "error"))
                slots += [(kind, name, key, k, x.output_name(key), x.required) for k, (key, x) in enumerate(s.slots.items())]
                children += [(kind, name, c) for c in s.children or ()]
        return {"schemas": schemas, "attributes": attributes, "slots": slots, "children": children}


def type_text(kind: Any) -> str:
    """A type as messages name it; unions joined by |."""
    if isinstance(kind, tuple | list):
        return " | ".join(type_text(k) for k in kind)
    return kind.name if isinstance(kind, AttributeType) else str(kind)


def has_shape(kind: str, value: Any) -> bool:
    return type_name(value) == kind


def is_reference(value: Any) -> bool:
    return isinstance(value, Variable) or type_name(value) == "Function"


assert set(NODES) == set(TYPES) - {"tag"}
