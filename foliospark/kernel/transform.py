"""The renderable tree: what schemas make of nodes.

A renderable is None, a bool, a number, a string, a list, a dict or an Element.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from foliospark.functions.links import normalize_link
from foliospark.functions.numbers import js_number
from foliospark.kernel.resolve import has_reference, resolve
from foliospark.kernel.schema import NODES, TAGS, AttributeType, Config, Schema
from foliospark.kernel.tree import Node, deep
from foliospark.kernel.values import UNDEFINED, is_number, truthy

MAX_DEPTH = 512
#: Partials of one document beyond which none expands: two that include themselves twice would make 2 ** MAX_DEPTH.
MAX_PARTIALS = 100_000
PARTIAL_NAME = "$$partial:filename"


@dataclass(slots=True)
class Element:
    """A renderable tag; an unnamed one renders only its children."""

    name: str | None
    attributes: dict[str, Any] = field(default_factory=dict)
    children: list[Any] = field(default_factory=list)


class Many(list):
    """Several renderables in one place (a list that is no array value)."""


_depth = _partials = 0
_UNKNOWN = Schema()


def scalar(value: Any) -> Any:
    """A resolved value as a renderable; undefined if a reference is left anywhere in it."""
    return UNDEFINED if value is UNDEFINED or has_reference(value) else value


def attributes(node: Node, config: Config) -> dict[str, Any]:
    """class, id, then the schema's attributes in its order, then slots; undeclared ones drop out."""
    schema = config.schema(node)
    out: dict[str, Any] = {}
    given = node.attributes
    for key, a, name, unwritten in schema.rendered if schema else _UNKNOWN.rendered:
        if key in given:
            value = resolve(given[key], config)
        elif unwritten:
            value = UNDEFINED
        else:
            continue
        if isinstance(value, str) and (node.type, key) in (("link", "href"), ("image", "src")):
            value = normalize_link(value)
        if isinstance(a.type, AttributeType):
            value = a.type.transform(value, config) if a.type.transform else value
        value = scalar(value)
        if value is UNDEFINED:
            value = scalar(a.default)
        if value is not UNDEFINED:
            out[name] = value
    for key, slot in (schema.slots if schema else {}).items():
        if (name := slot.output_name(key)) is not None and key in node.slots:
            out[name] = transform(node.slots[key], config)
    return out


def children(node: Node, config: Config) -> Many:
    out = Many()
    for child in node.children:
        got = transform(child, config)
        out.extend(got) if isinstance(got, Many) else out.append(got)
    return out


def transform(node: Node, config: Config) -> Any:
    """A node's renderables: one, or Many."""
    global _depth, _partials
    if _depth >= MAX_DEPTH:
        return Many()
    if not _depth:
        deep()
        _partials = 0
    _depth += 1
    try:
        schema = config.schema(node)
        if schema is not None and schema.transform is not None:
            return schema.transform(node, config)
        if schema is None or schema.render is None:
            return children(node, config)
        return Element(schema.render, attributes(node, config), children(node, config))
    finally:
        _depth -= 1


def _content(node: Node, config: Config) -> Many:
    value = scalar(resolve(node.attributes.get("content", UNDEFINED), config))
    return Many() if value is UNDEFINED else Many([value])


def _heading(node: Node, config: Config) -> Element:
    level = node.attributes.get("level")
    return Element("h" + (js_number(level) if is_number(level) else "1"), attributes(node, config), children(node, config))


def _list(node: Node, config: Config) -> Element:
    return Element("ol" if node.attributes.get("ordered") is True else "ul", attributes(node, config), children(node, config))


def _fence(node: Node, config: Config) -> Element:
    return Element("pre", attributes(node, config), children(node, config) if node.children else _content(node, config))


def _code(node: Node, config: Config) -> Element:
    return Element("code", attributes(node, config), _content(node, config))


def _text(node: Node, config: Config) -> Any:
    value = scalar(resolve(node.attributes.get("content", UNDEFINED), config))
    return Many() if value is UNDEFINED else value


def _if(node: Node, config: Config) -> Many:
    """The children of the first branch that holds; an else without condition always does."""
    out, taken = Many(), truthy(resolve(node.attributes.get("primary", UNDEFINED), config))
    done = taken
    for child in node.children:
        if child.type == "tag" and child.tag == "else":
            taken = not done and truthy(resolve(child.attributes["primary"], config) if "primary" in child.attributes else True)
            done = done or taken
        elif taken:
            got = transform(child, config)
            out.extend(got) if isinstance(got, Many) else out.append(got)
    return out


def _partial(node: Node, config: Config) -> Any:
    """Another document's children under its own variables; null for an unknown file.  One that includes itself expands to the depth limit."""
    global _partials
    file = resolve(node.attributes.get("file", UNDEFINED), config)
    if not isinstance(file, str) or file not in config.partials:
        return None
    _partials += 1
    if _partials > MAX_PARTIALS:
        return Many()
    passed = resolve(node.attributes.get("variables", UNDEFINED), config)
    own = {**(config.variables or {}), **(passed if isinstance(passed, dict) else {}), PARTIAL_NAME: file}
    return children(config.partials[file], config.scoped(own))


for _name, _hook in (("heading", _heading), ("list", _list), ("fence", _fence), ("code", _code), ("text", _text), ("softbreak", lambda node, config: " "), ("comment", lambda node, config: Many())):
    NODES[_name] = replace(NODES[_name], transform=_hook)
for _name, _hook in (("if", _if), ("partial", _partial)):
    TAGS[_name] = replace(TAGS[_name], transform=_hook)


def to_plain(value: Any) -> Any:
    """A renderable as JSON data; elements are marked by $$mdtype."""
    from foliospark.kernel import values

    if isinstance(value, Element):
        return {"$$mdtype": "Tag", "name": value.name, "attributes": {k: to_plain(v) for k, v in value.attributes.items()}, "children": [to_plain(c) for c in value.children]}
    if isinstance(value, list):
        return [to_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: to_plain(v) for k, v in value.items()}
    return values.to_plain(value)
