"""HTML of renderable trees."""

from __future__ import annotations

from typing import Any, Protocol

from foliospark.functions.numbers import js_number
from foliospark.kernel.transform import Element
from foliospark.kernel.values import UNDEFINED, is_number, js_string

# Elements without content or closing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def escape_html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def attribute_text(value: Any) -> str:
    if isinstance(value, list):
        return ",".join("" if v is None or v is UNDEFINED else attribute_text(v) for v in value)
    return "[object Object]" if isinstance(value, Element | dict) else js_string(value)


class Renderer(Protocol):
    """A host's own way to write elements and leaves."""

    def open(self, element: Element) -> str: ...
    def close(self, element: Element) -> str: ...
    def text(self, text: str) -> str: ...
    def number(self, number: float) -> str: ...


class HtmlRenderer:
    def open(self, element: Element) -> str:
        return f"<{element.name}" + "".join(f' {k.lower()}="{escape_html(attribute_text(v))}"' for k, v in element.attributes.items()) + ">"

    def close(self, element: Element) -> str:
        return f"</{element.name}>"

    def text(self, text: str) -> str:
        return escape_html(text)

    def number(self, number: float) -> str:
        return js_number(float(number))


HTML = HtmlRenderer()


def render(value: Any, renderer: Renderer = HTML) -> str:
    """Text of a renderable or a list of them; null, booleans and hashes print nothing."""
    out: list[str] = []
    todo: list[Any] = [value]
    write, text, opening, closing = out.append, renderer.text, renderer.open, renderer.close
    while todo:
        item = todo.pop()
        kind = type(item)
        if kind is str:
            write(text(item))
        elif kind is Element:
            if not item.name:
                todo += item.children[::-1]
                continue
            write(opening(item))
            if item.name not in VOID:
                todo.append(_Close(item))
                todo += item.children[::-1]
        elif kind is _Close:
            write(closing(item.element))
        elif isinstance(item, list):
            todo += item[::-1]
        elif is_number(item):
            write(renderer.number(item))
    return "".join(out)


class _Close:
    def __init__(self, element: Element):
        self.element = element
