"""The functions of the document language: and, or, not, equals, default, debug."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from foliospark.functions.numbers import plain_number
from foliospark.kernel.values import UNDEFINED, deep_equal, is_number, truthy


@dataclass(frozen=True)
class Function:
    """transform(parameters, config) -> value; `returns` and `parameters` (name -> schema attribute) serve validation."""

    transform: Callable[[dict[str, Any], Any], Any] | None = None
    returns: Any = None
    parameters: dict[str, Any] | None = None
    validate: Callable[[Any, Any], list] | None = None


def debug_text(value: Any, indent: int = 0) -> str:
    """JSON with two spaces a level; references and numbers that are not finite show as null."""
    pad, inner = "  " * indent, "  " * (indent + 1)
    if isinstance(value, bool):
        return "true" if value else "false"
    if is_number(value):
        text = plain_number(float(value))
        return "null" if text in ("NaN", "inf", "-inf") else text
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + debug_text(v, indent + 1) for v in value) + f"\n{pad}]" if value else "[]"
    if isinstance(value, dict):
        rows = (f"{inner}{json.dumps(k, ensure_ascii=False)}: {debug_text(v, indent + 1)}" for k, v in value.items())
        return "{\n" + ",\n".join(rows) + f"\n{pad}}}" if value else "{}"
    return "null"


def _equals(p: dict[str, Any], _) -> bool:
    values = list(p.values())
    return all(v is UNDEFINED if values[0] is UNDEFINED else v is not UNDEFINED and deep_equal(v, values[0]) for v in values[1:])


def _default(p: dict[str, Any], _) -> Any:
    first = p.get("0", UNDEFINED)
    return p.get("1", UNDEFINED) if first is UNDEFINED else first


def _debug(p: dict[str, Any], _) -> Any:
    value = p.get("0", UNDEFINED)
    return UNDEFINED if value is UNDEFINED else debug_text(value)


BUILTIN: dict[str, Function] = {
    "and": Function(lambda p, _: all(map(truthy, p.values()))),
    "or": Function(lambda p, _: any(map(truthy, p.values()))),
    "not": Function(lambda p, _: not truthy(p.get("0", UNDEFINED))),
    "equals": Function(_equals),
    "default": Function(_default),
    "debug": Function(_debug),
}
