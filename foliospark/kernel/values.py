"""Document values: null, booleans, numbers, strings, arrays, ordered hashes, variables and functions.

In Python these are None, bool, float, str, list, dict, Variable and Function; UNDEFINED stands
for an absent value, which is not null.  In tables a value is ordered JSON text: SQL NULL is
undefined, the text `null` is null, and objects with `$$mdtype` are variables and functions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from foliospark.functions.numbers import js_number


class _Undefined:
    def __repr__(self) -> str:
        return "UNDEFINED"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "UNDEFINED"


UNDEFINED: Any = _Undefined()


@dataclass(eq=True)
class Variable:
    path: list[str | float]


@dataclass(eq=True)
class Function:
    name: str
    parameters: dict[str, Any] = field(default_factory=dict)


def truthy(value: Any) -> bool:
    """The document language's truth: only undefined, null and false are not."""
    return value is not UNDEFINED and value is not None and value is not False


def js_truthy(value: Any) -> bool:
    """The host language's truth: empty text, zero and not-a-number are false as well; empty collections are true."""
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return value != 0 and not math.isnan(value)
    return value is not UNDEFINED and value is not None and value != ""


def is_number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def type_name(value: Any) -> str | None:
    """String, Number, Boolean, Object, Array, Function or Variable; None for null and undefined."""
    if isinstance(value, bool):
        return "Boolean"
    if is_number(value):
        return "Number"
    for kind, name in ((str, "String"), (list, "Array"), (dict, "Object"), (Function, "Function"), (Variable, "Variable")):
        if isinstance(value, kind):
            return name
    return None


def to_plain(value: Any) -> Any:
    """The value as plain JSON data, variables and functions marked by $$mdtype; undefined inside arrays becomes null."""
    if isinstance(value, Variable):
        return {"$$mdtype": "Variable", "path": [to_plain(p) for p in value.path]}
    if isinstance(value, Function):
        return {"$$mdtype": "Function", "name": value.name, "parameters": to_plain(value.parameters)}
    if isinstance(value, dict):
        return {k: to_plain(v) for k, v in value.items() if v is not UNDEFINED}
    if isinstance(value, list):
        return [to_plain(v) for v in value]
    if value is UNDEFINED:
        return None
    if is_number(value) and math.isfinite(value) and value == int(value) and abs(value) < 2**53:
        return int(value)
    return value


def from_plain(data: Any) -> Any:
    if isinstance(data, dict):
        kind = data.get("$$mdtype")
        if kind == "Variable":
            return Variable([float(p) if is_number(p) else p for p in data["path"]])
        if kind == "Function":
            return Function(data["name"], {k: from_plain(v) for k, v in data["parameters"].items()})
        return {k: from_plain(v) for k, v in data.items()}
    if isinstance(data, list):
        return [from_plain(v) for v in data]
    return float(data) if is_number(data) else data


def encode(value: Any) -> str | None:
    """Ordered JSON text; None for undefined."""
    return None if value is UNDEFINED else json.dumps(to_plain(value), ensure_ascii=False, separators=(",", ":"))


def decode(text: str | None) -> Any:
    return UNDEFINED if text is None else from_plain(json.loads(text))


def js_string(value: Any) -> str:
    """The host language's String(): arrays joined by commas, objects opaque, null spelled out."""
    if value is None:
        return "null"
    if value is UNDEFINED:
        return "undefined"
    if isinstance(value, bool):
        return "true" if value else "false"
    if is_number(value):
        return js_number(float(value))
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return ",".join("" if v is None or v is UNDEFINED else js_string(v) for v in value)
    return "[object Object]"


def deep_equal(a: Any, b: Any) -> bool:
    """Equality by value: undefined is not null, booleans are not numbers, the order of hash keys does not count."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if is_number(a) and is_number(b):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, Variable) and isinstance(b, Variable):
        return a.path == b.path
    if isinstance(a, Function) and isinstance(b, Function):
        return a.name == b.name and deep_equal(a.parameters, b.parameters)
    return type(a) is type(b) and a == b
