"""Variables and function calls evaluated against a configuration."""

from __future__ import annotations

from typing import Any

from foliospark.functions.numbers import js_number
from foliospark.kernel.values import UNDEFINED, Function, Variable

MAX_DEPTH = 64


def element(value: Any, segment: str | float) -> Any:
    """One step of a path: a hash by key, an array by a whole number (or its digits)."""
    if isinstance(value, dict):
        return value.get(segment if isinstance(segment, str) else js_number(segment), UNDEFINED)
    if isinstance(value, list):
        if isinstance(segment, str):
            segment = float(segment) if segment.isascii() and segment.isdigit() else -1.0
        if segment >= 0 and segment == int(segment) and segment < len(value):
            return value[int(segment)]
    return UNDEFINED


def resolve(value: Any, config, depth: int = 0) -> Any:
    """The value without references: undefined array elements become null, undefined hash entries go."""
    if depth > MAX_DEPTH:
        return UNDEFINED
    if value is None or isinstance(value, str | float):
        return value
    if isinstance(value, list):
        return [None if (v := resolve(x, config, depth + 1)) is UNDEFINED else v for x in value]
    if isinstance(value, dict):
        got = {k: resolve(x, config, depth + 1) for k, x in value.items()}
        return {k: v for k, v in got.items() if v is not UNDEFINED}
    if isinstance(value, Variable):
        current: Any = config.variables if config.variables is not None else UNDEFINED
        for segment in value.path:
            current = element(current, segment)
        return UNDEFINED if current is UNDEFINED else resolve(current, config, max(depth, 1))
    if isinstance(value, Function):
        declared = config.functions.get(value.name)
        if declared is None or declared.transform is None:
            return UNDEFINED
        return declared.transform({k: resolve(x, config, depth + 1) for k, x in value.parameters.items()}, config)
    return value


def has_reference(value: Any) -> bool:
    if isinstance(value, list):
        return any(map(has_reference, value))
    if isinstance(value, dict):
        return any(map(has_reference, value.values()))
    return isinstance(value, Variable | Function)
