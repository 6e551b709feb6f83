"""Validation of one document in the kernel: every rule, hooks included, in contractual order."""

from __future__ import annotations

import json
from typing import Any

from foliospark.functions.numbers import js_number, plain_number
from foliospark.kernel.resolve import element
from foliospark.kernel.schema import GLOBAL, AttributeType, Config, Pattern, has_shape, is_reference, type_text
from foliospark.kernel.tree import Node, Problem
from foliospark.kernel.values import UNDEFINED, Function, Variable, is_number

INVALID = object()


def shown(value: Any) -> str:
    """A value inside a message."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if is_number(value):
        text = plain_number(float(value))
        return {"inf": "Infinity", "-inf": "-Infinity"}.get(text, text)
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return ",".join("" if v is None else shown(v) for v in value)
    return "[object Object]"


def list_shown(values: list[str], most: int = 8) -> str:
    text = ",".join(json.dumps(v, ensure_ascii=False) for v in values[:most])
    return f"[{text}]" if len(values) <= most else f"[{text}, ... {len(values) - most} more]"


def check_type(kind: Any, value: Any, config: Config, key: str) -> Any:
    """[] if the value fits, problems if a custom type found some, INVALID otherwise."""
    if isinstance(value, Function) and config.validate_functions:
        declared = config.functions.get(value.name)
        if declared is None or declared.returns is None:
            return []
        options = declared.returns if isinstance(declared.returns, tuple | list) else (declared.returns,)
        return [] if any(o == kind for o in options) else INVALID
    if is_reference(value):
        return []
    if isinstance(kind, tuple | list):
        return [] if any(check_type(k, value, config, key) is not INVALID for k in kind) else INVALID
    if isinstance(kind, AttributeType):
        return kind.validate(value, config, key) if kind.validate else INVALID
    return [] if has_shape(kind, value) else INVALID


def check_call(call: Function, config: Config) -> list[Problem]:
    declared = config.functions.get(call.name)
    if declared is None:
        return [Problem("function-undefined", "critical", f"Undefined function: '{call.name}'")]
    out = list(declared.validate(call, config)) if declared.validate else []
    for key, value in call.parameters.items() if declared.parameters is not None else ():
        parameter = declared.parameters.get(key)
        if parameter is None:
            out.append(Problem("parameter-undefined", "error", f"Invalid parameter: '{key}'"))
        elif not isinstance(value, Variable) and parameter.type is not None:
            found = check_type(parameter.type, value, config, key)
            out += [Problem("parameter-type-invalid", "error", f"Parameter '{key}' of '{call.name}' must be type of '{type_text(parameter.type)}'")] if found is INVALID else found
    for key, parameter in (declared.parameters or {}).items():
        if parameter.required and key not in call.parameters:
            out.append(Problem("parameter-missing-required", "error", f"Missing required parameter: '{key}'"))
    return out


def check_variable(variable: Variable, variables: dict[str, Any]) -> list[Problem]:
    current: Any = variables
    for segment in variable.path:
        current = element(current, segment)
        if current is UNDEFINED:
            path = ".".join(p if isinstance(p, str) else js_number(p) for p in variable.path)
            return [Problem("variable-undefined", "error", f"Undefined variable: '{path}'")]
    return []


def check_attribute(declared, key: str, value: Any, config: Config) -> list[Problem]:
    a = declared.get(key)
    if a is None:
        return [Problem("attribute-undefined", "error", f"Invalid attribute: '{key}'")]
    out: list[Problem] = []
    if isinstance(value, Function):
        if not config.validate_functions:
            return []
        out += check_call(value, config)
    elif isinstance(value, Variable):
        if config.variables is None:
            return []
        out += check_variable(value, config.variables)
    level = a.error_level or "error"
    if a.type is not None:
        found = check_type(a.type, value, config, key)
        out += [Problem("attribute-type-invalid", level, f"Attribute '{key}' must be type of '{type_text(a.type)}'")] if found is INVALID else found
    matches = a.matches(config) if callable(a.matches) else a.matches
    if isinstance(matches, Pattern):
        if not matches.test(shown(value)):
            out.append(Problem("attribute-value-invalid", level, f"Attribute '{key}' must match {matches.shown}. Got '{shown(value)}' instead."))
    elif isinstance(matches, list | tuple) and not (isinstance(value, str) and value in matches):
        out.append(Problem("attribute-value-invalid", level, f"Attribute '{key}' must match one of {list_shown(list(matches))}. Got '{shown(value)}' instead."))
    return out + (list(a.validate(value, config, key)) if a.validate else [])


def check_node(node: Node, config: Config) -> list[Problem]:
    """A node's own parse errors, then what its schema says."""
    out = list(node.errors)
    schema = config.schema(node)
    if schema is None:
        what = "tag" if node.tag else "node"
        return [*out, Problem(f"{what}-undefined", "critical", f"Undefined {what}: '{node.name}'")]
    if schema.inline is not None and node.inline != schema.inline:
        out.append(Problem("tag-placement-invalid", "critical", f"'{node.tag or ''}' tag should be {'inline' if schema.inline else 'block'}"))
    if schema.self_closing and node.children:
        out.append(Problem("tag-selfclosing-has-children", "critical", f"'{node.tag or ''}' tag should be self-closing"))
    declared = GLOBAL | schema.attributes if schema.attributes else GLOBAL
    out += [Problem("slot-undefined", "error", f"Invalid slot: '{k}'") for k in node.slots if k not in schema.slots]
    for key, value in node.attributes.items():
        out += check_attribute(declared, key, value, config)
    out += [Problem("attribute-missing-required", "error", f"Missing required attribute: '{k}'") for k, a in declared.items() if a.required and k not in node.attributes]
    out += [Problem("slot-missing-required", "error", f"Missing required slot: '{k}'") for k, s in schema.slots.items() if s.required and k not in node.slots]
    if schema.children is not None:
        out += [Problem("child-invalid", "warning", f"Can't nest '{c.type}' in '{node.name}'") for c in node.children if c.type != "error" and c.type not in schema.children]
    return out + (list(schema.validate(node, config)) if schema.validate else [])


def validate(document: Node, config: Config) -> list[tuple[Node, Problem]]:
    """All problems of a tree in walk order, slots before children; hooks see their ancestors in config.parents."""
    out, todo = [], [(document, ())]
    hooked = any(s.validate for s in [*config.tags.values(), *config.nodes.values()]) or config.source is not None
    while todo:
        node, parents = todo.pop()
        own = config.within(parents) if hooked else config
        out += [(node, p) for p in check_node(node, own)]
        path = (*parents, node) if hooked else ()
        todo += [(c, path) for c in reversed([*node.slots.values(), *node.children])]
    return out
