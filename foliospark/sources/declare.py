"""Vocabularies declared as data: tags, nodes and variables from YAML, JSON or plain Python.

Every refusal names the path of the offending entry.  Declared tags and nodes replace built-in
ones of the same name as a whole.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field
from typing import Any

from foliospark.kernel.schema import PRIMITIVES, Attribute, Config, Schema, Slot
from foliospark.kernel.tree import LEVELS, TYPES

# The keys of each part of a declaration.
TOP_KEYS = ("tags", "nodes", "variables")
SCHEMA_KEYS = ("render", "children", "attributes", "slots", "selfClosing", "inline", "description")
ATTRIBUTE_KEYS = ("type", "default", "required", "matches", "render", "errorLevel", "description")
SLOT_KEYS = ("render", "required")

#: Why some keys cannot stand in a file.
REASONS = {
    "transform": "hooks are Python; give them to Schema(transform=...)",
    "validate": "hooks are Python; give them to Schema(validate=...)",
    "functions": "functions are Python; give them to Config.of(functions=...)",
    "partials": "give a folder of documents to read_config(partials=...)",
}


class DeclarationError(ValueError):
    """A refused declaration; `path` is where, as in config.tags.x.render."""

    def __init__(self, path: str, what: str, reason: str | None = None):
        self.path, self.reason = path, what + (f" -- {reason}" if reason else "")
        super().__init__(f"{path}: {self.reason}")


@dataclass
class Declared:
    tags: dict[str, Schema] = field(default_factory=dict)
    nodes: dict[str, Schema] = field(default_factory=dict)
    variables: dict[str, Any] | None = None

    def config(self, **rest: Any) -> Config:
        """The built-in vocabulary with the declared one over it."""
        return Config.of(self.tags, self.nodes, variables=self.variables, **rest)


def _shape(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "a boolean"
    if isinstance(value, int | float):
        return "a number"
    for kind, name in ((str, "a string"), (list, "an array"), (dict, "an object")):
        if isinstance(value, kind):
            return name
    return f"a {type(value).__name__}"


def _expected(at: str, what: str, got: Any) -> DeclarationError:
    return DeclarationError(at, f"{_shape(got)} stands where {what} belongs")


def _object(value: Any, at: str, keys: tuple[str, ...] | None = None) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise _expected(at, "an object", value)
    for key in value:
        if keys is not None and key not in keys:
            raise DeclarationError(f"{at}.{key}", f"no such key here; there are {', '.join(keys)}", REASONS.get(str(key)))
    return value


def _list(value: Any, at: str) -> list[Any]:
    if not isinstance(value, list):
        raise _expected(at, "an array", value)
    return value


def _text(value: Any, at: str, what: str = "a string") -> str:
    if not isinstance(value, str):
        raise _expected(at, what, value)
    return value


def _flag(value: Any, at: str) -> bool:
    if not isinstance(value, bool):
        raise _expected(at, "a boolean", value)
    return value


def _render(value: Any, at: str) -> bool | str:
    if not isinstance(value, bool | str):
        raise _expected(at, "a boolean or an output name", value)
    return value


def _node_type(name: str, at: str) -> str:
    if name not in TYPES:
        raise DeclarationError(at, f"{json.dumps(name)} names no type of node ({', '.join(TYPES)})")
    return name


def _type_name(name: str, at: str) -> str:
    if name not in PRIMITIVES:
        raise DeclarationError(at, f"{json.dumps(name)} names no type of attribute ({', '.join(PRIMITIVES)}; a list of them is a union)")
    return name


def _type(value: Any, at: str) -> str | tuple[str, ...]:
    if isinstance(value, list):
        return tuple(_type_name(_text(x, f"{at}[{k}]", "a type of the union"), f"{at}[{k}]") for k, x in enumerate(value))
    return _type_name(_text(value, at, "a type or a list of types"), at)


def plain_value(value: Any, at: str) -> Any:
    """A declared value as a document value."""
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return float(value)
    if isinstance(value, list):
        return [plain_value(x, f"{at}[{k}]") for k, x in enumerate(value)]
    if isinstance(value, dict):
        return {_key(k): plain_value(x, f"{at}.{_key(k)}") for k, x in value.items()}
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    raise DeclarationError(at, f"documents cannot hold {_shape(value)}")


def _key(key: Any) -> str:
    return {None: "null", True: "true", False: "false"}[key] if key is None or isinstance(key, bool) else str(key)


def _attribute(value: Any, at: str) -> Attribute:
    given = _object(value, at, ATTRIBUTE_KEYS)
    read: dict[str, Any] = {}
    for key, item in given.items():
        here = f"{at}.{key}"
        if key == "type":
            read["type"] = _type(item, here)
        elif key == "default":
            read["default"] = plain_value(item, here)
        elif key == "required":
            read["required"] = _flag(item, here)
        elif key == "matches":
            if not isinstance(item, list):
                raise DeclarationError(here, f"{_shape(item)} stands where a list of the allowed texts belongs")
            read["matches"] = [_text(x, f"{here}[{k}]") for k, x in enumerate(item)]
        elif key == "render":
            read["render"] = _render(item, here)
        elif key == "errorLevel":
            level = _text(item, here, "a level")
            if level not in LEVELS:
                raise DeclarationError(here, f"{json.dumps(level)} is no level ({', '.join(LEVELS)})")
            read["error_level"] = level
        else:
            read["description"] = _text(item, here)
    return Attribute(**read)


def _slot(value: Any, at: str) -> Slot:
    given = _object(value, at, SLOT_KEYS)
    read: dict[str, Any] = {}
    if "render" in given:
        read["render"] = _render(given["render"], f"{at}.render")
    if "required" in given:
        read["required"] = _flag(given["required"], f"{at}.required")
    return Slot(**read)


def _schema(value: Any, at: str) -> Schema:
    given = _object(value, at, SCHEMA_KEYS)
    read: dict[str, Any] = {}
    for key, item in given.items():
        here = f"{at}.{key}"
        if key == "render":
            policy = _render(item, here)
            if policy is True:
                raise DeclarationError(here, "true names no element; give a name or false")
            read["render"] = policy or None
        elif key == "children":
            read["children"] = tuple(_node_type(_text(x, f"{here}[{k}]", "a node type name"), f"{here}[{k}]") for k, x in enumerate(_list(item, here)))
        elif key == "attributes":
            read["attributes"] = {name: _attribute(a, f"{here}.{name}") for name, a in _object(item, here).items()}
        elif key == "slots":
            read["slots"] = {name: _slot(s, f"{here}.{name}") for name, s in _object(item, here).items()}
        elif key == "selfClosing":
            read["self_closing"] = _flag(item, here)
        elif key == "inline":
            read["inline"] = _flag(item, here)
        else:
            read["description"] = _text(item, here)
    return Schema(**read)


def declare(root: Any) -> Declared:
    """A declaration's schemas and variables, or a DeclarationError."""
    out = Declared()
    if root is None:
        return out
    given = _object(root, "config", TOP_KEYS)
    for name, value in _object(given.get("tags", {}), "config.tags").items():
        out.tags[_key(name)] = _schema(value, f"config.tags.{_key(name)}")
    for name, value in _object(given.get("nodes", {}), "config.nodes").items():
        at = f"config.nodes.{_key(name)}"
        if _node_type(_key(name), at) == "tag":
            raise DeclarationError(at, 'tags go by their own names, under config.tags')
        out.nodes[name] = _schema(value, at)
    if "variables" in given:
        out.variables = {_key(k): plain_value(v, f"config.variables.{_key(k)}") for k, v in _object(given["variables"], "config.variables").items()}
    return out


def load_text(text: str) -> Any:
    """The one document of a YAML or JSON text; nothing in it is null."""
    try:
        import yaml
    except ImportError:  # JSON is what remains without the YAML reader
        return json.loads(text) if text.strip() else None
    try:
        documents = list(yaml.safe_load_all(text))
    except yaml.YAMLError as e:
        raise DeclarationError("config", f"the YAML cannot be read: {e}") from e
    if len(documents) > 1:
        raise DeclarationError("config", f"{len(documents)} YAML documents stand in one configuration")
    return documents[0] if documents else None


def parse_variable(text: str) -> tuple[str, Any]:
    """NAME=VALUE, the value read as a configuration's would be."""
    name, sign, value = text.partition("=")
    if not sign or not name:
        raise DeclarationError("variables", f"{text} is not of the form NAME=VALUE")
    return name, plain_value(load_text(value), f"config.variables.{name}")


def configure(text: str | None = None, variables: list[str] | None = None, **rest: Any) -> Config:
    """A configuration from a declaration's text and NAME=VALUE settings, which override it."""
    declared = declare(load_text(text)) if text is not None else Declared()
    for setting in variables or ():
        name, value = parse_variable(setting)
        declared.variables = {**(declared.variables or {}), name: value}
    return declared.config(**rest)
