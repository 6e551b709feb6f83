"""Validation as a relational plan over the node table.

The schemas are laid out as one row each (by kind and name) and joined by a broadcast hash join:
a configuration is a driver-side object, and SCHEMA_LIMIT checks its size before it is broadcast.
Every rule is an expression over a node's own row (its attributes, slot names and child types are
arrays there), so the whole validation is one narrow stage: no shuffle, no Python, no union of
rules.  Errors come out in contractual order: a node's parse errors, then the rules top-down, and
attribute rules interleaved in authored order; (id, node_id, pos) sorts them across partitions.

Configurations with hooks, patterns, own attribute types, opaque sources or function validation
(`Config.is_relational` is false) need the kernel: `operators.kernels.Kernels.problems`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.numbers import js_number
from foliospark.kernel.check import list_shown
from foliospark.kernel.schema import GLOBAL, AttributeType, Config, type_text
from foliospark.operators.nodes import ERROR, NUMBER

#: Schemas and attributes up to which the schema table is broadcast.
SCHEMA_LIMIT = 100_000

#: What `validate_nodes` reads of the node table.
READ = ("node_id", "type", "tag", "inline", "lines", "attrs", "child_types", "slot_names", "loc", "errors")

_ATTRIBUTE = T.StructType(
    [
        T.StructField("types", T.ArrayType(T.StringType())),  # primitive names that fit; null: unchecked
        T.StructField("custom", T.StringType()),  # a built-in attribute type with rules of its own
        T.StructField("type_text", T.StringType()),
        T.StructField("matches", T.ArrayType(T.StringType())),  # as JSON text
        T.StructField("matches_text", T.StringType()),
        T.StructField("level", T.StringType()),
    ]
)
_SCHEMA = T.StructType(
    [
        T.StructField("s_kind", T.StringType()),
        T.StructField("s_name", T.StringType()),
        T.StructField("s_inline", T.BooleanType()),
        T.StructField("s_closing", T.BooleanType()),
        T.StructField("s_slots", T.ArrayType(T.StringType())),
        T.StructField("s_needs_slots", T.ArrayType(T.StringType())),
        T.StructField("s_needs", T.ArrayType(T.StringType())),
        T.StructField("s_children", T.ArrayType(T.StringType())),
        T.StructField("s_attrs", T.MapType(T.StringType(), _ATTRIBUTE)),
    ]
)


def _attribute(a) -> tuple:
    kinds = a.type if isinstance(a.type, tuple | list) else None if a.type is None else (a.type,)
    own = [k for k in kinds or () if isinstance(k, AttributeType)]
    custom = own[0].name if own and len(kinds) == 1 else None
    types = None if own or kinds is None else list(kinds)  # a union with an own type accepts anything
    matches = list(a.matches) if isinstance(a.matches, list | tuple) else None
    quoted = None if matches is None else [json.dumps(m, ensure_ascii=False) for m in matches]
    return types, custom, None if a.type is None else type_text(a.type), quoted, None if matches is None else list_shown(matches), a.error_level or "error"


def schema_table(spark: SparkSession, config: Config) -> DataFrame:
    """One row a schema."""
    rows, size = [], 0
    for kind, named in (("tag", config.tags), ("node", config.nodes)):
        for name, s in named.items():
            declared = GLOBAL | s.attributes
            size += 1 + len(declared)
            rows.append(
                (
                    kind,
                    name,
                    s.inline,
                    s.self_closing,
                    list(s.slots),
                    [k for k, x in s.slots.items() if x.required],
                    [k for k, a in declared.items() if a.required],
                    None if s.children is None else list(s.children),
                    {k: _attribute(a) for k, a in declared.items()},
                )
            )
    if size > SCHEMA_LIMIT:
        raise ValueError(f"{size} schemas and attributes; at most {SCHEMA_LIMIT} are broadcast")
    return spark.createDataFrame(rows, _SCHEMA)


def variable_paths(variables: dict[str, Any]) -> list[str]:
    """Every path that exists in the variables, steps as text joined by NUL."""

    def walk(value: Any, at: tuple[str, ...]) -> Iterator[str]:
        if at:
            yield "\0".join(at)
        below = value.items() if isinstance(value, dict) else ((js_number(float(k)), v) for k, v in enumerate(value)) if isinstance(value, list) else ()
        for key, v in below:
            yield from walk(v, (*at, key))

    return list(walk(variables, ()))


def value_type(value: Column) -> Column:
    """String, Number, Boolean, Object, Array, Function or Variable of JSON text; null for null."""
    first = F.substring(value, 1, 1)
    return (
        F.when(first == '"', "String")
        .when(value.startswith('{"$$mdtype":"Variable"'), "Variable")
        .when(value.startswith('{"$$mdtype":"Function"'), "Function")
        .when(first == "{", "Object")
        .when(first == "[", "Array")
        .when(value.isin("true", "false"), "Boolean")
        .when(value != "null", "Number")
    )


def text_of(value: Column) -> Column:
    """The string that JSON text of a string stands for."""
    return F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]


def shown(attr: Column) -> Column:
    """An attribute's value as messages print it."""
    kind = value_type(attr["value"])
    return F.coalesce(attr["shown"], F.when(kind == "String", text_of(attr["value"])).when(kind.isin("Object", "Function", "Variable"), F.lit("[object Object]")).otherwise(attr["value"]))


def _error(id: Column | str, level: Column | str, message: Column) -> Column:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(column(id).alias("id"), column(level).alias("level"), message.alias("message"), F.lit(None).cast(ERROR["loc"].dataType).alias("loc"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _custom(name: Column, value: Column, parts: Column, custom: Column, partials: list[str]) -> Column:
    """The error of a built-in attribute type, or null."""
    kind = value_type(value)
    text = text_of(value)
    own = F.when((custom == "Class") & kind.isin("Boolean", "Number"), _error("attribute-type-invalid", "error", _text("Attribute '", name, "' must be type 'string | object'")))
    own = own.when((custom == "Id") & ~F.coalesce((kind == "String") & text.rlike("^[A-Za-z]"), F.lit(False)), _error("attribute-value-invalid", "error", F.lit("The 'id' attribute must start with a letter")))
    own = own.when(
        (custom == "ConditionalAttributeType") & kind.isin("String", "Number"),
        _error("attribute-type-invalid", "error", _text("Attribute '", name, "' must be type 'boolean | object' (null or undefined are also allowed)")),
    )
    known = F.array(*[F.lit(p) for p in partials]).cast("array<string>")
    number = F.concat(F.lit("Number("), value, F.when(value.rlike("[.e]"), ")").otherwise(".0)"))
    typed = F.when(value == "null", "Null").when(kind == "Boolean", F.concat(F.lit("Boolean("), value, F.lit(")"))).when(kind == "Number", number).otherwise(F.coalesce(parts, kind))
    lost = ~F.coalesce((kind == "String") & F.array_contains(known, text), F.lit(False))
    return own.when(
        (custom == "PartialFile") & lost,
        _error("attribute-value-invalid", "error", _text("Partial `", F.when(kind == "String", text).otherwise(typed), "` not found. The 'file' attribute must be set in `config.partials`")),
    )


def _attribute_errors(config: Config) -> Column:
    """Rules 5 to 8 over all attributes of a node, in authored order."""
    paths = None if config.variables is None else F.array(*[F.lit(p) for p in variable_paths(config.variables)]).cast("array<string>")

    def one(attr: Column) -> Column:
        name, value = attr["name"], attr["value"]
        declared = F.element_at(F.col("s_attrs"), name)
        kind = value_type(value)
        free = F.coalesce(kind.isin("Function", "Variable"), F.lit(False))
        wrong = declared["types"].isNotNull() & ~free & ~F.coalesce(F.array_contains(declared["types"], kind), F.lit(False))
        type_error = F.when(wrong, _error("attribute-type-invalid", declared["level"], _text("Attribute '", name, "' must be type of '", declared["type_text"], "'")))
        own = F.when(~free & declared["custom"].isNotNull(), _custom(name, value, attr["typed"], declared["custom"], list(config.partials)))
        bad = declared["matches"].isNotNull() & ~F.coalesce(F.array_contains(declared["matches"], value), F.lit(False))
        match_error = F.when(bad, _error("attribute-value-invalid", declared["level"], _text("Attribute '", name, "' must match one of ", declared["matches_text"], ". Got '", shown(attr), "' instead.")))
        lost = F.lit(None).cast(ERROR)
        if paths is not None:
            steps = F.from_json(value, "path array<string>")["path"]
            lost = F.when((kind == "Variable") & ~F.array_contains(paths, F.array_join(steps, "\0")), _error("variable-undefined", "error", _text("Undefined variable: '", F.array_join(steps, "."), "'")))
        # Without function validation a call is taken as it is; so is a variable where none are configured.
        skipped = kind == "Function" if paths is not None else free
        rules = F.when(F.coalesce(skipped, F.lit(False)), F.array().cast(T.ArrayType(ERROR))).otherwise(F.array_compact(F.array(lost, type_error, own, match_error)))
        return F.when(declared.isNull(), F.array(_error("attribute-undefined", "error", _text("Invalid attribute: '", name, "'")))).otherwise(rules)

    return F.flatten(F.transform("attrs", one))


def _named(names: Column, id: str, level: str, before: str, after: str = "'") -> Column:
    return F.transform(names, lambda n: _error(id, level, _text(before, n, after)))


def node_errors(config: Config) -> Column:
    """All errors of a node's row joined with its schema, in order."""
    name = F.coalesce("tag", "type")
    what = F.when(F.col("tag").isNotNull(), "tag").otherwise("node")
    tag = F.coalesce("tag", F.lit(""))
    undefined = F.array(_error(F.concat(what, F.lit("-undefined")), "critical", _text("Undefined ", what, ": '", name, "'")))
    single = lambda when, error: F.when(when, F.array(error)).otherwise(F.array().cast(T.ArrayType(ERROR)))
    rules = F.concat(
        single(F.col("s_inline").isNotNull() & (F.col("s_inline") != F.col("inline")), _error("tag-placement-invalid", "critical", _text("'", tag, "' tag should be ", F.when(F.col("s_inline"), "inline").otherwise("block")))),
        single(F.col("s_closing") & (F.size("child_types") > 0), _error("tag-selfclosing-has-children", "critical", _text("'", tag, "' tag should be self-closing"))),
        _named(F.filter("slot_names", lambda s: ~F.array_contains("s_slots", s)), "slot-undefined", "error", "Invalid slot: '"),
        _attribute_errors(config),
        _named(F.filter("s_needs", lambda k: ~F.exists("attrs", lambda a: a["name"] == k)), "attribute-missing-required", "error", "Missing required attribute: '"),
        _named(F.filter("s_needs_slots", lambda k: ~F.array_contains("slot_names", k)), "slot-missing-required", "error", "Missing required slot: '"),
        F.transform(
            F.filter("child_types", lambda c: F.col("s_children").isNotNull() & (c != "error") & ~F.array_contains("s_children", c)),
            lambda c: _error("child-invalid", "warning", _text("Can't nest '", c, "' in '", name, "'")),
        ),
    )
    return F.concat("errors", F.when(F.col("s_name").isNull(), undefined).otherwise(rules))


def validate_nodes(nodes: DataFrame, config: Config | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, _document, node_id, pos, type, name, lines, loc, id, level, message) of every problem of the node table."""
    config = config or Config()
    if not config.is_relational:
        raise ValueError("this configuration has hooks: validate with the kernel")
    schemas = F.broadcast(schema_table(nodes.sparkSession, config))  # at most SCHEMA_LIMIT entries
    kind, name = F.when(F.col("tag").isNotNull(), "tag").otherwise("node"), F.coalesce("tag", "type")
    met = nodes.withColumn("__kind", kind).withColumn("__name", name).join(schemas, (F.col("__kind") == F.col("s_kind")) & (F.col("__name") == F.col("s_name")), "left")
    found = met.select(id_col, NUMBER, "node_id", "type", F.col("__name").alias("name"), "lines", "loc", F.posexplode(node_errors(config)).alias("pos", "e"))
    own = F.col("e.loc")
    lines = F.when(own.isNotNull(), F.array(F.col("e.loc.start.line"), F.col("e.loc.end.line"))).otherwise(F.col("lines"))
    return found.select(id_col, NUMBER, "node_id", "pos", "type", "name", lines.alias("lines"), F.coalesce(own, F.col("loc")).alias("loc"), F.col("e.id").alias("error_id"), F.col("e.level").alias("level"), F.col("e.message").alias("message"))
