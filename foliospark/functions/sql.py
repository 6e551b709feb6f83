"""The engine's functions under SQL names.

`register(spark)` makes md_html, md_format, md_ast, md_renderable, md_parse_tag, md_value,
md_resolve, md_debug, md_tag_end, md_link, md_number and the table functions md_nodes and
md_segments available to `spark.sql`; native helpers (md_escape, md_truthy) are SQL functions
whose bodies Catalyst inlines.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from foliospark.functions.document import Function
from foliospark.kernel.blocks import Block, Blocks
from foliospark.kernel.build import ParseOptions, parse
from foliospark.kernel.format import FormatOptions, settle
from foliospark.kernel.render import render
from foliospark.kernel.resolve import resolve
from foliospark.kernel.schema import Config
from foliospark.kernel.tokenizer import masked
from foliospark.kernel.transform import to_plain
from foliospark.kernel.values import UNDEFINED, decode, encode
from foliospark.operators import values
from foliospark.operators.kernels import Shared, ast_plain, dump, renderables, scope
from foliospark.operators.nodes import deep, flatten
from foliospark.operators.vocabularies import DeclarationRows

SEGMENT = "kind string, start int, stop int, line int, body string, masked string"
NODE = "node_id int, parent_id int, depth int, last_desc int, slot string, type string, tag string, inline boolean, attrs string, line int"

# Bodies of the SQL functions that Catalyst inlines.
_NATIVE = {
    "md_escape(t STRING) RETURNS STRING": "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
    "md_truthy(v STRING) RETURNS BOOLEAN": "v IS NOT NULL AND v NOT IN ('null', 'false')",
}


def segments(source: str, comments: bool = False) -> Iterator[tuple]:
    """(kind, start, stop, line, body, masked) of each block and each block tag, containers before what is in them; text with inline rules has its tags masked."""
    todo: list[Block] = list(reversed(Blocks(source, comments).parse().children))
    while todo:
        block = todo.pop()
        kind = "tag" if block.kind == "tagline" else block.kind
        stop = max(block.start, block.end)
        yield kind, block.start, stop, block.line, block.data.get("body"), masked(source[block.start : stop])[0] if kind in ("paragraph", "heading", "table") else None
        todo += reversed(block.children)


def comment_ranges(source: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of each comment block that spans lines, from its `<!--` to behind its `-->`, in order: sorted and disjoint, none inside code, a table or a tag."""
    for kind, start, stop, *_ in segments(source, True):
        if kind == "comment" and "\n" in source[start:stop]:
            yield start, stop


class _Segments:
    comments = False

    def eval(self, source: str):
        if source is not None:
            yield from segments(source, self.comments)


class _CommentSegments(_Segments):
    comments = True


class _Comments:
    def eval(self, source: str):
        if source is not None:
            yield from comment_ranges(source)


class _Nodes:
    def eval(self, source: str):
        if source is None:
            return
        deep()
        for row in flatten(parse(source), source, with_location=False):
            attrs = {a["name"]: to_plain(v) for a in row["attrs"] if (v := decode(a["value"])) is not UNDEFINED}
            yield row["node_id"], row["parent_id"], row["depth"], row["last_desc"], row["slot"], row["type"], row["tag"], row["inline"], dump(attrs), row["lines"][0] if row["lines"] else None


def _texts(kind: T.DataType, fn):
    @F.pandas_udf(kind)
    def run(source: pd.Series) -> pd.Series:
        deep()
        return pd.Series([None if s is None else fn(s) for s in source], dtype=object)

    return run


def register(spark: SparkSession, config: Config | None = None, options: ParseOptions | None = None, formatting: FormatOptions | None = None) -> None:
    """Register all functions for one configuration; a second call replaces the first's."""
    options, formatting = options or ParseOptions(), formatting or FormatOptions()
    shared = Shared(spark, config or Config())

    @F.pandas_udf(T.StringType())
    def html(source: pd.Series, variables: pd.Series) -> pd.Series:
        deep()
        return pd.Series([None if s is None else render(renderables(s, scope(shared.get(), v), options)) for s, v in zip(source, variables, strict=True)], dtype=object)

    @F.pandas_udf(T.StringType())
    def resolved(value: pd.Series, variables: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else encode(resolve(decode(t), scope(shared.get(), v))) for t, v in zip(value, variables, strict=True)], dtype=object)

    named = {
        "md_html": html,
        "md_resolve": resolved,
        "md_format": _texts(T.StringType(), lambda s: settle(s, formatting)[0]),
        "md_ast": _texts(T.StringType(), lambda s: dump(ast_plain(parse(s, options), s, options.file, options.location))),
        "md_renderable": _texts(T.StringType(), lambda s: dump([to_plain(x) for x in renderables(s, shared.get(), options)])),
        "md_parse_tag": values.parse_tag_column,
        "md_value": values.parse_value_column,
        "md_debug": values.debug_column,
        "md_tag_end": values.tag_end_column,
        "md_link": values.normalize_link_udf,
        "md_number": values.js_number_udf,
    }
    for name, function in named.items():
        spark.udf.register(name, function)
    tables = (("md_segments", _Segments, SEGMENT), ("md_segments_with_comments", _CommentSegments, SEGMENT), ("md_comments", _Comments, "start int, stop int"), ("md_declaration", DeclarationRows, "path string, reason string, tags array<string>, nodes array<string>"), ("md_nodes", _Nodes, NODE))
    for name, handler, kind in tables:
        spark.udtf.register(name, UserDefinedTableFunction(handler, returnType=kind))
    for signature, body in _NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_function(spark: SparkSession, name: str, function: Function, config: Config | None = None) -> None:
    """A document function as the SQL function `name`(arguments JSON object) -> JSON."""
    shared = Shared(spark, (function, config or Config()))

    @F.pandas_udf(T.StringType())
    def run(arguments: pd.Series) -> pd.Series:
        own, config = shared.get()
        out: list[Any] = []
        for text in arguments:
            given = decode(text)
            out.append(encode(own.transform(given if isinstance(given, dict) else {}, config)) if own.transform and given is not UNDEFINED else None)
        return pd.Series(out, dtype=object)

    spark.udf.register(name, run)
