"""Whole-document operators as vectorised columns: render, transform, validate, format.

Each is a function over Arrow batches of sources (pandas where it gives texts, else Arrow alone), which gives its results by PIECE_ROWS rows,
so a worker holds the results of a piece and not of a batch.  Sources that equal one of the last
ones, as those that are filled from a row's variables, are parsed once, unless own hooks see the tree.  The configuration is a driver-side
object (declared vocabulary, partials, hooks); it is broadcast once and must fit a driver, which
CONFIG_LIMIT checks.  Per-row variables are an optional JSON column merged over the configured
ones.  Null sources give null.
"""

from __future__ import annotations

import functools
import json
import pickle
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.functions.columns import is_plain, plain_html
from foliospark.kernel.build import ParseOptions, parse
from foliospark.kernel.check import validate
from foliospark.kernel.format import FormatOptions, settle
from foliospark.kernel.render import HTML, Renderer, render
from foliospark.kernel.schema import NODES, Config
from foliospark.kernel.tokenizer import MARKDOWN
from foliospark.kernel.transform import Many, to_plain, transform
from foliospark.kernel.tree import Node, Positions
from foliospark.kernel.values import from_plain
from foliospark.operators.nodes import ERROR, LOCATION, deep, location, problem_row

#: Bytes of a pickled configuration up to which it is broadcast.
CONFIG_LIMIT = 256 << 20

#: Rows whose results are sent on together, and the characters of their sources that end a piece sooner.
PIECE_ROWS, PIECE_CHARS = 512, 1 << 20

#: Length up to which a source may be kept parsed for rows that have the same.
KEPT_CHARS = 2_000

DIAGNOSTIC = T.StructType([T.StructField("type", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("loc", LOCATION), T.StructField("error", ERROR)])

FORMATTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("settled", T.BooleanType())])


class Shared:
    """A broadcast object, unpickled once a worker."""

    def __init__(self, spark: SparkSession, value: Any):
        data = cloudpickle.dumps(value)
        if len(data) > CONFIG_LIMIT:
            raise ValueError(f"the configuration takes {len(data)} bytes; at most {CONFIG_LIMIT} are broadcast")
        self.data = spark.sparkContext.broadcast(data)
        self.value: Any = None

    def __getstate__(self):
        return {"data": self.data, "value": None}

    def get(self) -> Any:
        if self.value is None:
            self.value = pickle.loads(self.data.value)
        return self.value


def scope(config: Config, variables: str | None) -> Config:
    """The configuration with a row's variables (a JSON object) over its own."""
    return config if variables is None else config.scoped({**(config.variables or {}), **from_plain(json.loads(variables))})


def pieces(*columns: pd.Series | list) -> Iterator[list[tuple]]:
    """The rows of a batch by pieces, which end by rows or by the characters of the first column."""
    held, size = [], 0
    for row in zip(*columns, strict=True):
        held.append(row)
        size += len(row[0] or "")
        if len(held) >= PIECE_ROWS or size >= PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def has_own_hooks(config: Config) -> bool:
    """Whether code of the host may see, and change, the nodes of a tree that is rendered."""
    hooks = [s.transform for s in [*config.tags.values(), *config.nodes.values()] if s.transform is not None]
    return config.source is not None or any(getattr(h, "__module__", None) != transform.__module__ for h in hooks)


@functools.lru_cache(maxsize=256)
def kept_tree(source: str, options: ParseOptions) -> Node:
    return parse(source, options)


def renderables(source: str, config: Config, options: ParseOptions, keep: bool = False) -> list:
    """What a document renders to; `keep` says that its tree may be one that was made for an equal source."""
    tree = kept_tree(source, options) if keep and len(source) <= KEPT_CHARS else parse(source, options)
    got = transform(tree, config)
    return got if isinstance(got, Many) else Many([got])


def diagnostics(source: str, config: Config, options: ParseOptions, file: str | None = None) -> list[dict]:
    """Rows of all problems in order; an error's own place wins over its node's."""
    found = validate(parse(source, options), config)
    if not found:
        return []
    positions = Positions(source)
    out = []
    for node, p in found:
        lines = [positions.line(p.span[0]), positions.line(p.span[1])] if p.span else node.lines
        out.append({"type": node.type, "lines": lines, "loc": location(positions, p.span or node.span, file) if options.location else None, "error": problem_row(p, positions, file)})
    return out


@functools.lru_cache(maxsize=4096)
def parsed_partial(name: str, text: str, options: ParseOptions) -> Node:
    return parse(text, replace(options, file=name))


class Kernels:
    """The vectorised functions of one configuration."""

    def __init__(self, spark: SparkSession, config: Config | None = None, options: ParseOptions | None = None, renderer: Renderer = HTML, formatting: FormatOptions | None = None):
        self.options = options or ParseOptions()
        built_in = all(config is None or config.nodes.get(n) is NODES[n] for n in ("document", "paragraph", "inline", "text", "softbreak"))
        self.prose_is_native = built_in and renderer is HTML and self.options.tokenizer is MARKDOWN and (config is None or config.source is None)
        self.keeps = not has_own_hooks(config or Config())
        self.shared = Shared(spark, (config or Config(), renderer))
        self.formatting = formatting or FormatOptions(allow_comments=self.options.allow_comments)

    def _map(self, kind: T.DataType, fn, *columns: Column) -> Column:
        """fn(source, variables, label, config, renderer) over rows with a source."""
        shared = self.shared

        @F.pandas_udf(kind)
        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            deep()
            config, renderer = shared.get()
            for batch in batches:
                for piece in pieces(*batch):
                    yield pd.Series([None if s is None else fn(s, scope(config, v), f, renderer) for s, v, f in piece], dtype=object)

        return run(*columns)

    def _call(self, kind: T.DataType, fn, source: Column, variables: Column | None, label: Column | None) -> Column:
        text = F.lit(None).cast("string")
        return self._map(kind, fn, source, text if variables is None else variables, text if label is None else label)

    def html(self, source: Column, variables: Column | None = None) -> Column:
        """HTML; where the vocabulary leaves plain prose alone, such documents never leave the JVM."""
        options, keep = replace(self.options, bare=True), self.keeps and variables is not None
        parsed = lambda text: self._call(T.StringType(), lambda s, c, _, r: render(renderables(s, c, options, keep), r), text, variables, None)
        if not self.prose_is_native:
            return parsed(source)
        return F.when(is_plain(source), plain_html(source)).otherwise(parsed(F.when(~is_plain(source), source)))

    def html_with(self, source: Column, partials: Column, variables: Column | None = None) -> Column:
        """HTML with each row's own partials, a map from name to text, beside those of the configuration; a worker parses each text once."""
        options = replace(self.options, bare=True)

        def one(text, config, own, renderer):
            given = {} if own is None else {k: parsed_partial(k, t, options) for k, t in json.loads(own).items()}
            return render(renderables(text, replace(config, partials={**config.partials, **given}), options), renderer)

        return self._call(T.StringType(), one, source, variables, F.to_json(partials))

    def renderable_json(self, source: Column, variables: Column | None = None) -> Column:
        """An array a document, elements as {"$$mdtype":"Tag",...}."""
        options = replace(self.options, bare=True)
        return self._call(T.StringType(), lambda s, c, _, r: dump([to_plain(x) for x in renderables(s, c, options)]), source, variables, None)

    def ast_json(self, source: Column, label: Column | None = None) -> Column:
        options = self.options
        return self._call(T.StringType(), lambda s, c, f, r: dump(ast_plain(parse(s, options), s, f or options.file, options.location)), source, None, label)

    def problems(self, source: Column, variables: Column | None = None, label: Column | None = None) -> Column:
        """All problems of a document in order, as an array."""
        options, shared = self.options, self.shared

        kind = T.ArrayType(DIAGNOSTIC)
        arrow = to_arrow_type(kind)

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            deep()
            config, _ = shared.get()
            for batch in batches:
                for piece in pieces(*(c.to_pylist() for c in batch)):
                    yield pa.array([None if s is None else diagnostics(s, scope(config, v), options, f or options.file) for s, v, f in piece], arrow)

        text = F.lit(None).cast("string")
        return run(source, text if variables is None else variables, text if label is None else label)

    def diagnostics_json(self, source: Column, label: Column, variables: Column | None = None) -> Column:
        """{"file", "errors"} of each document, an error's own place inside it."""
        options = self.options
        return self._call(T.StringType(), lambda s, c, f, r: dump(diagnostics_plain(s, c, options, f)), source, variables, label)

    def formatted(self, source: Column) -> Column:
        """(text, changed, settled) of the canonical source."""
        formatting = self.formatting
        arrow = to_arrow_type(FORMATTED)

        @F.arrow_udf(FORMATTED)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            deep()
            for batch in batches:
                for piece in pieces(batch.to_pylist()):
                    rows = [(None, None, None) if s is None else ((got := settle(s, formatting))[0], got[0] != s, got[1]) for (s,) in piece]
                    yield pa.array([dict(zip(FORMATTED.names, row, strict=True)) for row in rows], arrow)

        return run.asNondeterministic()(source)  # else a filter on it would run it again, before the documents are dealt to tasks


def dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def utf16(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def place_plain(source: str, positions: Positions, at: int) -> dict:
    line, _, offset = positions.place(at)
    at = min(at, len(source))
    start = positions.starts[line]
    whole = at if positions.ascii else utf16(source[:at])
    return {"line": line, "character": utf16(source[start:at]), "offset": whole, "byteOffset": offset}


def span_plain(source: str, positions: Positions, span: tuple[int, int], file: str | None) -> dict:
    return ({} if file is None else {"file": file}) | {"start": place_plain(source, positions, span[0]), "end": place_plain(source, positions, span[1])}


def problem_plain(p, source: str, positions: Positions, file: str | None) -> dict:
    return {"id": p.id, "level": p.level, "message": p.message} | ({} if p.span is None else {"location": span_plain(source, positions, p.span, file)})


def ast_plain(root: Node, source: str, file: str | None = None, with_location: bool = True) -> dict:
    """A tree as JSON data with the keys in the order of the format; positions count UTF-16 units and bytes."""
    from foliospark.kernel.values import to_plain as value_plain

    positions = Positions(source)

    def one(n: Node) -> dict:
        return (
            {
                "$$mdtype": "Node",
                "attributes": {k: value_plain(v) for k, v in n.attributes.items()},
                "slots": {k: one(c) for k, c in n.slots.items()},
                "children": [one(c) for c in n.children],
                "errors": [problem_plain(p, source, positions, file) for p in n.errors],
                "lines": n.lines,
                "type": n.type,
            }
            | ({} if n.tag is None else {"tag": n.tag})
            | {"annotations": [{"type": a.kind, "name": a.name, "value": True if a.kind == "class" else value_plain(a.value)} for a in n.annotations], "inline": n.inline}
            | ({} if n.span is None or not with_location else {"location": span_plain(source, positions, n.span, file)})
        )

    return one(root)


def diagnostics_plain(source: str, config: Config, options: ParseOptions, label: str) -> dict:
    """{"file", "errors"} of one document."""
    positions = Positions(source)
    errors = []
    for node, p in validate(parse(source, replace(options, file=label)), config):
        span = p.span or node.span
        lines = [positions.line(p.span[0]), positions.line(p.span[1])] if p.span else node.lines
        errors.append({"type": node.type, "lines": lines} | ({} if span is None or not options.location else {"location": span_plain(source, positions, span, label)}) | {"error": problem_plain(p, source, positions, label)})
    return {"file": label, "errors": errors}
