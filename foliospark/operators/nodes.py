"""Parsing as a DataFrame operator: documents become rows of the flat node table.

One row a node, in pre-order with slots before children: a node's descendants are the rows whose
`node_id` lies in (node_id, last_desc], and `path` lists its ancestors from the root.  Values are
ordered JSON text; SQL NULL is an absent value.  The Python boundary is crossed once a document,
in Arrow batches that are sent on every BATCH_NODES rows, so memory follows the largest document
and not the partition; nothing is shuffled.

A null source has no nodes; an empty one is a document node alone.  Every row of the input is a
document of its own, told apart by `_document`, whether its id repeats or is null: its partition's number
and its place there, or a column that already holds such a number (see `numbered`).  Plans group,
join and order by it.  It is the same in every run over a table whose rows keep their order, as files
do; number and write what a shuffle dealt before its rows are joined with their nodes.  Columns of the
input other than the id and the source do not pass through: join them by the number.  Python makes all
columns of all nodes, as Spark cannot tell it what a plan reads: name the `columns` and `types` that are
wanted, which often costs half.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.kernel.build import ParseOptions, parse
from foliospark.kernel.check import shown
from foliospark.kernel.schema import typed
from foliospark.kernel.tree import Node, Positions, Problem, deep
from foliospark.kernel.values import encode, is_number

BATCH_NODES = 20_000

_PLACE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("line", "column", "offset")])
LOCATION = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", _PLACE), T.StructField("end", _PLACE)])
ERROR = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "level", "message")), T.StructField("loc", LOCATION)])
ATTRIBUTE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "value", "shown", "typed")])
ANNOTATION = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "value")])
#: The column that tells documents apart.
NUMBER = "_document"
FIELDS = [
    T.StructField(NUMBER, T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("last_desc", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("slot", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("inline", T.BooleanType()),
    T.StructField("lines", T.ArrayType(T.IntegerType())),
    T.StructField("attrs", T.ArrayType(ATTRIBUTE)),
    T.StructField("annotations", T.ArrayType(ANNOTATION)),
    T.StructField("child_types", T.ArrayType(T.StringType())),
    T.StructField("slot_names", T.ArrayType(T.StringType())),
    T.StructField("loc", LOCATION),
    T.StructField("errors", T.ArrayType(ERROR)),
]


def place(positions: Positions, at: int) -> dict[str, int]:
    line, column, offset = positions.place(at)
    return {"line": line, "column": column, "offset": offset}


def location(positions: Positions, span: tuple[int, int] | None, file: str | None) -> dict | None:
    return None if span is None else {"file": file, "start": place(positions, span[0]), "end": place(positions, span[1])}


def problem_row(p: Problem, positions: Positions, file: str | None) -> dict:
    return {"id": p.id, "level": p.level, "message": p.message, "loc": location(positions, p.span, file)}


def attribute_row(name: str, value) -> dict:
    """What messages print for values whose text Catalyst would spell otherwise: `shown` arrays and unusual numbers, `typed` arrays and objects with their kinds."""
    text = encode(value)
    odd = isinstance(value, list) or is_number(value) and shown(value) != text
    return {"name": name, "value": text, "shown": shown(value) if odd else None, "typed": typed(value) if isinstance(value, list | dict) else None}


def digest_rows(rows: list[dict]) -> None:
    """Adds `digest`, a hash of each subtree without its place, and `place`, the way to it by slots and ordinals."""
    below: list[list[str]] = [[] for _ in rows]
    for row in reversed(rows):
        own = [row[k] for k in ("type", "tag", "inline", "attrs", "annotations")]
        kids = below[row["node_id"]][::-1]
        row["digest"] = hashlib.sha256(json.dumps([*own, kids], ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()
        if row["parent_id"] is not None:
            below[row["parent_id"]].append(row["digest"] if row["slot"] is None else f"{row['slot']}:{row['digest']}")
    for row in rows:
        up = "" if row["parent_id"] is None else rows[row["parent_id"]]["place"]
        row["place"] = f"{up}/{row['ordinal']}" if row["slot"] is None else f"{up}/{row['slot']}"


def flatten(root: Node, source: str, file: str | None = None, with_location: bool = True, digests: bool = False, columns: frozenset[str] | None = None) -> Iterator[dict]:
    """Rows of a tree in pre-order; of `columns`, if given, those that take work to make, and the plain ones."""
    positions = Positions(source)
    rows: list[dict] = []
    wanted = lambda name: columns is None or digests or name in columns
    attrs, annotations, child_types, slot_names, loc, errors, paths = map(wanted, ("attrs", "annotations", "child_types", "slot_names", "loc", "errors", "path"))
    todo: list[tuple[Node, int | None, int, str | None]] = [(root, None, 0, None)]
    while todo:
        node, parent, ordinal, slot = todo.pop()
        me = len(rows)
        depth = 0 if parent is None else rows[parent]["depth"] + 1
        path = ([] if parent is None else [*rows[parent]["path"], parent]) if paths else None
        rows.append(
            {
                "node_id": me,
                "parent_id": parent,
                "ordinal": ordinal,
                "depth": depth,
                "last_desc": me,
                "path": path,
                "slot": slot,
                "type": node.type,
                "tag": node.tag,
                "inline": node.inline,
                "lines": node.lines,
                "attrs": [attribute_row(k, v) for k, v in node.attributes.items()] if attrs else None,
                "annotations": [{"kind": a.kind, "name": a.name, "value": encode(a.value)} for a in node.annotations] if annotations else None,
                "child_types": [c.type for c in node.children] if child_types else None,
                "slot_names": list(node.slots) if slot_names else None,
                "loc": location(positions, node.span, file) if loc and with_location else None,
                "errors": [problem_row(p, positions, file) for p in node.errors] if errors else None,
            }
        )
        below = [(c, me, k, name) for k, (name, c) in enumerate([*node.slots.items(), *((None, c) for c in node.children)])]
        todo += below[::-1]
    for row in reversed(rows):
        if row["parent_id"] is not None:
            up = rows[row["parent_id"]]
            up["last_desc"] = max(up["last_desc"], row["last_desc"])
    if digests:
        digest_rows(rows)
    yield from rows


def numbered(df: DataFrame) -> DataFrame:
    """The table with a number for every row, which its nodes and problems then carry."""
    return df.withColumn(NUMBER, F.monotonically_increasing_id())


def given_number(df: DataFrame):
    """A table's own numbers, or nulls, which with_numbers fills."""
    return (F.col(NUMBER) if NUMBER in df.columns else F.lit(None)).cast("long").alias("__number")


def with_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches with the numbers of their rows: the last column, or the task's partition and the place there."""
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        yield batch, [at + k if n is None else n for k, n in enumerate(batch.columns[-1].to_pylist())]
        at += len(batch)


def parse_nodes(df: DataFrame, id_col: str = "doc_id", source: str = "source", file: str | None = None, options: ParseOptions | None = None, digests: bool = False, columns: tuple[str, ...] | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of all documents; `file` names a column with each document's label, `digests` adds the hash of each subtree and its place in the tree.

    `columns` are those that are wanted beside the id and the document's number, `types` the kinds of nodes; all, if not given.
    """
    options = options or ParseOptions()
    made, kinds = None if columns is None else frozenset(columns), None if types is None else frozenset(types)
    given = [F.col(id_col).alias("__id"), F.col(source).alias("__source"), (F.col(file) if file else F.lit(options.file)).cast("string").alias("__file"), given_number(df)]
    rows = df.select(*given)
    fields = [*FIELDS, *([T.StructField(n, T.StringType()) for n in ("digest", "place")] if digests else [])]
    if made is not None and (lost := made - {f.name for f in fields}):
        raise ValueError(f"the node table has no columns {sorted(lost)}")
    schema = T.StructType([T.StructField(id_col, rows.schema["__id"].dataType), *(f for f in fields if made is None or f.name in made or f.name == NUMBER)])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        held: list[dict] = []
        for batch, numbers in with_numbers(batches):
            for key, text, label, number in zip(*(c.to_pylist() for c in batch.columns[:3]), numbers, strict=True):
                if text is None:
                    continue
                for row in flatten(parse(text, options), text, label, options.location, digests, made):
                    if kinds is not None and row["type"] not in kinds:
                        continue
                    row[id_col], row[NUMBER] = key, number
                    held.append(row)
                    if len(held) >= BATCH_NODES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, schema)
