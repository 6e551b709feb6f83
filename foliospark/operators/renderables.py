"""Transforming as a DataFrame operator: documents become rows of the renderable node table.

The rows have the shape of the node table (pre-order `rnode_id`, `last_desc`, `depth`); `kind` is
tag or scalar, `value` the JSON text of a scalar, and attributes are in output order (class, id,
then the schema's order).  An attribute that holds renderables keeps its printed text in `text`.
Null sources have no rows; `_document` tells documents apart as in the node table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.kernel.build import ParseOptions
from foliospark.kernel.render import attribute_text
from foliospark.kernel.schema import Config
from foliospark.kernel.transform import Element, Many, to_plain
from foliospark.operators.kernels import Shared, dump, renderables, scope
from foliospark.operators.nodes import BATCH_NODES, NUMBER, deep, given_number, with_numbers

ATTRIBUTE = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("text", T.StringType()), T.StructField("is_many", T.BooleanType())])
FIELDS = [
    T.StructField(NUMBER, T.LongType()),
    *(T.StructField(n, T.IntegerType()) for n in ("rnode_id", "parent_id", "ordinal", "depth", "last_desc")),
    *(T.StructField(n, T.StringType()) for n in ("kind", "name", "value")),
    T.StructField("attrs", T.ArrayType(ATTRIBUTE)),
]


def flatten(roots: list) -> list[dict]:
    """Rows of a list of renderables, in pre-order; arrays are spliced into their parent's children."""
    rows: list[dict] = []
    todo = [(r, None, k) for k, r in enumerate(roots)][::-1]
    while todo:
        item, parent, ordinal = todo.pop()
        if isinstance(item, list):
            todo += [(x, parent, ordinal) for x in item][::-1]
            continue
        me = len(rows)
        row = {"rnode_id": me, "parent_id": parent, "ordinal": ordinal, "depth": 0 if parent is None else rows[parent]["depth"] + 1, "last_desc": me, "name": None, "value": None, "attrs": []}
        if isinstance(item, Element):
            row |= {
                "kind": "tag",
                "name": item.name,
                "attrs": [{"name": k, "value": dump(to_plain(v)), "text": attribute_text(v), "is_many": isinstance(v, Many)} for k, v in item.attributes.items()],
            }
            todo += [(c, me, k) for k, c in enumerate(item.children)][::-1]
        else:
            row |= {"kind": "scalar", "value": dump(to_plain(item))}
        rows.append(row)
    for row in reversed(rows):
        if row["parent_id"] is not None:
            up = rows[row["parent_id"]]
            up["last_desc"] = max(up["last_desc"], row["last_desc"])
    return rows


def transform_documents(df: DataFrame, config: Config | None = None, id_col: str = "doc_id", source: str = "source", variables: str | None = None, options: ParseOptions | None = None) -> DataFrame:
    """The renderable node table of all documents; `variables` names a JSON column of each row's own."""
    options = replace(options or ParseOptions(), bare=True)
    rows = df.select(F.col(id_col).alias("__id"), F.col(source).alias("__source"), (F.col(variables) if variables else F.lit(None)).cast("string").alias("__variables"), given_number(df))
    schema = T.StructType([T.StructField(id_col, rows.schema["__id"].dataType), *FIELDS])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    shared = Shared(df.sparkSession, config or Config())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        held: list[dict] = []
        for batch, numbers in with_numbers(batches):
            for key, text, own, number in zip(*(c.to_pylist() for c in batch.columns[:3]), numbers, strict=True):
                if text is None:
                    continue
                held += [row | {id_col: key, NUMBER: number} for row in flatten(renderables(text, scope(shared.get(), own), options))]
                if len(held) >= BATCH_NODES:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, schema)
