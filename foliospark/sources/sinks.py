"""What runs hand over: HTML, JSON trees, diagnostics for people and programs, exit codes, formatted files.

Lines of JSON and diagnostics are plain columns, so any Spark writer takes them; where order
matters (concatenated output) rows carry their document's place and are sorted by it.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.columns import utf16_length
from foliospark.operators.nodes import NUMBER

_LEVELS_THAT_FAIL = ("error", "critical")


def write_html(df: DataFrame, path: str, html: str = "html", order: str | None = None, mode: str = "errorifexists") -> None:
    """HTML as text files, a line end behind each document, in the order of a column if one is named (range-partitioned, never one task)."""
    rows = df if order is None else df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    rows.select(F.col(html).alias("value")).write.mode(mode).text(path)


def write_lines(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """One JSON value a line."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def _byte_prefix(source: Column, start: Column) -> Column:
    """The part of a place's line that stands before it."""
    data = F.encode(source, "UTF-8")
    return F.decode(F.substring(data, start["offset"] - start["column"] + 1, start["column"]), "UTF-8")


def human_lines(diagnostics: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """Adds `line`, "label:line:column: level[id]: message", to rows of problems with their label and source.

    Lines and columns count from 1, columns in characters; a problem without a place stands at
    the first line of its node.
    """
    start = F.col("loc.start")
    line = F.when(start.isNotNull(), start["line"] + 1).otherwise(F.coalesce(F.get("lines", F.lit(0)) + 1, F.lit(1)))
    column = F.when(start.isNotNull(), F.char_length(_byte_prefix(F.col(source), start)) + 1).otherwise(F.lit(1))
    text = F.concat(F.col(file), F.lit(":"), line, F.lit(":"), column, F.lit(": "), F.col("level"), F.lit("["), F.col("error_id"), F.lit("]: "), F.col("message"))
    return diagnostics.withColumn("line", text)


def utf16_position(source: Column, start: Column) -> Column:
    """(line, character, offset, byteOffset) of a place, characters and offset in UTF-16 units."""
    before = F.decode(F.substring(F.encode(source, "UTF-8"), F.lit(1), start["offset"]), "UTF-8")
    character = utf16_length(_byte_prefix(source, start))
    return F.struct(start["line"].alias("line"), character.alias("character"), utf16_length(before).alias("offset"), start["offset"].alias("byteOffset"))


def diagnostics_json(diagnostics: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, json): {"file", "errors"} of every document, also of those without a problem.

    Problems are gathered by document, which bounds each group by its document.  Where both tables hold
    document numbers (number the documents before they are checked, see `nodes.numbered`), ids may
    repeat or be null; else they must be unique.
    """
    key = NUMBER if NUMBER in documents.columns and NUMBER in diagnostics.columns else id_col
    place = lambda at: F.when(at.isNotNull(), F.struct(*([at["file"].alias("file")] + [utf16_position(F.col("source"), at[e]).alias(e) for e in ("start", "end")])))
    own = documents.select(F.col(id_col).alias("__id"), F.col(key).alias("__key"), F.col("file").alias("__file"), "source")
    met = own.join(diagnostics.hint("merge"), F.col("__key") == F.col(key), "left")
    error = F.struct(F.col("error_id").alias("id"), "level", "message")
    one = F.when(F.col("error_id").isNotNull(), F.struct("node_id", "pos", F.struct("type", "lines", place(F.col("loc")).alias("location"), error.alias("error")).alias("e")))
    rows = met.groupBy("__key", F.col("__id").alias("__doc")).agg(F.first("__file").alias("file"), F.array_sort(F.collect_list(one)).alias("found"))
    return rows.select(F.col("__doc").alias(id_col), F.to_json(F.struct("file", F.transform("found", lambda x: x["e"]).alias("errors"))).alias("json"))


def exit_code(diagnostics: DataFrame, documents: DataFrame | None = None, error: str = "error") -> int:
    """0 without problems, 1 with one of level error or critical, 2 if a document could not be read; the worst wins."""
    failed = 0 if documents is None or error not in documents.columns else documents.agg(F.max(F.when(F.col(error).isNotNull(), 2))).first()[0] or 0
    return max(failed, diagnostics.agg(F.max(F.when(F.col("level").isin(*_LEVELS_THAT_FAIL), 1))).first()[0] or 0)


def unified_diff(label: str, source: str, formatted: str) -> str:
    """What `check` prints of a document that formatting would change."""
    plain = source.replace("\r\n", "\n")
    head = f"{label}: CRLF line endings; fmt writes LF\n" if plain != source else ""
    if plain == formatted:
        return head
    lines = difflib.unified_diff(plain.splitlines(keepends=True), formatted.splitlines(keepends=True), f"a/{label}", f"b/{label}")
    return head + "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines)


@F.pandas_udf(T.StringType())
def diff_column(label: pd.Series, source: pd.Series, formatted: pd.Series) -> pd.Series:
    """The diff of each changed document; null where nothing changes."""
    return pd.Series([None if s is None or f is None or s == f else unified_diff(x or "", s, f) for x, s, f in zip(label, source, formatted, strict=True)], dtype=object)


def format_check(formatted: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """(file, settled, diff) of the documents that are not in canonical form; `formatted` holds (text, changed, settled)."""
    rows = formatted.filter(F.col("formatted.changed") | ~F.col("formatted.settled"))
    return rows.select(file, F.col("formatted.settled").alias("settled"), diff_column(F.col(file), F.col(source), F.col("formatted.text")).alias("diff"))


def format_code(formatted: DataFrame, check: bool = True) -> int:
    """2 if a document does not settle, 1 if `check` and one would change, else 0."""
    worst = F.max(F.when(~F.col("formatted.settled"), 2).when(F.col("formatted.changed") & F.lit(check), 1))
    return formatted.agg(worst).first()[0] or 0


def write_formatted(formatted: DataFrame, path: str, file: str = "file", mode: str = "errorifexists") -> None:
    """Changed documents with their canonical text as a Parquet table, never over the input being read."""
    formatted.filter("formatted.changed and formatted.settled").select(file, F.col("formatted.text").alias("source")).write.mode(mode).parquet(path)
