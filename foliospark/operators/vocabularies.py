"""Vocabularies as rows: declarations are read and refused where they lie, and documents meet theirs by a key.

A table of declarations (YAML or JSON texts) can hold as many vocabularies as there are sites or
teams; none passes through the driver.  Each worker reads a text once, however many documents use
it.  A refused declaration is a row with the path and the reason, never a failed job, and its
documents have no HTML and no problems; so have documents whose key is null or unknown.  A null text
is the empty declaration: the built-in vocabulary.  Keys must be unique among the vocabularies.
"""

from __future__ import annotations

import functools
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.kernel.build import ParseOptions
from foliospark.kernel.render import render
from foliospark.kernel.schema import Config
from foliospark.kernel.tree import deep
from foliospark.operators.kernels import DIAGNOSTIC, diagnostics, renderables, scope
from foliospark.sources.declare import Declared, DeclarationError, declare, load_text

VERDICT = T.StructType([T.StructField("path", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("nodes", T.ArrayType(T.StringType()))])


@functools.lru_cache(maxsize=512)
def read_declaration(text: str | None) -> Declared | DeclarationError:
    """What a text declares, or why it is refused."""
    try:
        return declare(None if text is None else load_text(text))
    except DeclarationError as e:
        return e
    except (ValueError, RecursionError) as e:  # JSON that cannot be read
        return DeclarationError("config", f"the text cannot be read: {e}")


@functools.lru_cache(maxsize=512)
def configured(text: str | None) -> Config | None:
    got = read_declaration(text)
    return None if isinstance(got, DeclarationError) else got.config()


@F.pandas_udf(VERDICT)
def verdict_column(text: pd.Series) -> pd.DataFrame:
    """(path, reason) of a refused declaration, else the names of its tags and nodes."""
    out = []
    for t in text:
        got = read_declaration(None if t is None or t is pd.NA else t)
        refused = isinstance(got, DeclarationError)
        out.append((got.path, got.reason, None, None) if refused else (None, None, list(got.tags), list(got.nodes)))
    return pd.DataFrame(out, columns=["path", "reason", "tags", "nodes"])


class DeclarationRows:
    """The SQL table function md_declaration(text): one row with path and reason (null where it is accepted), tags and nodes."""

    def eval(self, text: str):
        got = read_declaration(text)
        yield (got.path, got.reason, None, None) if isinstance(got, DeclarationError) else (None, None, list(got.tags), list(got.nodes))


def verdicts(vocabularies: DataFrame, text: str = "declaration") -> DataFrame:
    """The table with path, reason, tags and nodes of each declaration."""
    return vocabularies.withColumn("__v", verdict_column(F.col(text))).select(*vocabularies.columns, "__v.*")


def _met(docs: DataFrame, vocabularies: DataFrame, key: str, text: str) -> DataFrame:
    own = vocabularies.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.lit(True).alias("__known"))
    return docs.join(own, docs[key] == own["__key"], "left")


def _column(kind: T.DataType, fn):
    @F.pandas_udf(kind)
    def run(source: pd.Series, text: pd.Series, known: pd.Series, variables: pd.Series) -> pd.Series:
        deep()
        out = []
        for s, t, k, v in zip(source, text, known, variables, strict=True):
            config = configured(t) if k is not None and k == True and s is not None else None  # noqa: E712
            out.append(None if config is None else fn(s, scope(config, v)))
        return pd.Series(out, dtype=object)

    return run


def _applied(docs: DataFrame, vocabularies: DataFrame, key: str, source: str, text: str, variables: str | None, column: str, kind: T.DataType, fn) -> DataFrame:
    met = _met(docs, vocabularies, key, text)
    own = F.col(variables) if variables else F.lit(None).cast("string")
    return met.withColumn(column, _column(kind, fn)(F.col(source), F.col("__text"), F.col("__known"), own)).drop("__key", "__text", "__known")


def render_by_vocabulary(docs: DataFrame, vocabularies: DataFrame, key: str, source: str = "source", text: str = "declaration", variables: str | None = None, options: ParseOptions | None = None, html: str = "html") -> DataFrame:
    """The documents with HTML, each under the vocabulary of its key."""
    options = replace(options or ParseOptions(), bare=True)
    return _applied(docs, vocabularies, key, source, text, variables, html, T.StringType(), lambda s, config: render(renderables(s, config, options)))


def validate_by_vocabulary(docs: DataFrame, vocabularies: DataFrame, key: str, source: str = "source", text: str = "declaration", variables: str | None = None, options: ParseOptions | None = None, problems: str = "problems") -> DataFrame:
    """The documents with the array of their problems under the vocabulary of their key, in order."""
    options = options or ParseOptions()
    return _applied(docs, vocabularies, key, source, text, variables, problems, T.ArrayType(DIAGNOSTIC), lambda s, config: diagnostics(s, config, options))
