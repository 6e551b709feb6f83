"""Rendering as a relational plan: HTML as an ordered aggregate over the renderable node table.

Every element gives an opening event at (rnode_id, 0) and a closing one at (last_desc, 1, -depth);
a document's events, sorted, are its HTML.  There is no recursion and one shuffle, on the document.
A document's events meet in one task, as its HTML is one value in any plan; events combine
nothing before the shuffle, so where the renderable table is not wanted for itself, render with
`operators.kernels.Kernels.html`, which shuffles nothing.  Documents are told apart by their number, so ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.columns import escape_html, html_attribute, whole_number_text
from foliospark.kernel.render import VOID
from foliospark.operators.nodes import NUMBER
from foliospark.plans.validate import text_of


def events(rnodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, _document, __event): what every row prints, and where (at, k, d, text)."""
    void = F.col("name").isin(sorted(VOID))
    named = F.col("name").isNotNull() & (F.col("name") != "")
    opening = F.concat(F.lit("<"), "name", F.array_join(F.transform("attrs", html_attribute), ""), F.lit(">"))
    number = F.col("value").rlike(r"^-?[0-9.]")
    leaf = F.when(F.col("value").startswith('"'), escape_html(text_of(F.col("value")))).when(number, F.coalesce(whole_number_text(F.col("value").try_cast("double")), F.col("value")))
    is_tag = F.col("kind") == "tag"
    text = F.when(is_tag & named, opening).when(~is_tag, leaf)
    first = F.struct(F.col("rnode_id").alias("at"), F.lit(0).alias("k"), F.lit(0).alias("d"), text.alias("text"))
    last = F.when(is_tag & named & ~void, F.struct(F.col("last_desc").alias("at"), F.lit(1).alias("k"), (-F.col("depth")).alias("d"), F.concat(F.lit("</"), "name", F.lit(">")).alias("text")))
    return rnodes.select(id_col, NUMBER, F.explode(F.array_compact(F.array(first, last))).alias("__event")).filter("__event.text is not null")


def without_void_content(rnodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that are below no void element (which built-in schemas never give children)."""
    void = rnodes.filter((F.col("kind") == "tag") & F.col("name").isin(sorted(VOID)) & (F.col("last_desc") > F.col("rnode_id")))
    spans = void.select(F.col(NUMBER).alias("__no"), F.col("rnode_id").alias("__lo"), F.col("last_desc").alias("__hi"))
    return rnodes.join(spans, (rnodes[NUMBER] == spans["__no"]) & (rnodes["rnode_id"] > spans["__lo"]) & (rnodes["rnode_id"] <= spans["__hi"]), "left_anti")


def render_nodes(rnodes: DataFrame, id_col: str = "doc_id", void_content: bool = False) -> DataFrame:
    """(id, _document, html) of every document of the renderable table; `void_content` says that void elements may have rows below them."""
    rows = without_void_content(rnodes, id_col) if void_content else rnodes
    parts = F.array_sort(F.collect_list("__event"))
    return events(rows, id_col).groupBy(id_col, NUMBER).agg(F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("html"))
