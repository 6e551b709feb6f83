"""Corpus analytics over the node table and its problems: outlines, counts, links.

Counts combine before the shuffle; nothing gathers a document's rows but the outline's numbering,
which a window by document bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.columns import unsafe_link
from foliospark.operators.nodes import NUMBER
from foliospark.plans.validate import text_of


def attribute(name: str, attrs: str = "attrs"):
    """JSON text of an attribute, null where a node lacks it."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def node_counts(nodes: DataFrame) -> DataFrame:
    """(type, tag, n_nodes): counts of node kinds over the corpus."""
    return nodes.groupBy("type", F.coalesce("tag", F.lit("")).alias("tag")).agg(F.count(F.lit(1)).alias("n_nodes"))


def error_rollup(problems: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(error_id, level, n_errors, n_docs) over all problems; documents count by their number, or by id where a table of problems has none."""
    by_doc = problems.groupBy("error_id", "level", NUMBER if NUMBER in problems.columns else id_col).agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("error_id", "level").agg(F.sum("n").alias("n_errors"), F.count(F.lit(1)).alias("n_docs"))


#: What `outline` reads of the node table.
OUTLINE = {"columns": ("node_id", "last_desc", "type", "attrs"), "types": ("heading", "text", "code")}


def outline(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, _document, ordinal, level, text) of every heading, numbered from 1 in each document; text joins the plain text below it."""
    # In document order a text belongs to the last heading before it if that one reaches so far; all steps go by document.
    is_head = F.col("type") == "heading"
    content = attribute("content")
    level = F.when(is_head, attribute("level").cast("double").cast("int"))
    rows = nodes.filter("type in ('heading', 'text', 'code')").select(
        id_col, NUMBER, "node_id", level.alias("level"), F.when(content.startswith('"'), text_of(content)).alias("t"), F.when(is_head, F.struct("node_id", "last_desc")).alias("own")
    )
    before = Window.partitionBy(NUMBER).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", F.last("own", ignorenulls=True).over(before)).filter("node_id <= head.last_desc")
    parts = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("node_id", "t"))))
    heads = rows.groupBy(NUMBER, id_col, F.col("head.node_id").alias("__head")).agg(F.max("level").alias("level"), parts.alias("parts"))
    order = Window.partitionBy(NUMBER).orderBy("__head")
    return heads.select(id_col, NUMBER, F.row_number().over(order).alias("ordinal"), "level", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))


def links(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, node_id, type, url, unsafe) of every link and image; unsafe destinations never become links, so `unsafe` audits other trees."""
    rows = nodes.filter("type in ('link', 'image')")
    url = F.coalesce(attribute("href"), attribute("src"))
    return rows.select(id_col, "node_id", "type", F.when(url.startswith('"'), text_of(url)).otherwise(url).alias("url")).withColumn("unsafe", unsafe_link(F.col("url")))


def tag_usage(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(tag, attribute, n): how often each tag is written with each attribute ("" for all its uses)."""
    tags = nodes.filter("type = 'tag'").select("tag", F.explode(F.array_prepend(F.transform("attrs", lambda a: a["name"]), F.lit(""))).alias("attribute"))
    return tags.groupBy("tag", "attribute").agg(F.count(F.lit(1)).alias("n"))


def problem_cube(problems: DataFrame, by: tuple[str, ...] = ("error_id", "level", "name"), cube: bool = False) -> DataFrame:
    """Counts over all levels of `by` (ROLLUP, or CUBE): n problems and n_docs documents that have one; `grain` is the grouping's number, whose bits mark columns summed over.

    A document's problems are counted once before anything is rolled up, so each document travels once for each group it is in.
    """
    each = problems.groupBy(*by, NUMBER).agg(F.count(F.lit(1)).alias("__n"))
    rolled = (each.cube if cube else each.rollup)(*by)
    return rolled.agg(F.grouping_id().cast("int").alias("grain"), F.sum("__n").alias("n"), F.count_distinct(NUMBER).alias("n_docs"))


def document_sketches(problems: DataFrame, by: tuple[str, ...] = ("error_id", "level"), id_col: str = "doc_id", log2_size: int = 12) -> DataFrame:
    """(by, documents, n): for each group a HyperLogLog sketch of the ids of its documents and its problems; a few KB, whatever it has seen.

    Sketches of batches are stored and merged later (merge_sketches), so no batch is read again.  The
    relative standard error of 2 ** 12 registers is 1.6 per cent.  Ids that are null are not counted.
    """
    return problems.groupBy(*by).agg(F.hll_sketch_agg(F.col(id_col).cast("string"), F.lit(log2_size)).alias("documents"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = ("error_id", "level")) -> DataFrame:
    """Sketches of equal groups as one, also for fewer columns than they were made for."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("documents").alias("documents"), F.sum("n").alias("n"))


def estimated(sketches: DataFrame) -> DataFrame:
    """The sketches with n_docs, the estimated number of documents."""
    return sketches.withColumn("n_docs", F.hll_sketch_estimate("documents"))


def top_by_group(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; equal rows in `order` are told apart by its last columns, which should be unique.

    Spark keeps k rows a group in every task before the shuffle (WindowGroupLimit), so a hot group costs k rows a task.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
