"""Conditionals as a relational plan: which branch of each `if` the node table keeps.

A child's branch is the number of `else` siblings before it; the first branch whose condition
holds wins.  Conditions are resolved by `resolve_column` where they hold references.  An `if`
stands among its siblings and once more at the head of its own children, so one window by document
and parent decides all branches; rows of other branches go, and with them everything below: in
document order a row lies below a dropped one if the largest `last_desc` of those before it
reaches it.  The node table is read once, nothing is joined, and both windows are bounded by a
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.columns import truthy
from foliospark.kernel.schema import Config
from foliospark.operators.nodes import NUMBER
from foliospark.operators.values import resolve_column


#: What `select_branches` reads of the node table.
BRANCHES = ("node_id", "parent_id", "ordinal", "last_desc", "slot", "type", "tag", "attrs")


def _primary(attrs: str) -> Column:
    return F.filter(attrs, lambda a: a["name"] == "primary")


def select_branches(nodes: DataFrame, config: Config | None = None) -> DataFrame:
    """The node table without the branches that do not hold (the `if` and `else` rows stay, `node_id`s too)."""
    is_tag = lambda name: F.coalesce((F.col("type") == "tag") & (F.col("tag") == name), F.lit(False))
    test = is_tag("if") | is_tag("else")
    value = resolve_column(nodes.sparkSession, F.when(test, F.get(_primary("attrs"), F.lit(0))["value"]), config)
    holds = F.when(test, F.when(F.size(_primary("attrs")) > 0, truthy(value)).otherwise(is_tag("else")))
    rows = nodes.withColumn("__holds", holds).withColumn("__under", F.explode(F.when(is_tag("if"), F.array("parent_id", "node_id")).otherwise(F.array("parent_id"))))
    head = is_tag("if") & F.coalesce(F.col("__under") == F.col("node_id"), F.lit(False))
    rows = rows.withColumn("__head", head).withColumn("__else", is_tag("else") & F.col("slot").isNull())
    siblings = Window.partitionBy(NUMBER, "__under")
    before = siblings.orderBy(F.when(F.col("__head"), -1).otherwise(F.col("ordinal"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__branch", F.sum(F.col("__else").cast("int")).over(before)).withColumn("__first", F.max(F.when(F.col("__head"), F.col("__holds"))).over(siblings))
    winner = F.when(F.col("__first"), F.lit(0)).otherwise(F.min(F.when(F.col("__else") & F.col("__holds"), F.col("__branch"))).over(siblings))
    rows = rows.withColumn("__winner", winner).filter(~F.col("__head"))
    lost = F.col("__first").isNotNull() & ~F.col("__else") & (F.col("__winner").isNull() | (F.col("__branch") != F.col("__winner")))
    earlier = Window.partitionBy(NUMBER).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__until", F.max(F.when(lost, F.col("last_desc"))).over(earlier))
    return rows.filter(F.coalesce(F.col("__until") < F.col("node_id"), F.lit(True))).select(*nodes.columns)
