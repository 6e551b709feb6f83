"""What changed between two states of a corpus, by Merkle hashes of subtrees: no texts are compared.

A node's digest covers its type, tag, attributes, annotations, slot and its children's digests, but
not its place, so equal subtrees have equal digests wherever they stand.  Documents meet by id, which
must be unique in each state (null ids meet nothing and count as new and gone).  Of the state after:

    kept     the largest subtrees that the document had at the same place
    moved    those that it had elsewhere
    new      the largest subtrees in which nothing was known
    changed  nodes above both known and unknown ones, on the way to what is new

and of the state before `gone`, the largest subtrees in which nothing is left.  Everything meets by
equality of (id, digest), and windows by document look at what is above and below; no document is
compared node by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.nodes import NUMBER


def _marked(nodes: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """The nodes with __known (the other state's document has the subtree), __same (at this place too), __fresh (nothing in it is known) and the same of their parents, __up_known and __up_fresh."""
    own = nodes.select(id_col, NUMBER, "node_id", "last_desc", "type", "tag", "digest", "place")
    theirs = other.groupBy(F.col(id_col).alias("__id"), F.col("digest").alias("__d")).agg(F.collect_set("place").alias("__places"))
    # A merge join: Spark takes node tables for as small as the sources they are parsed from and would broadcast them.
    met = own.join(theirs.hint("merge"), (F.col(id_col) == F.col("__id")) & (F.col("digest") == F.col("__d")), "left")
    met = met.withColumn("__known", F.col("__places").isNotNull()).withColumn("__same", F.coalesce(F.array_contains("__places", F.col("place")), F.lit(False))).drop("__id", "__d", "__places", "place")
    # Descendants are the rows up to last_desc: a subtree knows nothing if no known row lies in that range.
    ahead = Window.partitionBy(NUMBER).orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.min(F.when(F.col("__known"), F.col("node_id"))).over(ahead)
    met = met.withColumn("__fresh", ~F.coalesce(nearest <= F.col("last_desc"), F.lit(False)))
    # What is below a known or a fresh node is so too, so a parent is one if any earlier row that is one reaches this row.
    earlier = Window.partitionBy(NUMBER).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = lambda mark: F.coalesce(F.max(F.when(F.col(mark), F.col("last_desc"))).over(earlier) >= F.col("node_id"), F.lit(False))
    return met.withColumn("__up_known", reached("__known")).withColumn("__up_fresh", reached("__fresh"))


def changes(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, change, node_id, type, tag, digest, n_nodes) between two node tables with digests (`parse_nodes(..., digests=True)`); node_id counts in the state that has the node."""
    size = (F.col("last_desc") - F.col("node_id") + 1).alias("n_nodes")
    out = lambda rows, change: rows.select(id_col, change.alias("change"), "node_id", "type", "tag", "digest", size)
    rows = _marked(after, before, id_col)
    change = F.when(F.col("__known") & ~F.col("__up_known"), F.when(F.col("__same"), "kept").otherwise("moved"))
    change = change.when(F.col("__fresh") & ~F.col("__up_fresh"), "new").when(~F.col("__known") & ~F.col("__fresh"), "changed")
    lost = _marked(before, after, id_col).filter(F.col("__fresh") & ~F.col("__up_fresh"))
    return out(rows, change).filter("change is not null").unionByName(out(lost, F.lit("gone")))
