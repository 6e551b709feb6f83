"""Joins by range and as-of over places in documents: which node holds a place, which heading is in force there.

An interval join meets points with the intervals that hold them.  Each interval is filed at the level
of its length, in buckets as wide as the next power of two, of which it touches two at most; a point
asks one bucket on each level that occurs.  So rows meet by equality, a long interval (the document
itself) is two rows and not one for every bucket below it, and a point meets few intervals that miss
it.  Levels are at most 32 small numbers; a pass over the intervals finds which occur, so write them
first where they are costly to make (see `sources.documents.stored`).  Both joins merge sorted rows:
Spark guesses node tables from the bytes of their compressed columns and would broadcast millions of rows.

The as-of join takes for every left row the last right row at or before it.  Both sides are dealt by
their keys and passed once in order, so keys should be as fine as a document; nothing is compared
pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.nodes import NUMBER


def _level(length: Column) -> Column:
    """The exponent of the smallest power of two that is no smaller than the length."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", start: str = "start", stop: str = "stop", how: str = "inner") -> DataFrame:
    """Points with each interval [start, stop) of equal keys that holds them (`how`: inner or left).

    Columns of the intervals other than the keys are added; their names must be new.  Empty intervals
    and null places hold nothing.
    """
    filed = intervals.filter(F.col(start) < F.col(stop)).withColumn("__level", _level(F.col(stop) - F.col(start)))
    levels = sorted(r[0] for r in filed.select("__level").distinct().collect())  # at most 32 or 63 numbers
    bucket = lambda place, level: F.call_function("shiftright", place.cast("long"), level)
    first, last = bucket(F.col(start), F.col("__level")), bucket(F.col(stop) - 1, F.col("__level"))
    filed = filed.withColumn("__bucket", F.explode(F.array_distinct(F.array(first, last))))
    numbered = points.withColumn("__point", F.monotonically_increasing_id()) if how == "left" else points
    asked = numbered.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asked = asked.withColumn("__bucket", bucket(F.col(at), F.col("__level")))
    met = asked.join(filed.hint("merge"), [*keys, "__level", "__bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("__level", "__bucket")
    new = [c for c in intervals.columns if c not in keys]
    if how == "inner":
        return met.select(*points.columns, *new)
    found = met.select("__point", *new)
    return numbered.join(found.hint("merge"), "__point", "left").select(*points.columns, *new)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str = "at", by: str = "at", columns: list[str] | None = None) -> DataFrame:
    """Left rows with `columns` of the last right row of equal keys whose `by` is not after their `at`; nulls where there is none.

    Right rows of one place: the largest by the named columns, in their order, is the last.
    """
    columns = [c for c in right.columns if c not in (*keys, by)] if columns is None else columns
    a = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("__right"))
    b = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(by).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.struct(*columns).alias("__right"))
    order = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = a.unionByName(b.filter(F.col("__at").isNotNull())).withColumn("__last", F.last("__right", ignorenulls=True).over(order))
    return rows.filter("__side = 1").select("__left.*", *[F.when(F.col("__at").isNotNull(), F.col(f"__last.{c}")).alias(c) for c in columns])


def node_intervals(nodes: DataFrame) -> DataFrame:
    """(_document, node_id, depth, type, tag, start, stop) of every node that has a place; offsets are bytes of UTF-8."""
    return nodes.filter("loc is not null").select(NUMBER, "node_id", "depth", "type", "tag", F.col("loc.start.offset").alias("start"), F.col("loc.end.offset").alias("stop"))


def nodes_at(places: DataFrame, nodes: DataFrame, at: str = "at") -> DataFrame:
    """Places (_document, at, ...) with node_id, type and tag of the deepest node that holds each, the last of equals; nulls where none does."""
    own = list(places.columns)
    met = interval_join(places, node_intervals(nodes).withColumnsRenamed({"start": "__start", "stop": "__stop"}), [NUMBER], at, "__start", "__stop")
    best = met.groupBy(NUMBER, F.col(at).alias("__at")).agg(F.max(F.struct("depth", "node_id", "type", "tag")).alias("n")).withColumnRenamed(NUMBER, "__no")
    joined = places.join(best.hint("merge"), (places[NUMBER] == best["__no"]) & (places[at] == best["__at"]), "left")
    return joined.select(*own, F.col("n.node_id").alias("node_id"), F.col("n.type").alias("type"), F.col("n.tag").alias("tag"))
