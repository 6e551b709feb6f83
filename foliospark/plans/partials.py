"""Partials as a table: documents meet the partials that they can reach, and no others.

A partial's name is always a text somewhere: quoted in a document, in its variables or in a partial
that it reaches.  So the texts between quotes that are names of partials hold every include that a document
can make, also one whose file is a variable or the value of a function; names that are too many do
no harm, since the renderer looks up what it needs.  The includes between partials make a graph.
Its closure is found by rounds that double the length of paths, to the depth at which rendering ends,
so cycles end too.  Documents with equal sets of names share a bundle, the texts of all partials
that the set reaches; a document row carries its bundle's key until the texts are joined to it.

Documents of one set are dealt to shares, each of which meets the bundle once,
so rendering is spread over many tasks however small the tables or equal the sets are.

No partial passes through the driver, and none need fit one task but those of one bundle.  Partials
of one name: the smallest text is taken.  Null names and null texts are no partials.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.kernel.transform import MAX_DEPTH
from foliospark.sources.documents import shared_folder, tasks

_QUOTED = r'"((?:[^"\\]|\\.)*)"'


def quoted_texts(text: Column) -> Column:
    """The distinct texts between two neighbouring double quotes, and those with escapes as they are meant: all strings of the tags, and more."""
    escaped = F.filter(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(1)), lambda t: F.contains(t, F.lit("\\")))
    meant = F.transform(escaped, lambda t: F.from_json(F.concat(F.lit('["'), t, F.lit('"]')), "array<string>")[0])
    return F.array_distinct(F.array_compact(F.concat(F.split(text, '"'), meant)))


def includes(partials: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """(file, other): which partials the text of each names."""
    names = partials.select(F.col(file).alias("other")).distinct()
    return partials.select(F.col(file).alias("file"), F.explode(quoted_texts(F.col(source))).alias("other")).join(names, "other", "left_semi").select("file", "other").distinct()


def closure(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(file, other): what each partial reaches over `depth` includes at least, by paths of doubling length."""
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)

    def put(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/{k}")
        return spark.read.parquet(f"{folder}/{k}")

    found = put(edges, 0)
    size = found.count()
    for k in range(1, math.ceil(math.log2(depth)) + 1):
        longer = found.alias("a").join(found.alias("b"), F.col("a.other") == F.col("b.file")).select("a.file", "b.other")
        found = put(found.union(longer).distinct(), k)
        before, size = size, found.count()
        if size == before:
            break
    return found


def with_partial_table(docs: DataFrame, partials: DataFrame, source: str = "source", variables: str | None = None, file: str = "file", text: str = "source", always: tuple[str, ...] = (), column: str = "partials") -> DataFrame:
    """The documents with `column`: a map from name to text of all partials within reach; null where there are none.

    `always` are names that the configuration's own variables hold.
    """
    given = partials.filter(F.col(file).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(file).alias("file")).agg(F.min(text).alias("source"))
    named = F.array_union(quoted_texts(F.coalesce(source, F.lit(""))), quoted_texts(F.coalesce(F.col(variables), F.lit("")) if variables else F.lit("")))
    # A source without a tag of that name includes nothing.
    named = F.when(F.contains(F.col(source), F.lit("partial")), F.array_union(named, F.array(*map(F.lit, always)).cast("array<string>")))
    keyed = docs.withColumn("__texts", F.array_sort(named))
    texts = keyed.filter("size(__texts) > 0").select("__texts").distinct().withColumn("file", F.explode("__texts"))
    sets = texts.join(given.select("file"), "file", "left_semi").groupBy("__texts").agg(F.array_sort(F.collect_set("file")).alias("__set"))
    own = sets.select("__set").distinct().withColumn("file", F.explode("__set"))
    reach = closure(includes(given))
    names = own.unionByName(own.join(reach, "file").select("__set", F.col("other").alias("file"))).distinct()
    bundles = names.join(given, "file").groupBy("__set").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "source")))).alias(column))
    n = tasks(docs.sparkSession)
    rows = keyed.join(sets.hint("merge"), "__texts", "left").drop("__texts").withColumn("__share", F.pmod(F.xxhash64(*docs.columns), F.lit(n)))
    own_bundles = rows.filter("__set is not null").select("__set", "__share").distinct().join(bundles.hint("merge"), "__set")
    given_out = [df.repartition(n, "__set", "__share") for df in (rows, own_bundles)]  # a number that Spark does not lower
    return given_out[0].join(given_out[1].hint("merge"), ["__set", "__share"], "left").drop("__set", "__share")
