"""Helpers of the operators: checkpoint folder, Arrow maps that carry a table's own columns, pair keys."""

from __future__ import annotations

import functools
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.words import slices, text_buffers


def ensure_checkpoints(spark: SparkSession) -> None:
    """The shared folder is the one the session names; where none is named, only a session on one machine gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder's path, for tables that stages write."""
    ensure_checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a stage wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The table, written once to the shared folder: lineage ends here and it is not computed twice."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> F.Column:
    """A column by its name as it is, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def rest(df: DataFrame, *new: str) -> DataFrame:
    """The table without columns that an operator is about to add (names compare without case)."""
    lower = {n.lower() for n in new}
    clash = [c for c in df.columns if c.lower() in lower]
    return df.drop(*clash) if clash else df


def map_texts(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, pa.Array]],
    fields: list[T.StructField],
    text: str = "text",
    carry: list[str] | None = None,
    keep: str | None = None,
    limit: int = 4 << 20,
) -> DataFrame:
    """One Arrow pass over the whole texts of `df`.

    `fn(batch, bytes, offsets)` gets slices of about `limit` bytes (a longer text alone) and
    returns the new columns.  `carry` names the columns that pass through (default: none but
    the given); `keep` names a new boolean column by which rows stay.
    """
    carry = list(df.columns) if carry is None else carry
    names = [f.name for f in fields]
    given = list(dict.fromkeys([*carry, text]))
    source = df.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(given)])  # Arrow maps take no names with dots
    by_name = {c: T.StructField(c, f.dataType, f.nullable) for c, f in zip(given, source.schema.fields, strict=True)}
    schema = T.StructType([*(by_name[c] for c in carry), *(f for f in fields if f.name != keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=given)
            data, offsets = text_buffers(batch.column(given.index(text)))
            for lo, hi in slices(offsets, limit):
                part = batch.slice(lo, hi - lo)
                got = fn(part, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cols = [part.column(given.index(c)) for c in carry]
                cols += [got[n] for n in names if n != keep]
                out = pa.RecordBatch.from_arrays(cols, names=[*carry, *(n for n in names if n != keep)])
                if keep is not None:
                    out = out.filter(got[keep])
                yield out

    return source.mapInArrow(run, schema)


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


#: The largest bitmap of ids, in bits: 64 MiB.
MAX_LOG2_BITS = 29


class IdBitmap:
    """A hashed bitmap of key values: (__bucket, __bits) in rows of 4 KB and its size, or no rows beyond MAX_LOG2_BITS."""

    def __init__(self, rows: DataFrame | None, log2_bits: int):
        self.rows, self.log2_bits = rows, log2_bits


def id_bitmap(ids: DataFrame, columns: list[str]) -> IdBitmap:
    """The bitmap of a written table's distinct keys, eight bits a key, so that one key in eight passes by chance however many there are."""
    log2_bits = max(15, math.ceil(math.log2(8 * ids.count() + 1)))
    if log2_bits > MAX_LOG2_BITS:
        return IdBitmap(None, log2_bits)
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << log2_bits))
    rows = ids.groupBy(F.bitmap_bucket_number(h).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("__bits"))
    return IdBitmap(cut(rows), log2_bits)


def split_by_bitmap(df: DataFrame, columns: list[str], bitmap: IdBitmap) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the bitmap, rows whose key is surely not or has a null), without a shuffle; without a bitmap all rows may."""
    given = functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    if bitmap.rows is None:
        return df.filter(given), df.filter(~given)
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << bitmap.log2_bits))
    at = F.bitmap_bit_position(h).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False)) & given
    met = df.withColumn("__bucket", F.bitmap_bucket_number(h)).join(F.broadcast(bitmap.rows), "__bucket", "left")  # at most 64 MiB
    return tuple(met.filter(side).drop("__bucket", "__bits") for side in (has, ~has))


def met_by(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined with an aggregate by its keys, so that a hot key's rows can be split.

    An aggregate that is already dealt by the keys joins where it lies, and then all rows of a key
    meet in one task.  A further key, a hash of the others, has both sides dealt anew, and the
    adaptive skew join splits what is large.
    """
    again = F.xxhash64(*keys)
    return rows.withColumn("__again", again).join(groups.withColumn("__again", again), [*keys, "__again"]).drop("__again")


def unsigned_key(column) -> F.Column:
    """A signed long that stands for an unsigned 64-bit value, as 16 hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... inside each group in the given order, nulls first; no task holds a group.

    `rows` must be a written table (see cut).  It is dealt by ranges of (group, order, place in the
    table), so that a hot group, a hot key and repeated rows are split alike; a row's number is its
    place in its range and what earlier ranges hold of its group.
    """
    keys = [*group, *order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = cut(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33))
    parts = dealt.groupBy("__range", *group).agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], "__low", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = [dealt["__range"] == parts["__r"], *(dealt[g].eqNullSafe(parts[f"__g{k}"]) for k, g in enumerate(group))]
    return dealt.join(parts, same).withColumn(name, F.col("__before") + F.col("__at") - F.col("__low")).select(*rows.columns, name)
