"""Reading documents, partials and configurations through Spark's readers.

Paths may lie in any store that Spark reads.  A file that cannot be decoded is a row with its
error, never a failed job; a named file that does not exist is one too.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.kernel.build import ParseOptions, parse
from foliospark.kernel.schema import Config
from foliospark.sources.declare import configure

#: Bytes of all partials together up to which they are read to the driver.
PARTIALS_LIMIT = 128 << 20


def _decoded(content: Column) -> tuple[Column, Column]:
    """(text, error) of bytes: text where they are UTF-8."""
    good = F.is_valid_utf8(content.cast("string"))
    return F.when(good, content.cast("string")), F.when(~good, F.lit("stream did not contain valid UTF-8"))


def read_documents(spark: SparkSession, paths: str | list[str], label: str | None = None, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(doc_id, file, source, error), one row a file; doc_id is a hash of the path."""
    named = [paths] if isinstance(paths, str) else list(paths)
    found, lost = [], []
    for path in named:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        try:
            found.append((reader.option("pathGlobFilter", glob) if glob else reader).load(path))
        except AnalysisException as e:
            lost.append((path, str(e).splitlines()[0]))
    out = None
    for files in found:
        text, error = _decoded(F.col("content"))
        rows = files.select((F.lit(label) if label else F.col("path")).alias("file"), text.alias("source"), error.alias("error"), "path")
        out = rows if out is None else out.unionByName(rows)
    if lost or out is None:
        rows = spark.createDataFrame([(p, None, e, p) for p, e in lost], "file string, source string, error string, path string")
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.xxhash64("path").alias("doc_id"), "file", "source", "error")


def from_column(df: DataFrame, source: Column | str, id_col: str = "doc_id", file: Column | None = None) -> DataFrame:
    """(id, file, source) of a table whose column or expression holds the documents."""
    text = F.col(source) if isinstance(source, str) else source
    return df.select(id_col, (F.lit(None).cast("string") if file is None else file).alias("file"), text.cast("string").alias("source"))


#: Tasks a core into which documents are dealt: none is long, and unequal ones level out.
WAVES = 8


def tasks(spark: SparkSession) -> int:
    """How many tasks work that is dear by the row is dealt to."""
    return WAVES * spark.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over several tasks a core where its files give fewer splits than that; others stay as they are.

    Parsing a document costs far more than reading its bytes, by which Spark sizes splits: a small
    file would be one task, and splits that hold no start of a row group are empty ones.  Tables of
    many splits are never shuffled.
    """
    return dealt(df) if df.rdd.getNumPartitions() < tasks(df.sparkSession) else df


def dealt(df: DataFrame) -> DataFrame:
    """A table over several tasks a core: what a shuffle gave would meet in a few, which Spark sizes by bytes."""
    return df.repartition(tasks(df.sparkSession))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session shares between machines; where none is named, only a session on one machine gets one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='tables-')).rstrip('/')}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read again: what several plans read is computed once, and lineage ends here."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def strip_frontmatter(source: Column) -> Column:
    """The source without a leading block between lines of three dashes (a host's concern, not the parser's)."""
    return F.regexp_replace(source, r"^---[ \t]*\r?\n(?:[^\n]*\n)*?---[ \t]*(?:\r?\n|$)", "")


def read_partials(spark: SparkSession, folder: str) -> dict[str, str]:
    """{relative path: text} of all UTF-8 files below a folder, by name; at most PARTIALS_LIMIT bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > PARTIALS_LIMIT:
        raise ValueError(f"the partials take {total} bytes; at most {PARTIALS_LIMIT} are read")
    text, _ = _decoded(F.col("content"))
    root = folder.rstrip("/").rpartition("/")[2]
    rows = files.select("path", text.alias("text")).filter("text is not null").collect()
    return {path.rpartition(f"/{root}/")[2] if path.count(f"/{root}/") == 1 else _below(path, folder): body for path, body in sorted((r["path"], r["text"]) for r in rows)}


def _below(path: str, folder: str) -> str:
    plain = folder.split(":", 1)[-1].strip("/")
    return path[path.index(plain) + len(plain) + 1 :] if plain in path else path.rpartition("/")[2]


def with_partials(config: Config, texts: dict[str, str], options: ParseOptions | None = None) -> Config:
    """The configuration with partials parsed once."""
    options = options or ParseOptions()
    return replace(config, partials={**config.partials, **{k: parse(t, replace(options, file=k)) for k, t in texts.items()}})


def read_config(spark: SparkSession, path: str | None = None, partials: str | None = None, variables: list[str] | None = None, **rest: Any) -> Config:
    """A configuration from a YAML or JSON file, a folder of partials and NAME=VALUE settings."""
    text = None
    if path is not None:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    config = configure(text, variables, **rest)
    return config if partials is None else with_partials(config, read_partials(spark, partials))
