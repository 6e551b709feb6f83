"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns
of `documents`.  Stages are written and read again between one another, so each works on exactly
what its predecessor kept and a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import checkpoint_folder, quoted, read, remove
from foliospark.llm.decontaminate import decontaminate
from foliospark.llm.line_dedup import dedup_lines
from foliospark.llm.packing import pack
from foliospark.llm.quality import keep_good
from foliospark.llm.simhash import near_dedup
from foliospark.llm.token_counts import count_tokens, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 10)."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that repeat (operator 3); a document with no word left goes, n_chars follows the text."""
    own = {c: c if c in ("doc_id", "text") else f"__c{k}" for k, c in enumerate(docs.columns)}  # out of the way of the operator's columns
    kept = dedup_lines(docs.select(*[quoted(c).alias(name) for c, name in own.items()]))
    text, changed = F.col("kept_text"), F.col("n_removed_chunks") > 0

    def column(name: str) -> F.Column:
        if name == "text":
            return text.alias(name)
        value = F.col(own[name])
        return (F.when(changed, F.length(text)).otherwise(value).cast(docs.schema[name].dataType) if name == "n_chars" else value).alias(name)

    return kept.filter(~changed | text.rlike(r"[^\x20\x09-\x0D]")).select(*map(column, docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2)."""
    return near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (operator 7)."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), clean_only=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left (operator 9), by operator 8's token counts."""
    counted = count_tokens(docs, vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
    return pack(counted, length="n_tokens")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: A conditional random field and XXH64 fingerprints stand before the last stage: no SQL for run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; stages pass their tables through the shared folder, and a table goes when the next is written."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            remove(spark, before)
        before = at
    return docs
