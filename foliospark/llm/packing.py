"""Packing: optimal length buckets and token-budget batches.

Lengths (words of `[^\\x20\\x09-\\x0D]+` unless a length column is named) go into a global histogram
of bounded size: exact up to EXACT, then STEPS bins an octave.  Dynamic programming over the
histogram finds the at most BUCKETS boundaries whose total padding is smallest, each a largest
length seen in its bin: the least of all for lengths up to EXACT, the least over bins beyond.
Padding has the quadrangle inequality, so best last cuts never move back and each bucket takes
n log n steps.  A bucket with boundary b takes max(1, budget // b) rows a batch.

Rows are numbered in the order of their ids over ranges of (bucket, id, length), so no task holds a
bucket, however ids are spread and however many rows share one or have none.

Null and empty texts have length 0 and sit in the first bucket (boundary at least 1); rows with a
null id come first; repeated rows of an id are numbered one after the other; an empty table gives
an empty result.  Other columns do not return.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import cut, numbered, quoted, read

BUCKETS, BUDGET, EXACT, STEPS = 8, 16384, 1 << 15, 64


def word_count(text: str) -> F.Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram_bin(length: str) -> F.Column:
    """Number of the histogram bin of a length: one a length up to EXACT, then STEPS bins of equal width an octave."""
    x = F.col(length)
    octave = F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double") / EXACT))
    octave = F.when(F.lit(EXACT) * F.pow(F.lit(2.0), octave) > x, octave - 1).otherwise(octave)
    low = F.lit(EXACT) * F.pow(F.lit(2.0), octave)
    inside = F.floor((x - low) * STEPS / low)
    return F.when(x < EXACT, x).otherwise(EXACT + octave * STEPS + inside).cast("long")


def boundaries(rows: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Bucket boundaries of least padding from (largest length, rows, sum of lengths) of each bin; ties take fewer, then smaller ones."""
    rows = sorted(r for r in rows if r[1])
    if not rows:
        return []
    top = np.array([max(1, r[0]) for r in rows], dtype=object)
    count = np.concatenate([[0], np.cumsum([r[1] for r in rows])]).astype(object)
    total = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(object)
    n = len(rows)
    exact = int(top[-1]) * int(count[-1]) < 1 << 62
    kind = np.int64 if exact else object
    top, count, total = top.astype(kind), count.astype(kind), total.astype(kind)
    # least[j]: padding of the first j bins; a bucket of bins i..j-1 costs top[j-1] * rows - lengths.
    ends_at = np.concatenate([top[:1] * 0, top])
    least = ends_at * count - total
    steps, ends = [], [least[n]]
    for _ in range(1, min(buckets, n)):
        new, came = least.copy(), np.zeros(n + 1, dtype=np.int64)
        left = [(2, n, 1, n - 1)]  # ends lo..hi, whose best last cuts lie in a..b
        while left:
            lo, hi, a, b = left.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            through = least[i] + ends_at[j] * (count[j] - count[i]) - (total[j] - total[i])
            best = int(np.argmin(through))
            if through[best] < new[j]:
                new[j], came[j] = through[best], a + best
            left += [(lo, j - 1, a, a + best), (j + 1, hi, a + best, b)]
        steps.append(came)
        least = new
        ends.append(least[n])
    use = int(np.argmin(ends))
    out, j = [int(top[n - 1])], n
    for came in reversed(steps[:use]):
        if came[j]:
            j = int(came[j])
            out.append(int(top[j - 1]))
    return sorted(set(out))


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, bucket_length, batch, slot) of every row: batches of a bucket are numbered from 0 in id order."""
    size = word_count(text) if length is None else F.greatest(F.coalesce(quoted(length), F.lit(0)), F.lit(0)).cast("long")
    rows = cut(df.select(quoted(id_col).cast("long").alias("__id"), size.alias("n_tokens")))
    bins = rows.groupBy(histogram_bin("n_tokens").alias("bin")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("total"))
    edges = boundaries([(r["top"], r["rows"], r["total"]) for r in bins.collect()], buckets)  # a bounded number of bins
    bucket = F.lit(len(edges) - 1 if edges else 0)
    for k in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= edges[k], F.lit(k)).otherwise(bucket)
    limit = F.element_at(F.array(*[F.lit(e) for e in edges or [1]]), F.col("bucket") + 1).cast("long")
    placed = numbered(rows.withColumn("bucket", bucket), ["bucket"], ["__id", "n_tokens"], "__place").withColumn("bucket_length", limit)
    place, per = F.col("__place"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length")))
    return placed.select(F.col("__id").alias(id_col), "n_tokens", "bucket", "bucket_length", F.floor(place / per).cast("long").alias("batch"), F.pmod(place, per).cast("long").alias("slot"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document; n_tokens and the budget are in words, as in its SQL."""
    return pack(read(spark, sf_dir, "documents"))


def oracle(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """DuckDB SQL of op9_packing: one step of the dynamic programme for each bucket."""
    sql = f"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
o AS (SELECT doc_id, n, CASE WHEN n < {EXACT} THEN NULL ELSE floor(log2(n::DOUBLE / {EXACT})) END AS oct FROM d),
p AS (SELECT doc_id, n, CASE WHEN {EXACT} * pow(2.0, oct) > n THEN oct - 1 ELSE oct END AS oct FROM o),
b AS (SELECT doc_id, n, CASE WHEN n < {EXACT} THEN n ELSE {EXACT} + oct * {STEPS} + floor((n - {EXACT} * pow(2.0, oct)) * {STEPS} / ({EXACT} * pow(2.0, oct))) END AS bin FROM p),
h AS (SELECT greatest(1, max(n)) AS top, count(*) AS c, sum(n) AS s, bin FROM b GROUP BY bin),
g AS (SELECT row_number() OVER (ORDER BY top) AS j, top, sum(c) OVER (ORDER BY top) AS c, sum(s) OVER (ORDER BY top) AS s FROM h),
z AS (SELECT 0 AS j, 0::BIGINT AS top, 0::HUGEINT AS c, 0::HUGEINT AS s UNION ALL SELECT * FROM g),
k1 AS (SELECT j, top * c - s AS cost, [top] AS edges FROM g)"""
    for k in range(2, buckets + 1):
        sql += f""",
k{k} AS (SELECT j, arg_min(edges, {{'c': cost, 'z': i <> 0, 'i': i}}) AS edges, min(cost) AS cost FROM (
  SELECT j, 0 AS i, cost, edges FROM k{k - 1}
  UNION ALL SELECT g.j, a.j, a.cost + g.top * (g.c - z.c) - (g.s - z.s), list_append(a.edges, g.top) FROM k{k - 1} a JOIN z ON z.j = a.j JOIN g ON g.j > a.j) GROUP BY j)"""
    return (
        sql
        + f""",
e AS (SELECT unnest(edges) AS edge FROM k{buckets} WHERE j = (SELECT max(j) FROM g)),
f AS (SELECT edge, (row_number() OVER (ORDER BY edge) - 1)::INTEGER AS bucket, coalesce(lag(edge) OVER (ORDER BY edge), -1) AS low FROM e),
r AS (SELECT doc_id, n, bucket, edge, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS place, greatest(1, {budget} // edge) AS per FROM d JOIN f ON n > low AND n <= edge)
SELECT doc_id, n AS n_tokens, bucket, edge::BIGINT AS bucket_length, (place // per)::BIGINT AS batch, (place % per)::BIGINT AS slot FROM r"""
    )
