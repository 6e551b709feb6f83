"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A text's lines (split at \\n) are hashed.  A line is marked where a rolling hash over the last ROLL
line hashes is 0 modulo DIVISOR; a marked line whose predecessor is not marked ends a chunk, unless
it is the text's last but one.  So boundaries move with the lines around them, a shifted passage
falls into the same chunks again, and every chunk of a text of two lines or more has two or more.
Chunks longer than LONGEST lines are cut every LONGEST lines from their beginning (the last piece
takes a single line left over), so texts that repeat one line have bounded chunks as well.  Chunks
with at least one word that occur again anywhere are removed, all but the first: the one in the
document of the smallest id, and there the first.  A line alone in its text is never removed.

Chunks are first counted by two 64-bit hashes, with map-side combining, so a passage that a third
of all rows share is one row a task; only these keys are shuffled for all chunks.  Bodies of keys
that repeat are then grouped by key and bytes.  Keys that hold different bytes (never seen, but
comparing bytes shows it) are joined by their bytes.  Occurrences meet the repeated keys in a join
that adaptive execution splits where a key is hot; removed chunk numbers return by document, and
only texts that lose a chunk are shuffled to meet them.

A chunk goes only where its boundaries lie inside the repeated passage; README has the share of
repeated lines that go.

Null texts have no chunk and stay null; empty texts are one empty line.  Equal rows of an id are one
document (chunks of a document repeat inside it at their second place, not in its second row); rows
of one id with different texts are told apart, in the order of a hash of their text.  Rows with a
null id keep their lines, and other documents' repeats are not measured against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import cut, id_bitmap, met_by, quoted, read, rest, split_by_bitmap

ROLL, DIVISOR, LONGEST, FACTOR = 2, 2, 2, 31
NEW = ("n_lines", "n_removed_lines", "n_removed_chunks", "kept_text")


def line_hash(line: F.Column) -> F.Column:
    """32 bits of a line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _let(value: F.Column, body) -> F.Column:
    """body(value) with the value computed once a row: it is bound as a lambda variable, which the optimizer does not expand."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks_of(text: F.Column, roll: int = ROLL, divisor: int = DIVISOR, longest: int = LONGEST) -> F.Column:
    """The chunks of a text in order: array of (n lines, their bytes)."""

    def marked(hashes, i):
        total = F.lit(0).cast("long")
        for k in range(roll):
            total = total + F.element_at(hashes, F.greatest(i - k, F.lit(1))) * F.lit(FACTOR**k)
        return (i >= roll) & (F.pmod(total, F.lit(divisor)) == 0)

    def ends(hashes):
        n = F.size(hashes)
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i <= n - 2) & marked(hashes, i) & ~marked(hashes, i - 1)))

    def before(ends, k):
        return F.when(k > 0, F.element_at(ends, F.greatest(k, F.lit(1)))).otherwise(F.lit(0))

    def cuts(ends):
        def inner(e, k):
            return _let(before(ends, k), lambda a: F.when(a + longest <= e - 2, F.concat(F.sequence(a + longest, e - 2, F.lit(longest)), F.array(e))).otherwise(F.array(e)))

        return F.flatten(F.transform(ends, inner))

    def pieces(lines, ends):
        return F.transform(ends, lambda e, k: _let(before(ends, k), lambda a: F.struct((e - a).alias("n"), F.array_join(F.slice(lines, a + 1, e - a), "\n").alias("body"))))

    return _let(F.split(text, "\n", -1), lambda lines: _let(_let(_let(F.transform(lines, line_hash), ends), cuts), lambda e: pieces(lines, e)))


def keys_of(body: F.Column) -> tuple[F.Column, F.Column]:
    """Two 64-bit hashes of a chunk's bytes."""
    return F.xxhash64(body), F.xxhash64(F.lit(1), body)


def _occurrences(df: DataFrame, id_col: str, text: str, shape: tuple[int, int, int]) -> DataFrame:
    """(id, v, k, h1, h2, body) of every chunk that could be removed; v tells texts of one id apart."""
    rows = df.filter(quoted(id_col).isNotNull()).select(quoted(id_col).alias("id"), F.xxhash64(quoted(text)).alias("v"), F.posexplode(chunks_of(quoted(text), *shape)).alias("k", "c"))
    rows = rows.select("id", "v", "k", "c.n", "c.body").filter((F.col("n") >= 2) & F.col("body").rlike(r"[^\x20\x09-\x0D]"))
    h1, h2 = keys_of(F.col("body"))
    return rows.select("id", "v", "k", h1.alias("h1"), h2.alias("h2"), "body")


def _repeats(where: DataFrame, keys: list[str]) -> DataFrame:
    """(id, v, k) of all occurrences of a key, with the smallest id that has it as `first`, but the first."""
    at = where.filter("id = first").groupBy(*keys).agg(F.min(F.struct("v", "k")).alias("at"))
    later = where.filter("id > first").select("id", "v", "k")
    return later.union(where.filter("id = first").join(at, keys).filter(F.struct("v", "k") > F.col("at")).select("id", "v", "k"))


def removed_chunks(df: DataFrame, id_col: str = "doc_id", text: str = "text", shape: tuple[int, int, int] = (ROLL, DIVISOR, LONGEST)) -> DataFrame:
    """(id, v, k): number of each chunk that repeats one of an earlier document or of an earlier place."""
    every, pair = _occurrences(df, id_col, text, shape), ["h1", "h2"]
    seen = cut(every.drop("body"))
    often = cut(seen.groupBy(*pair).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).filter("c > 1").select(*pair, "first"))
    some, _ = split_by_bitmap(every, pair, id_bitmap(often, pair))  # other bodies are not shuffled
    bodies = some.groupBy(*pair, "body").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    mixed = cut(bodies.groupBy(*pair).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").join(often, pair, "left_semi").select(*pair))
    alone = mixed.isEmpty()
    plain = often if alone else often.join(mixed, pair, "left_anti")
    gone = _repeats(cut(met_by(seen, plain, pair)), pair)
    if alone:
        return gone
    of_mixed, named = every.join(mixed, pair, "left_semi"), [*pair, "body"]
    by_bytes = bodies.join(mixed, pair, "left_semi").filter("c > 1").select(*named, "first")
    return gone.union(_repeats(cut(met_by(of_mixed, by_bytes, named)), named))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", roll: int = ROLL, divisor: int = DIVISOR, longest: int = LONGEST) -> DataFrame:
    """Adds n_lines, n_removed_lines, n_removed_chunks and kept_text to every row (columns of these names are replaced)."""
    base, shape = rest(df, *NEW), (roll, divisor, longest)
    gone = removed_chunks(base, id_col, text, shape).groupBy("id", "v").agg(F.collect_set("k").alias("__gone"))
    gone = cut(gone.withColumnsRenamed({"id": "__id", "v": "__v"}))
    keyed = base.withColumn("__key", quoted(id_col)).withColumn("__version", F.xxhash64(quoted(text)))
    some, none = split_by_bitmap(keyed, ["__key", "__version"], id_bitmap(gone, ["__id", "__v"]))
    met = some.join(gone.hint("shuffle_hash"), (F.col("__key") == F.col("__id")) & (F.col("__version") == F.col("__v")), "left").select(*map(quoted, base.columns), "__gone")
    joined = met.unionByName(none.select(*map(quoted, base.columns), F.lit(None).cast("array<int>").alias("__gone")))

    def result(chunks):
        every = F.sequence(F.lit(0), F.size(chunks) - 1)
        stay = F.array_except(every, F.col("__gone"))
        return F.struct(
            F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n_lines"),
            F.aggregate(F.col("__gone"), F.lit(0).cast("long"), lambda a, k: a + F.get(chunks, k)["n"]).alias("n_removed_lines"),
            F.size(F.col("__gone")).cast("long").alias("n_removed_chunks"),
            F.array_join(F.transform(stay, lambda k: F.get(chunks, k)["body"]), "\n").alias("kept_text"),
        )

    whole = F.struct(F.size(F.split(quoted(text), "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"), F.lit(0).cast("long").alias("n_removed_chunks"), quoted(text).alias("kept_text"))
    done = joined.withColumn("__done", F.explode(F.array(F.when(F.col("__gone").isNull(), whole).otherwise(_let(chunks_of(quoted(text), *shape), result)))))
    got = [F.when(quoted(text).isNull(), 0).otherwise(F.col("__done")[c]).cast("long").alias(c) for c in NEW[:3]] + [F.when(quoted(text).isNotNull(), F.col("__done")["kept_text"]).alias("kept_text")]
    return done.select(*map(quoted, base.columns), *got)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document keeps, as counts and a digest."""
    got = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle(roll: int = ROLL, divisor: int = DIVISOR, longest: int = LONGEST) -> str:
    """DuckDB SQL of op3_line_dedup: the same boundaries, chunks compared as text."""

    def marked(i: str) -> str:
        return f"({i} >= {roll} AND ({' + '.join(f'h[{i} - {k}] * {FACTOR**k}' for k in range(roll))}) % {divisor} = 0)"

    return f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM d),
f AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (i <= len(l) - 2 AND {marked('i')} AND NOT {marked('(i - 1)')})) AS ends FROM e),
g AS (SELECT doc_id, l, CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END AS a, ends[k] AS b FROM (SELECT doc_id, l, ends, unnest(range(1, len(ends) + 1)) AS k FROM f)),
p AS (SELECT doc_id, l, unnest(list_append(range(a + {longest}, b - 1, {longest}), b)) AS b FROM g),
c AS (SELECT doc_id, row_number() OVER w AS k, b - coalesce(lag(b) OVER w, 0) AS n, array_to_string(l[coalesce(lag(b) OVER w, 0) + 1 : b], chr(10)) AS body FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
r AS (SELECT *, n >= 2 AND regexp_matches(body, '[^\\x20\\x09-\\x0D]') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, k) > 1 AS gone FROM c),
s AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines, count(*) FILTER (WHERE gone) AS n_removed_chunks,
  coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_chunks, 0) AS n_removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""
