"""Merkle dataset manifest: leaves by (source, doc_id), trees of fan three, proofs by coordinate.

The node store is external: leaves are numbered inside their source over sorted ranges and written
as runs of Parquet, one folder a level; each level is made from the folder below it, where three
consecutive nodes of a source have one parent coordinate, until every source has one node.  The
subroots, in the order of their sources, are the leaves of a second tree of the same kind.  Proofs
come down by merge joins on the coordinate (source, place): a parent's row holds its children, so
a child's step (what stands left and right of it) needs no look-up, and what lies above arrives
with the parent.  A row of level k meets one row of level k + 1; no task holds a source, and the
leaves are read once.  The store is a table of a few hundred bytes a document, the proofs of all
levels but the leaves' are half as many rows as there are documents.

Null values have a mark of their own in a leaf (a null text is not an empty one); a null source is a
group, the first; null ids come first in their source.  Rows that share an id stand by their leaves'
digests; equal rows are leaves of their own.  An empty text is a value of no bytes.  An empty table
gives no rows.  Columns that are not named in `fields` are not part of a leaf.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import checkpoint_folder, cut, numbered, quoted, read

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left: string, right: string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, one after the other."""
    return F.sha2(F.concat(*values), 256)


def written(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*map(written, values))


def leaves(df: DataFrame, id_col: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(g, pos, n, id, node, claim) of every row: its source's key, its place there, the source's rows, its leaf, and the leaf with `tampered` columns in place of the given."""
    own = [quoted(f) for f in fields]
    node = leaf(own)
    claim = leaf([(tampered or {}).get(f, quoted(f)) for f in fields]) if tampered else node
    g = F.when(quoted(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), quoted(group).cast("string")))  # sorts as the source does, null first
    rows = numbered(cut(df.select(g.alias("g"), quoted(id_col).alias("id"), node.alias("node"), claim.alias("claim"))), ["g"], ["id", "node", "claim"], "pos")
    return _sized(cut(rows))


def _sized(rows: DataFrame) -> DataFrame:
    """Adds n, the number of leaves of the row's tree; the rows of one tree are met by parts, so a large one is no hot key."""
    part = F.shiftright("pos", 16)
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, 16))))
    return rows.withColumn("part", part).join(sizes, ["g", "part"]).drop("part")


def _parents(below: DataFrame) -> DataFrame:
    """(g, pos, n, node, kids) of the level above: every three consecutive nodes of a tree that has more than one."""
    kid = F.struct("pos", *[c for c in below.columns if c not in ("g", "pos", "n", "kids")])
    met = below.filter("n > 1").groupBy("g", F.floor(F.col("pos") / FAN).alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.ceil(F.first("n") / FAN).alias("n"))
    return met.select("g", F.col("up").alias("pos"), "n", F.sha2(F.array_join("kids.node", ""), 256).alias("node"), "kids")


def write_levels(lowest: DataFrame, folder: str) -> list[DataFrame]:
    """The tables of all levels, each written to its own folder and made from the one before."""
    spark = lowest.sparkSession
    lowest.write.parquet(f"{folder}/level=0")
    levels = [spark.read.parquet(f"{folder}/level=0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        at = f"{folder}/level={len(levels)}"
        _parents(levels[-1]).write.parquet(at)
        levels.append(spark.read.parquet(at))
        most = -(-most // FAN)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(g, node): what remains of each tree."""
    out = levels[0].filter("n = 1").select("g", "node")
    for level in levels[1:]:
        out = out.unionByName(level.filter("n = 1").select("g", "node"))
    return out


def proofs(levels: list[DataFrame], tops: DataFrame | None = None) -> DataFrame:
    """The lowest level's rows with `steps`, from the leaf upwards, and the columns of `tops` (g, steps, ...) of its tree."""
    above = [c for c in tops.columns if c not in ("g", "steps")] if tops is not None else []
    none = F.array().cast(_STEPS)

    def start(level: DataFrame) -> DataFrame:
        """A tree's last node, with what stands above the tree."""
        last = level.filter("n = 1")
        return last.withColumn("steps", none) if tops is None else last.join(tops, "g")

    down = None
    for k in range(len(levels) - 1, 0, -1):
        level = levels[k]
        met = start(level).select("g", "kids", "steps", *above)
        if down is not None:
            met = met.unionByName(level.filter("n > 1").select("g", "pos", "kids").join(down, ["g", "pos"]).select("g", "kids", "steps", *above))
        kids = met.select("g", "steps", *above, "kids", F.posexplode("kids").alias("j", "kid"))
        beside = F.struct(F.array_join(F.slice("kids.node", F.lit(1), F.col("j")), "").alias("left"), F.array_join(F.slice("kids.node", F.col("j") + 2, F.lit(FAN)), "").alias("right"))
        kids = kids.select("g", "kid.*", F.concat(F.array(beside), "steps").cast(_STEPS).alias("steps"), *above)
        down = kids if k == 1 else kids.select("g", "pos", "steps", *above)
    alone = start(levels[0]).drop("n")
    return alone if down is None else alone.unionByName(down.select(*alone.columns))


def manifest(df: DataFrame, id_col: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, folder: str | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; the node store goes to `folder`.

    `folded_root` is the root that the claimed row (with `tampered` columns) gives with the given row's siblings.
    """
    folder = folder or f"{checkpoint_folder(df.sparkSession)}/manifest-{uuid.uuid4().hex}"
    levels = write_levels(leaves(df, id_col, group, fields, tampered), f"{folder}/rows")
    subroots = numbered(cut(roots(levels).select(F.lit("").alias("all"), F.col("g").alias("source"), "node")), ["all"], ["source"], "pos")
    top = write_levels(_sized(cut(subroots.withColumnRenamed("all", "g"))), f"{folder}/sources")
    root = F.col("node").alias("root")
    tops = proofs(top, roots(top).select("g", root, F.array().cast(_STEPS).alias("steps")))
    tops = cut(tops.select(F.col("source").alias("g"), F.col("node").alias("subroot"), "root", "steps"))
    rows = proofs(levels, tops)
    beside = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("steps", F.col("claim"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    rows = rows.select("id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the proof held against the documents of which every second id lost its line ends."""
    docs = read(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    claimed = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, tampered={"text": claimed}).withColumnRenamed("id", "doc_id")


def oracle(levels: int = 14) -> str:
    """DuckDB SQL of the query; `levels` levels hold 3 ** levels documents a source."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = lambda text: " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    # crc32 of the decimal digits: state c, next byte i, and k: 8 before a byte is added, then the bits left to shift.
    shift = "xor({0} >> 1, 3988292384 * ({0} & 1))"
    state = f"CASE k WHEN 0 THEN c WHEN 8 THEN {shift.format('xor(c, ascii(s[i])::BIGINT)')} ELSE {shift.format('c')} END"
    ctes = [f"crc(doc_id, s, i, k, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 1, 8, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, s, i + (k = 0)::INT, (k + 8) % 9, {state} FROM crc WHERE i <= length(s))"]
    ctes.append("tampered AS (SELECT doc_id FROM crc WHERE i > length(s) AND xor(c, 4294967295) % 2 = 0)")
    ctes.append(f"d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256({row('text')}) AS leaf, sha256({row('claim')}) AS claim FROM (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN replace(text, chr(10), '') ELSE text END AS claim FROM documents))")
    ctes.append("a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos, leaf AS h, doc_id, claim, count(*) OVER (PARTITION BY g) AS n FROM d)")
    level = "{t}{k} AS (SELECT g, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + 2) // 3 AS n FROM {t}{j} WHERE n > 1 GROUP BY g, pos // 3)"
    ctes += [level.format(t="a", k=k, j=k - 1) for k in range(1, levels + 1)]
    ctes.append("sub AS (" + " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    ctes.append("b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, g AS source, count(*) OVER () AS n FROM sub)")
    ctes += [level.format(t="b", k=k, j=k - 1) for k in range(1, levels + 1)]
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    # One step of all leaves at a time: what stands left and right of the node on a leaf's way, then the node above.
    start = "SELECT a0.g, a0.pos, a0.doc_id, a0.h AS leaf, sub.h AS subroot, '' AS proof, claim AS folded, a0.n FROM a0 JOIN sub USING (g)"
    ctes.append(f"p0 AS ({start})")

    def step(out: str, before: str, table: str) -> list[str]:
        side = lambda test: f"coalesce((SELECT string_agg(h, '' ORDER BY pos) FROM {table} s WHERE s.g = p.g AND s.pos // 3 = p.pos // 3 AND s.pos {test} p.pos), '')"
        return [
            f"{out}s AS (SELECT p.*, {side('<')} AS l, {side('>')} AS r FROM {before} p)",
            f"{out} AS (SELECT g, CASE WHEN n > 1 THEN pos // 3 ELSE pos END AS pos, doc_id, leaf, subroot, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded, CASE WHEN n > 1 THEN (n + 2) // 3 ELSE n END AS n FROM {out}s)",
        ]

    for k in range(levels):
        ctes += step(f"p{k + 1}", f"p{k}", f"a{k}")
    ctes.append(f"q0 AS (SELECT b0.g, b0.pos, doc_id, leaf, subroot, proof, folded, b0.n FROM p{levels} p JOIN b0 ON b0.source = p.g)")
    for k in range(levels):
        ctes += step(f"q{k + 1}", f"q{k}", f"b{k}")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified FROM q{levels}, root"
