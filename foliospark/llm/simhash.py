"""SimHash near-dedup: 64-bit fingerprints of 4-word shingles, linked at 4 or fewer differing bits.

Candidates come from BK-trees (children keyed by the integer Hamming distance to the parent).
Fingerprints go to shards by the pigeonhole rule: of m bit blocks, two fingerprints at most r
bits apart agree in at least m - r, so each choice of m - r blocks gives one shard key, and
every linked pair meets in some shard.  Fingerprints of a shard of more than SHARD members are
dealt anew by the largest number of blocks (radius + MORE), where shards are much smaller; what is
still crowded there lies within few bits of one another, is split into parts, and each pair of
parts is searched by a task of its own.  So no task holds an unbounded shard.  Shards reach tasks
by a shuffle: a broadcast of the trees of all fingerprints would bring the whole corpus through
the driver (README has the sizes).  Each task builds its trees as arrays, follows only edges whose
distance lies within the radius of the query's, and returns a spanning forest of the links, never
all pairs.  Components of the forest edges over distinct fingerprints come from star contraction.

Null and empty texts have fingerprint zero and link like any other.  Equal rows of a doc_id are one
document; rows of one doc_id with different texts are told apart, each with the component of its own
text.  Rows with a null id have a fingerprint, no component, and link nothing; near_dedup keeps
them.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import cut, id_bitmap, map_texts, met_by, quoted, read, rest, split_by_bitmap, unsigned_key
from foliospark.llm.graph import components
from foliospark.llm.words import PIECE

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of a shard that one tree holds, and rows that a task searches at once.
SHARD, FOREST = 2048, 1 << 15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Mean size of a shard up to which no further block is added, and the most blocks over the radius.
MEAN_SHARD, MORE = 64, 4


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """Fingerprint of one text's UTF-8 bytes, read in pieces that end before white space."""
    digest, votes, n, at, words = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 0, 0, []
    while at < len(raw):
        gap = _SPACE.search(raw, at + PIECE)
        to = gap.start() if gap else len(raw)
        words = words + raw[at:to].lower().split()  # of bytes: A-Z and ASCII white space only
        at = to
        if len(words) < width and (gap or n or not words):
            continue
        joined, k = b" ".join(words), max(1, len(words) - width + 1)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lens + 1) - 1
        spans = zip((ends - lens)[:k].tolist(), ends[-k:].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=k)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n, words = n + k, words[len(words) - width + 1 :] if width > 1 else []
    on = np.packbits(votes * 2 > n, bitorder="little")
    return int(on.view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `fp` (long with the bits of the unsigned fingerprint) to every row."""

    def fn(_, data, offsets):
        raw = data.tobytes()
        got = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return {"fp": pa.array(np.array(got, dtype=np.uint64).view(np.int64), pa.int64())}

    return map_texts(rest(df, "fp"), fn, [T.StructField("fp", T.LongType())], text, carry)


def build_trees(fps: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once, level by level.

    Fingerprints of a shard are distinct.  The first of a shard is its root; every other point
    moves down along the edge of its distance to the node it stands at; the first to arrive on a
    new edge becomes the child.  Returns (root of each shard, by shard value order; edges sorted
    by parent and distance as keys parent * 65 + distance; their children; sorted shard values).
    """
    shards, root = np.unique(shard, return_index=True)
    at = root[np.searchsorted(shards, shard)]
    left = np.flatnonzero(at != np.arange(len(fps)))
    at = at[left]
    keys, kids = [], []
    while len(left):
        key = at * (BITS + 1) + np.bitwise_count(fps[left] ^ fps[at]).astype(np.int64)
        edge, first = np.unique(key, return_index=True)
        keys.append(edge)
        kids.append(left[first])
        node = left[first][np.searchsorted(edge, key)]
        down = node != left
        left, at = left[down], node[down]
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    kid = np.concatenate(kids) if kids else np.zeros(0, dtype=np.int64)
    order = np.argsort(key)
    return root, key[order], kid[order], shards


def search_trees(fps, trees, queries, query_shard, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query index, node index) of all nodes within the radius of a query, in the query's shard."""
    root, key, kid, shards = trees
    found_q, found_n = [], []
    where = np.searchsorted(shards, query_shard)
    where = np.minimum(where, max(len(shards) - 1, 0))
    q = np.flatnonzero(shards[where] == query_shard) if len(shards) else np.zeros(0, dtype=np.int64)
    node = root[where[q]]
    while len(q):
        d = np.bitwise_count(queries[q] ^ fps[node]).astype(np.int64)
        hit = d <= radius
        found_q.append(q[hit])
        found_n.append(node[hit])
        lo = np.searchsorted(key, node * (BITS + 1) + np.maximum(d - radius, 0), side="left")
        hi = np.searchsorted(key, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
        n = hi - lo
        total = int(n.sum())
        skip = np.repeat(np.cumsum(n) - n, n)
        edge = np.repeat(lo, n) + np.arange(total) - skip
        q, node = np.repeat(q, n), kid[edge]
    if not found_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_q), np.concatenate(found_n)


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n points over the links (a, b)."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            return label
        label = new


def link_shards(fps: np.ndarray, ids: np.ndarray, shard: np.ndarray, part: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest edges (id, id) of the links inside shards.

    part 0: a member of the tree and a query; 1: of the tree only; 2: a query only.
    """
    tree = np.flatnonzero(part <= 1)
    ask = np.flatnonzero((part == 0) | (part == 2))
    if not len(tree) or not len(ask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    trees = build_trees(fps[tree], shard[tree])
    label = np.arange(len(fps))
    for at in range(0, len(ask), 1024):
        some = ask[at : at + 1024]
        q, node = search_trees(fps[tree], trees, fps[some], shard[some], radius)
        a, b = some[q], tree[node]
        real = a != b
        if real.any():
            label = forest(len(fps), a[real], b[real], label)
    child = np.flatnonzero(label != np.arange(len(fps)))
    return ids[child], ids[label[child]]


def spans_of(m: int) -> list[tuple[int, int]]:
    """(low bit, width) of m blocks."""
    edge = [BITS * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edge, edge[1:], strict=False)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Number of blocks for n fingerprints: the fewest with shards of MEAN_SHARD at most."""
    fits = (m for m in range(radius + 1, radius + MORE) if n >> ((m - radius) * min(w for _, w in spans_of(m))) <= MEAN_SHARD)
    return next(fits, radius + MORE)


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """Forest edges over (combo, key, i, j, fp, id, part), rows of a shard lying together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held)
            cols = [np.asarray(table[c].to_numpy()) for c in ("combo", "key", "i", "j")]
            new = np.ones(len(table), dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            end = len(table) if last else int(np.flatnonzero(new)[-1])
            if end == 0:  # one shard so far: bounded, so wait for its end
                return
            shard = np.cumsum(new[:end])
            fps = table["fp"].to_numpy()[:end].view(np.uint64)
            a, b = link_shards(fps, table["id"].to_numpy()[:end], shard, table["part"].to_numpy()[:end], radius)
            left = table.slice(end)
            held, size = left.to_batches(), len(left)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= FOREST:
                yield from flush(False)
        if size:
            yield from flush(True)

    return rows.mapInArrow(run, "a long, b long")


def _sharded(reps: DataFrame, m: int, radius: int) -> DataFrame:
    """(fp, id, combo, key): every fingerprint in the shard of each choice of m - radius blocks."""
    spans, keys = spans_of(m), []
    for c, chosen in enumerate(combinations(range(m), m - radius)):
        key = F.lit(0).cast("long")
        for block in chosen:
            low, width = spans[block]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(c).alias("combo"), key.alias("key")))
    return reps.select("fp", "id", F.explode(F.array(*keys)).alias("k")).select("fp", "id", "k.combo", "k.key")


def link_fingerprints(reps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between ids of `reps` (fp, id: distinct fingerprints) whose components are those of all links."""
    found, m = [], blocks_for(n, radius)
    while True:
        rows = _sharded(reps, m, radius)
        crowded = cut(rows.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD).select("combo", "key", F.ceil(F.col("n") / SHARD).cast("int").alias("parts")))
        rows = rows.join(crowded, ["combo", "key"], "left")
        last = m == radius + MORE or crowded.isEmpty()
        found.append(_in_parts(rows if last else rows.filter("parts is null"), radius))
        if last:
            break
        reps, m = cut(rows.filter("parts is not null").select("fp", "id").distinct()), radius + MORE
    return functools.reduce(DataFrame.unionByName, found)


def _in_parts(rows: DataFrame, radius: int) -> DataFrame:
    """Edges inside shards (combo, key); a shard with a number of parts is searched by pairs of them."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int"))
    # A part meets itself and every other part: (i, j) with i <= j; part i is the tree, part j asks.
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
        lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.when(x == F.col("own"), 0).when(F.col("own") < x, 1).otherwise(2).alias("part")),
    )
    rows = rows.select("combo", "key", "fp", "id", F.explode(pairs).alias("p")).select("combo", "key", "fp", "id", "p.i", "p.j", "p.part")
    return _links(rows.repartition("combo", "key", "i", "j").sortWithinPartitions("combo", "key", "i", "j"), radius)


def _grouped(df: DataFrame, id_col: str, text: str, radius: int) -> DataFrame:
    """(id, v, fp, c, component_id) of every row: v tells texts of one id apart, c (a fingerprint) the groups."""
    docs = df.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text)).alias("v"), quoted(text).alias("text"))
    fps = cut(fingerprints(docs, "text", ["id", "v"]))
    reps = cut(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("least")))
    comps = components(link_fingerprints(reps.select("fp", F.col("fp").alias("id")), reps.count(), radius))
    by_fp = reps.join(comps, reps["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    lows = by_fp.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = met_by(by_fp, lows, ["c"]).select("fp", "c", "component_id")  # a large group is a hot key
    return fps.join(by_fp, "fp", "left").select("id", "v", "fp", "c", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable over links."""
    return _grouped(df, id_col, text, radius).drop("v", "c")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies: the smallest id and, of several texts of it in the group, the one with the smallest hash.

    Rows with a null id stay; so do equal rows of the document that stays.
    """
    rows = cut(_grouped(df.filter(quoted(id_col).isNotNull()), id_col, text, RADIUS).select("id", "v", "c", "component_id").distinct())
    least = rows.filter("id = component_id")
    several = least.groupBy("c").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")  # an id with near copies of its own
    again = least.join(several, "c").filter("v > least")
    gone = rows.filter("id <> component_id").select("id", "v").unionByName(again.select("id", "v"))
    gone = cut(gone.select(F.col("id").alias("__id"), F.col("v").alias("__v")))
    keyed = df.withColumn("__key", quoted(id_col).cast("long")).withColumn("__version", F.xxhash64(quoted(text)))
    some, none = split_by_bitmap(keyed, ["__key", "__version"], id_bitmap(gone, ["__id", "__v"]))  # other rows are not shuffled
    kept = some.join(gone, (F.col("__key") == F.col("__id")) & (F.col("__version") == F.col("__v")), "left_anti")
    return kept.unionByName(none).select(*map(quoted, df.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), unsigned_key("fp").alias("fingerprint"), "component_id")
