"""Hard-negative mining by dual-tree search over anchors and candidates.

Vectors are rounded to integers, so scores are exact.  Rows are dealt into cells: a group of
anchors (GROUP of them at most, drawn by hash) and a share of all candidates.  A task takes the
cells one after the other: the anchors of a cell are bulk-loaded into a ball tree, in the order of
label and of the signs at fixed random planes; so is each Arrow batch of candidates.  Both trees go
down together.  The inner products of a pair of nodes lie in the interval of their centres, radii
and largest norms; pairs whose interval misses what the anchor node still asks for, or whose labels
cannot fit, are dropped with all the anchors below.  Leaf pairs are scored exactly, best interval
first, and every found row raises what its anchor asks for.  A task returns at most k rows a
question, and a window over them gives the best k of all.  So the work in the worst case (vectors
without structure in many dimensions) is every anchor against every row in blocks, and nothing but
a question's best rows leaves a task.

Two searches follow one another: the best POSITIVES rows of the same label (score from below only),
then for every distinct positive score p the best NEGATIVES rows of another label within
50 p <= 100 n <= 95 p.

Rows with a null label, a null vector, a null or non-finite component (also once scaled) or a null
id take no part.  Equal rows count once; rows of one id with different labels or vectors are rows
of their own, and of rows that are equal in score and id the one found is any, as their ids are
equal.  Missing components of shorter vectors count as zero.  Scores are exact up to 2**53, and are
doubles beyond, shown as the nearest long.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import cut, quoted, read

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95
#: Anchors of a cell at most, candidates of a cell at least, rows of a tree's leaf, planes of the order.
GROUP, CELL, LEAF, PLANES = 1 << 18, 512, 128, 24
_FAR = 2.0**1000


def unpacked(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """Rows of packed components as floats (whole numbers)."""
    if not dims:
        return np.zeros((len(column), 0))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), dims).astype(np.float64)


class Tree:
    """A ball tree over rows in order: leaves of one label and at most LEAF rows, two nodes under each node above."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        n = len(vectors)
        new = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]])) if n else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(new, n))
        lo = np.concatenate([np.arange(a, a + s, LEAF) for a, s in zip(new.tolist(), size.tolist(), strict=True)]) if n else new
        hi = np.append(lo[1:], n)
        parts = [(lo, hi, np.full((len(lo), 2), -1))]
        first = 0
        while len(parts[-1][0]) > 1:
            below = len(parts[-1][0])
            left = np.arange(0, below, 2)
            right = np.minimum(left + 1, below - 1)
            parts.append((parts[-1][0][left], parts[-1][1][right], np.stack([first + left, np.where(right > left, first + right, -1)], axis=1)))
            first += below
        self.lo, self.hi, self.kids = (np.concatenate([p[k] for p in parts]) for k in range(3))
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
        self.centre = (sums[self.hi] - sums[self.lo]) / np.maximum(self.hi - self.lo, 1)[:, None] if n else sums[:0]
        self.radius, self.norm = np.zeros(len(self.lo)), np.zeros(len(self.lo))
        for k, (a, b) in enumerate(zip(self.lo.tolist(), self.hi.tolist(), strict=True)):
            off = vectors[a:b] - self.centre[k]
            self.radius[k] = np.sqrt((off * off).sum(axis=1).max())
            self.norm[k] = norm[a:b].max()
        self.centre_norm = np.sqrt((self.centre * self.centre).sum(axis=1))
        self.label_lo = np.array([labels[a:b].min() for a, b in zip(self.lo.tolist(), self.hi.tolist(), strict=True)])
        self.label_hi = np.array([labels[a:b].max() for a, b in zip(self.lo.tolist(), self.hi.tolist(), strict=True)])
        self.top = len(self.lo) - 1


def interval(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between the rows of nodes i and of nodes j."""
    mid = np.einsum("ij,ij->i", a.centre[i], b.centre[j])
    off = a.radius[i] * b.centre_norm[j] + b.radius[j] * a.centre_norm[i] + a.radius[i] * b.radius[j]
    most = a.norm[i] * b.norm[j]
    slack = 1 + 1e-9 * (np.abs(mid) + off + most)
    return np.maximum(mid - off, -most) - slack, np.minimum(mid + off, most) + slack


class Questions:
    """An anchor group's tree and its questions: bounds of a score each, and the best k rows found so far."""

    def __init__(self, key, labels, vectors, low, high, k: int, same: bool):
        self.key, self.labels, self.vectors, self.k, self.same = key, labels, vectors, k, same
        self.tree = Tree(vectors, labels)
        self.low, self.high = low, high  # (anchors, questions); an unused question has low > high
        shape = (*low.shape, k)
        self.score, self.id = np.full(shape, -_FAR), np.zeros(shape, dtype=np.int64)
        self.count = np.zeros(low.shape, dtype=np.int64)
        self.need = np.where(low <= high, low, _FAR)  # the smallest score that may still enter
        self.node_low, self.node_high = (np.zeros(len(self.tree.lo)) for _ in range(2))
        for n in range(len(self.tree.lo)):
            self._settle(n)
            a, b = self.tree.lo[n], self.tree.hi[n]
            used = (low <= high)[a:b]
            self.node_high[n] = np.where(used, high[a:b], -_FAR).max(initial=-_FAR)

    def _settle(self, node: int) -> None:
        self.node_low[node] = self.need[self.tree.lo[node] : self.tree.hi[node]].min(initial=_FAR)

    def search(self, key, ids, labels, vectors) -> int:
        """Meets a batch of candidates, in the order of label, planes and id; returns the number of pairs scored."""
        other = Tree(vectors, labels)
        exact = vectors.shape[1] * np.abs(self.vectors).max(initial=0) * np.abs(vectors).max(initial=0)
        kind = np.float32 if exact < 1 << 24 else np.float64
        mine, theirs = self.vectors.astype(kind), vectors.astype(kind)
        i, j = (np.array([t.top], dtype=np.int64) for t in (self.tree, other))
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(i):
            lo, hi = interval(self.tree, i, other, j)
            keep = (hi >= self.node_low[i]) & (lo <= self.node_high[i])
            one = (self.tree.label_lo[i] == self.tree.label_hi[i]) & (other.label_lo[j] == other.label_hi[j]) & (self.tree.label_lo[i] == other.label_lo[j])
            keep &= (self.tree.label_lo[i] <= other.label_hi[j]) & (other.label_lo[j] <= self.tree.label_hi[i]) if self.same else ~one
            i, j, hi = i[keep], j[keep], hi[keep]
            leaf_i, leaf_j = self.tree.kids[i, 0] < 0, other.kids[j, 0] < 0
            done = leaf_i & leaf_j
            leaves.append((i[done], j[done], hi[done]))
            i, j, leaf_i, leaf_j = i[~done], j[~done], leaf_i[~done], leaf_j[~done]
            down = ~leaf_i & (leaf_j | (self.tree.hi[i] - self.tree.lo[i] >= other.hi[j] - other.lo[j]))
            kids = np.where(down[:, None], self.tree.kids[i], other.kids[j])
            given = kids >= 0
            kid, at = kids[given], np.nonzero(given)[0]
            i, j = np.where(down[at], kid, i[at]), np.where(down[at], j[at], kid)
        i, j, hi = (np.concatenate([x[k] for x in leaves]) for k in range(3))
        scored = 0
        for n in np.argsort(-hi, kind="stable").tolist():
            if hi[n] < self.node_low[i[n]]:
                continue
            a, b, c, d = int(self.tree.lo[i[n]]), int(self.tree.hi[i[n]]), int(other.lo[j[n]]), int(other.hi[j[n]])
            scores = mine[a:b] @ theirs[c:d].T
            scored += scores.size
            self._take(i[n], scores, a, key[c:d], ids[c:d])
        return scored

    def _take(self, node: int, scores: np.ndarray, a: int, key: np.ndarray, ids: np.ndarray) -> None:
        """Adds what a leaf pair found: scores of the node's anchors with candidates, whose labels fit as a whole."""
        changed = False
        b = a + len(scores)
        for q in range(self.low.shape[1]):
            need = self.need[a:b, q]
            hit = (scores >= need[:, None]) & (scores <= self.high[a:b, q][:, None])
            full = self.count[a:b, q] == self.k
            if full.any():  # a row as good as the last one enters by a smaller id only
                hit &= (scores > need[:, None]) | ~full[:, None] | (ids[None, :] < self.id[a:b, q, -1][:, None])
            row, col = np.nonzero(hit)
            if self.same and len(row):
                real = key[col] != self.key[a + row]
                row, col = row[real], col[real]
            if not len(row):
                continue
            changed = True
            found = np.unique(row)
            held = np.repeat(found, self.k)
            slot = np.tile(np.arange(self.k), len(found))
            used = slot < self.count[a + held, q]
            held, slot = held[used], slot[used]
            r = np.concatenate([held, row])
            s = np.concatenate([self.score[a + held, q, slot], scores[row, col].astype(self.score.dtype)])
            x = np.concatenate([self.id[a + held, q, slot], ids[col]])
            order = np.lexsort((x, -s, r))
            r, s, x = r[order], s[order], x[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            best = place < self.k
            r, s, x, place = a + r[best], s[best], x[best], place[best]
            self.score[r, q, place], self.id[r, q, place] = s, x
            np.maximum.at(self.count[:, q], r, place + 1)
            full = np.flatnonzero(self.count[a:b, q] == self.k) + a
            self.need[full, q] = self.score[full, q, -1]
        if changed:
            self._settle(node)

    def answers(self) -> pa.RecordBatch:
        """(anchor, question, id, score) of all that was found."""
        row, q, place = np.nonzero(np.arange(self.k)[None, None, :] < self.count[:, :, None])
        score = self.score[row, q, place]
        score = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score.tolist()]
        cols = [pa.array(self.key[row], pa.int64()), pa.array(q.astype(np.int32)), pa.array(self.id[row, q, place], pa.int64()), pa.array(score, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "question", "id", "score"])


def prepared(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: bool = False) -> tuple[DataFrame, str, int]:
    """(key, id, label, place, v) of the rows that take part, key telling rows apart; and how v is packed: kind and dimensions."""
    x = quoted(vector)
    whole = F.transform(x, lambda c: c.cast("double") * SCALE)
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(label).cast("long").alias("label"), whole.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    dims, most = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    dims, kind = dims or 0, "<i2" if (most or 0) < 32767 else "<f8"
    planes = np.random.default_rng(11).standard_normal((dims, PLANES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(np.asarray(lists.offsets))
            v = np.zeros((len(batch), dims))
            v[np.repeat(np.arange(len(batch)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.floor(np.asarray(lists.flatten(), dtype=np.float64))
            signs = (v @ planes > 0) if most < 2.0**500 else (np.sign(v) @ planes > 0)
            place = (signs.astype(np.int64) << np.arange(PLANES)[::-1]).sum(axis=1) if dims else np.zeros(len(batch), dtype=np.int64)
            packed = v.astype(kind)
            raw = [row.tobytes() for row in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64()), pa.array(raw, pa.binary())], names=["id", "label", "place", "v"])

    got = rows.mapInArrow(run, "id long, label long, place long, v binary").distinct()
    return cut(got.withColumn("key", F.monotonically_increasing_id())), kind, dims


def search(rows: DataFrame, asked: DataFrame, kind: str, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor, question, id, score, rank): of all rows the best k for every question.

    `asked` has (key, label, place, v, low, high): arrays with the least and the greatest score of
    each question.  same: rows of the anchor's label but itself, else rows of other labels.
    """
    spark = rows.sparkSession
    n, n_asked = rows.count(), asked.count()
    groups = max(1, -(-n_asked // GROUP))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(-(-n // CELL), -(-4 * parts // groups)))
    none = F.lit(None).cast("array<double>")
    spread = lambda x, m: F.pmod(F.xxhash64(x, F.lit(3)), F.lit(m))
    left = asked.select(spread("key", groups).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("c"), F.lit(False).alias("of_all"), "label", "place", F.col("key").alias("id"), "key", "v", "low", "high")
    right = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), spread("key", shares).alias("c"), F.lit(True).alias("of_all"), "label", "place", "id", "key", "v", none.alias("low"), none.alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, questions = None, None

        def built() -> Questions:
            t = pa.Table.from_batches(held).combine_chunks()
            width = max(1, int(np.diff(np.asarray(t["low"].chunk(0).offsets)).max(initial=1)))
            bounds = []
            for name, fill in (("low", _FAR), ("high", -_FAR)):
                lists = t[name].chunk(0)
                size = np.diff(np.asarray(lists.offsets))
                x = np.full((len(t), width), fill)
                x[np.repeat(np.arange(len(t)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
                bounds.append(x)
            return Questions(t["key"].to_numpy(), t["label"].to_numpy(), unpacked(t["v"], kind, dims), *bounds, k, same)

        for batch in batches:
            g, c, of_all = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            cell = np.stack([g, c, of_all])
            edge = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(edge, edge[1:], strict=False):
                part = batch.slice(a, b - a)
                if (g[a], c[a]) != now:
                    if questions is not None:
                        yield questions.answers()
                    now, questions, held = (g[a], c[a]), None, []
                if not of_all[a]:
                    held.append(part)
                elif held or questions is not None:
                    if questions is None:
                        questions, held = built(), []
                    ids, keys, labels = (part.column(part.schema.get_field_index(x)).to_numpy() for x in ("id", "key", "label"))
                    questions.search(keys, ids, labels, unpacked(part.column(part.schema.get_field_index("v")), kind, dims))
        if questions is not None:
            yield questions.answers()

    met = left.unionByName(right).repartition("g", "c").sortWithinPartitions("g", "c", "of_all", "label", "place", "id")
    found = met.mapInArrow(run, "anchor long, question int, id long, score long")
    best = Window.partitionBy("anchor", "question").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(df: DataFrame, every: int = 50, relabel: bool = False, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose id is divisible by `every`."""
    rows, kind, dims = prepared(df, id_col, vector, label, relabel)
    anchors = rows.filter(F.col("id") % every == 0).select("key", "label", "place", "v")
    whole = F.array(F.lit(-_FAR)), F.array(F.lit(_FAR / 2))
    positives = cut(search(rows, anchors.withColumn("low", whole[0]).withColumn("high", whole[1]), kind, dims, POSITIVES, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 50 p <= 100 n <= 95 p over whole numbers; a negative p has no n.
    low, high = F.expr(f"positive_score div 100 * {LOW} + (positive_score % 100 * {LOW} + 99) div 100"), F.expr(f"positive_score div 100 * {HIGH} + positive_score % 100 * {HIGH} div 100")
    scores = positives.filter("positive_score >= 0").select("anchor", "positive_score", low.cast("double").alias("low"), high.cast("double").alias("high")).distinct()
    scores = scores.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive_score", "low", "high"))).alias("s"))  # POSITIVES at most
    asked = cut(anchors.join(scores, anchors["key"] == scores["anchor"]).select("key", "label", "place", "v", F.col("s.low").alias("low"), F.col("s.high").alias("high"), "s.positive_score"))
    found = search(rows, asked.drop("positive_score"), kind, dims, NEGATIVES, False)
    named = asked.select(F.col("key").alias("anchor"), F.posexplode("positive_score").alias("question", "positive_score"))
    found = found.join(named, ["anchor", "question"]).join(positives, ["anchor", "positive_score"])
    ids = rows.filter(F.col("id") % every == 0).select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(ids, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every 50th row's first five positives."""
    return mine(read(spark, sf_dir, "embeddings"), relabel=True)


def oracle() -> str:
    return """WITH e AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
