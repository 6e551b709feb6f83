"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on labelled rows outside the held-out fold (a bounded sample, SAMPLE_ROWS ids in hash order;
an id that some label calls toxic is, and of several texts of an id the smallest counts):
a word's log-odds between toxic and clean text under Dirichlet priors in two levels.  The first
PREFIX bytes of a word have log-odds under a prior centred on both classes together; a word
departs from those of its beginning as far as its own counts outweigh a prior of WORD_PRIOR
counts spread as in both classes, so unseen forms of a known stem score as the stem.  A word
counts once for each distinct pair of neighbours, so copies of a document add nothing.

Score: tokens with log-odds of at least LEAST keep them, every other token costs COST.  One linear scan
(Ruzzo and Tompa) over a text finds all maximal scoring segments; stretches without a scoring
token enter as one step.  Under clean text the best segment of n tokens follows an extreme-value
law with P(S > x) = 1 - exp(-K n exp(-lambda x)); lambda solves E[exp(lambda s)] = 1 over clean
tokens and K is fitted to the maxima of clean documents.  A segment is significant if its
expected number K n exp(-lambda S) is below EXPECT; the document adds up -ln of these, and a
logistic curve fitted to the sample turns the sum into a probability.

Null and empty texts have no segment and get the curve's lowest value.  Without labels of both
kinds every score is the share of toxic labels (0 without labels).  Every row gets the score of its
own text, repeated rows and null ids included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import cut, map_texts, read, rest
from foliospark.llm.words import ALNUM, LOWER, Words, find_words, mix, slices, text_buffers

SAMPLE_ROWS = 8000
PREFIX, BASE_PRIOR, WORD_PRIOR, LEAST, TOP, COST, EXPECT = 5, 500.0, 10.0, 1.5, 8.0, 0.15, 0.05
SURE, LEAST_COUNT = 3.0, 3
CUT_OFF = 0.7
#: Evidence beyond this adds nothing to a score.
TOO_SURE = 50.0
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_segments", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("segments", T.StringType())]


def stems(data: np.ndarray, words: Words) -> np.ndarray:
    """The first PREFIX bytes of each word, lower-cased, as an integer."""
    out = np.zeros(len(words.start), dtype=np.int64)
    for k in range(PREFIX):
        at = words.start + k
        inside = at < words.end
        out[inside] |= LOWER[data[at[inside]]].astype(np.int64) << (8 * k)
    return out


@dataclass
class Lexicon:
    """Scoring words and stems, and the law of their sums."""

    words: np.ndarray  # sorted word hashes with a score of their own
    word_scores: np.ndarray
    stems: np.ndarray  # sorted stem codes with a score
    stem_scores: np.ndarray
    rate: float = 1.0  # lambda
    share: float = 1.0  # K
    slope: float = 0.0
    base: float = 0.0  # logistic intercept
    flat: float | None = None  # the score of every text if nothing could be learnt

    def scores(self, data: np.ndarray, words: Words) -> np.ndarray:
        """Log-odds of each word that scores, 0 for the others."""
        out = np.zeros(len(words.start))
        for keys, values, codes in ((self.stems, self.stem_scores, stems(data, words)), (self.words, self.word_scores, words.hashes[1])):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                hit = keys[at] == codes
                out[hit] = values[at[hit]]
        return np.where(out >= LEAST, np.minimum(out, TOP), 0.0)


def segments(at: np.ndarray, score: np.ndarray, cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), tokens not in `at` costing `cost` each."""
    # Segments held so far: first and last token, sums before and after, and the nearest earlier one with a smaller sum
    # before.  A search follows these links only; what it passes over is never passed over again, so the scan is linear.
    firsts, lasts, lows, highs, links = [], [], [], [], []
    total, last = 0.0, None
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        if last is not None:
            total -= cost * (p - last - 1)
        last = p
        first, low, high = p, total, total + s
        total = high
        while True:
            k = len(lows) - 1
            while k >= 0 and lows[k] >= low:
                k = links[k]
            if k < 0 or highs[k] >= high:
                break
            first, low = firsts[k], lows[k]
            del firsts[k:], lasts[k:], lows[k:], highs[k:], links[k:]
        firsts.append(first)
        lasts.append(p)
        lows.append(low)
        highs.append(high)
        links.append(k)
    return [(a, b, hi - lo) for a, b, lo, hi in zip(firsts, lasts, lows, highs, strict=True)]


def _by_text(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray):
    """(words of the batch, segments by row for rows that have any)."""
    words = find_words(data, offsets, ALNUM, LOWER)
    score = lexicon.scores(data, words)
    hit = np.flatnonzero(score)
    edge = np.searchsorted(hit, words.first)
    found = {}
    for r in np.flatnonzero(np.diff(edge)).tolist():
        own = hit[edge[r] : edge[r + 1]]
        found[r] = segments(own - words.first[r], score[own])
    return words, found


def _evidence(lexicon: Lexicon, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
    """(sum of -ln expected number over significant segments, those segments)."""
    fixed = math.log(max(lexicon.share * n, 1e-12))
    sure = [s for s in found if fixed - lexicon.rate * s[2] < math.log(EXPECT)]
    return sum(lexicon.rate * s - fixed for _, _, s in sure), sure


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(sample: DataFrame) -> DataFrame:
    """(stem, word, toxic, clean): distinct contexts of each word by class, over (id, label, text)."""

    def run(batches):
        for batch in batches:
            label = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                words = find_words(part, offsets[lo : hi + 1] - offsets[lo], ALNUM, LOWER)
                h = words.hashes[1]
                if not len(h):
                    continue
                before, after = np.zeros_like(h), np.zeros_like(h)
                before[1:], after[:-1] = h[:-1], h[1:]
                firsts = words.first[:-1][words.counts > 0]
                before[firsts] = 0
                after[words.first[1:][words.counts > 0] - 1] = 0
                near = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(after))
                y = label[lo:hi][words.row]
                yield pa.RecordBatch.from_arrays([pa.array(stems(part, words)), pa.array(h.view(np.int64)), pa.array(near.view(np.int64)), pa.array(y.astype(np.int32))], names=["stem", "word", "near", "y"])

    rows = sample.select("label", "text").mapInArrow(run, "stem long, word long, near long, y int")
    once = rows.groupBy("stem", "word", "near").agg(F.max("y").alias("toxic"), (1 - F.min("y")).alias("clean"))
    return once.groupBy("stem", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _root(values: np.ndarray, prob: np.ndarray) -> float:
    """The positive root of sum(prob * exp(x * values)) = 1, for a negative mean and some positive value."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float((prob * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve: Newton steps with backtracking, a little ridge so that separable samples stay finite."""
    scale = max(float(x.max(initial=0.0)), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    ridge, w = np.array([1e-3, 1e-3]), np.zeros(2)
    loss = lambda v: float((np.logaddexp(0, z @ v) - y * (z @ v)).sum() + (ridge * v * v).sum() / 2)
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if now - loss(w) < 1e-10:
            break
        now = loss(w)
    return float(max(w[0], 0.0) / scale), float(w[1])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """The lexicon and its calibration from the first `sample_rows` labelled rows outside the held-out fold, in hash order."""
    spark = df.sparkSession
    none = np.zeros(0)
    empty = Lexicon(none.astype(np.uint64), none, none.astype(np.int64), none, flat=0.0)
    known = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("label")).filter("__id is not null and label in (0, 1)").groupBy("__id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).collect()
    if not chosen:
        return empty
    empty.flat = sum(r["label"] for r in chosen) / len(chosen)
    if empty.flat in (0.0, 1.0):
        return empty
    small = spark.createDataFrame([tuple(r) for r in chosen], known.schema)
    sample = df.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).join(F.broadcast(small), "__id")  # at most sample_rows ids
    sample = cut(sample.groupBy("__id", "label").agg(F.min("text").alias("text")))
    counts = cut(_counts(sample))
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return empty
    both = n1 + n0
    by_stem = counts.groupBy("stem").agg(F.sum("toxic").cast("double").alias("s1"), F.sum("clean").cast("double").alias("s0"))
    mean = (F.col("s1") + F.col("s0")) / both
    rate1, rate0 = (F.col("s1") + BASE_PRIOR * mean) / (n1 + BASE_PRIOR), (F.col("s0") + BASE_PRIOR * mean) / (n0 + BASE_PRIOR)
    spread = F.sqrt(1 / (F.col("s1") + BASE_PRIOR * mean) + 1 / (F.col("s0") + BASE_PRIOR * mean))
    by_stem = by_stem.withColumn("odds", F.log(rate1 / rate0)).withColumn("sure", F.col("odds") / spread)
    part = (F.col("toxic") + F.col("clean")) / (F.col("s1") + F.col("s0"))
    w1, w0 = (F.col("toxic") + WORD_PRIOR * part) / (F.col("s1") + WORD_PRIOR), (F.col("clean") + WORD_PRIOR * part) / (F.col("s0") + WORD_PRIOR)
    w_spread = F.sqrt(1 / (F.col("toxic") + WORD_PRIOR * part) + 1 / (F.col("clean") + WORD_PRIOR * part))
    by_word = counts.join(by_stem, "stem").withColumn("word_odds", F.col("odds") + F.log(w1 / w0))
    by_word = by_word.filter((F.col("toxic") + F.col("clean") >= LEAST_COUNT) & ((F.abs(F.log(w1 / w0)) >= 0.3) & (F.col("odds") >= LEAST) | (F.col("word_odds") >= LEAST) & (F.col("word_odds") / w_spread >= SURE)))
    top_words = by_word.select("word", "word_odds").collect()  # the sample's
    top_stems = by_stem.filter((F.col("odds") >= LEAST) & (F.col("sure") >= SURE) & (F.col("s1") + F.col("s0") >= LEAST_COUNT)).select("stem", "odds").collect()
    w = sorted((r["word"] % (1 << 64), r["word_odds"]) for r in top_words)
    s = sorted((r["stem"], r["odds"]) for r in top_stems)
    lexicon = Lexicon(np.array([a for a, _ in w], dtype=np.uint64), np.array([b for _, b in w], dtype=float), np.array([a for a, _ in s], dtype=np.int64), np.array([b for _, b in s], dtype=float))
    shared = spark.sparkContext.broadcast(lexicon)

    def sums(_, data, offsets):
        words, found = _by_text(shared.value, data, offsets)
        score = shared.value.scores(data, words)
        total = np.concatenate([[0.0], np.cumsum(score)])[words.first]
        hits = np.concatenate([[0], np.cumsum(score > 0)])[words.first]
        best = [max((s for _, _, s in found.get(r, [])), default=0.0) for r in range(len(offsets) - 1)]
        return {"n": pa.array(words.counts, pa.int64()), "hits": pa.array(np.diff(hits), pa.int64()), "gain": pa.array(np.diff(total), pa.float64()), "best": pa.array(best, pa.float64())}

    fields = [T.StructField("n", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("gain", T.DoubleType()), T.StructField("best", T.DoubleType())]
    clean = sorted(map(tuple, map_texts(sample.filter("label = 0"), sums, fields, "text", ["__id"]).collect()), key=str)  # a row an id; sums in one order
    shared.unpersist()
    n, hits, gain = (sum(r[k] for r in clean) for k in (1, 2, 3))
    mean_hit = gain / hits if hits else (LEAST + TOP) / 2
    prob = (hits + 1.0) / (n + 2.0)  # one more: a sample without a hit does not prove that there are none
    prob = min(prob, 0.5 * COST / (mean_hit + COST))  # keeps the mean step negative
    lexicon.rate = _root(np.array([-COST, mean_hit]), np.array([1 - prob, prob]))
    lexicon.share = (len(clean) + 1) / (sum(r[1] * math.exp(-lexicon.rate * r[4]) for r in clean) + 1)
    law = spark.sparkContext.broadcast(lexicon)

    def evidence(_, data, offsets):
        words, found = _by_text(law.value, data, offsets)
        x = [min(_evidence(law.value, found.get(r, []), int(words.counts[r]))[0], TOO_SURE) for r in range(len(offsets) - 1)]
        return {"x": pa.array(x, pa.float64())}

    got = sorted((r["x"], r["label"]) for r in map_texts(sample, evidence, [T.StructField("x", T.DoubleType())], "text", ["label"]).collect())
    law.unpersist()
    lexicon.slope, lexicon.base = _logistic(np.array([x for x, _ in got]), np.array([float(y) for _, y in got]))
    return lexicon


def toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds score, predicted, n_segments, n_tokens and segments ("first-last:score" of each significant passage, in words)."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def fn(_, data, offsets):
        lex = shared.value
        words, found = _by_text(lex, data, offsets)
        n = len(offsets) - 1
        score = np.full(n, 1 / (1 + math.exp(-lex.base)) if lex.flat is None else lex.flat)
        count, spans = np.zeros(n, dtype=np.int32), [""] * n
        if lex.flat is None:
            for r, segs in found.items():
                x, sure = _evidence(lex, segs, int(words.counts[r]))
                score[r] = 1 / (1 + math.exp(-(lex.slope * min(x, TOO_SURE) + lex.base)))
                count[r] = len(sure)
                spans[r] = " ".join(f"{a}-{b}:{s:.3f}" for a, b, s in sure)
        return {"score": pa.array(score), "predicted": pa.array((score >= CUT_OFF).astype(np.int32)), "n_segments": pa.array(count), "n_tokens": pa.array(words.counts, pa.int64()), "segments": pa.array(spans, pa.string())}

    return map_texts(rest(df, *(f.name for f in FIELDS)), fn, FIELDS, text, carry)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out third."""
    docs = read(spark, sf_dir, "documents")
    lexicon = fit(docs, read(spark, sf_dir, "labels"))
    return toxicity(docs, lexicon, carry=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_segments", "segments")
