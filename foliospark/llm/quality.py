"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Lines (split at \\n, those without a word apart) carry binned features: length, punctuation, symbols,
capitals, digits, repeats.  The field is fitted on the driver to a bounded sample of labelled rows
(SAMPLE_ROWS ids, in hash order; a line takes its document's label), lines of long documents in chains
of CHAIN lines, of which a document gives at most SAMPLE_CHAINS, spread evenly over it.  An id that
some label calls bad is, and of several texts of an id the smallest counts.  Viterbi decoding then marks every line of every document, and the share of words
in content lines decides: a document is kept if the base rules pass and the share is at least
SHARE.  Counting and decoding are one Arrow pass over the documents with no shuffle.

Words and lines are equal where their bytes are (hashes only propose what repeats).  Nulls count as empty
texts, which fail the base rules; every row is judged by its own text.  With no labels (an empty table, or one
label only) the field keeps its zero weights, ties go to content, and the base rules decide alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import map_texts, read, rest
from foliospark.llm.words import PIECE, PLAIN, exact_numbers, find_words, mix

SAMPLE_ROWS, CHAIN, SAMPLE_CHAINS, SHARE = 4000, 64, 16, 0.5
MIN_WORDS = 50
#: Bytes of text that a task works on at once.
SLICE = 2 << 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
_HEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_CHAR = PLAIN & _HEAD
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in '.!?"']] = True

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]

#: Upper edges of the bins of each line feature.
EDGES = {
    "words": [3, 8, 20, 60, 200],
    "mean_chars": [3.0, 4.5, 6.0, 8.0],
    "symbols": [0.0, 0.02, 0.08, 0.2],
    "capitals": [0.02, 0.08, 0.3, 0.6],
    "digits": [0.0, 0.02, 0.1],
    "stops": [0.0, 0.05, 0.15, 0.4],
    "end": [0.5],
    "repeated": [0.0, 0.2, 0.5],
    "same_word": [0.0, 0.1, 0.5],
    "duplicate": [0.5],
}
_BASE = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])
N_FEATURES = int(_BASE[-1])


def _before(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of bytes of a class before each of some ascending positions, a piece of the text at a time."""
    out, total = np.empty(len(at), dtype=np.int64), 0
    for lo in range(0, len(data), PIECE):
        count = np.concatenate([[0], np.cumsum(table[data[lo : lo + PIECE]], dtype=np.int64)])
        a, b = np.searchsorted(at, [lo, lo + PIECE])
        out[a:b] = total + count[np.minimum(at[a:b] - lo, len(count) - 1)]
        total += int(count[-1])
    out[np.searchsorted(at, len(data)) :] = total
    return out


def _repeated(words, at: np.ndarray, data: np.ndarray, width: int = 3) -> np.ndarray:
    """Those of the windows that begin at words `at` whose bytes stand twice or more in their text."""
    inside = np.unique(at[:, None] + np.arange(width))
    number = exact_numbers(data, words.start[inside], words.end[inside], words.hashes[1][inside])
    top, kind = int(number.max(initial=0)) + 1, words.row[at]
    for k in range(width):
        _, kind = np.unique(kind * top + number[np.searchsorted(inside, at + k)], return_inverse=True)
    return at[np.bincount(kind)[kind] > 1] if len(at) else at


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[end] - total[start]


def _in_repeats(words, data: np.ndarray) -> np.ndarray:
    """Flags of the words in 3-word windows that stand twice or more in their text; windows are met in shares of about PIECE by hash."""
    hashes, row = words.hashes[1], words.row
    repeat = np.zeros(len(hashes), dtype=bool)
    n = max(0, len(hashes) - 2)
    keyed, shares = np.empty(n, dtype=np.uint64), n // PIECE + 1
    for lo in range(0, n, PIECE):
        h = hashes[lo : min(lo + PIECE, n) + 2]
        own = row[lo : lo + len(h) - 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keyed[lo : lo + len(h) - 2] = mix(mix(mix(h[:-2] ^ own) + h[1:-1]) + h[2:])
    for k in range(shares):
        at = np.flatnonzero(keyed % np.uint64(shares) == k) if shares > 1 else np.arange(n)
        at = at[row[at] == row[at + 2]]
        _, back, count = np.unique(keyed[at], return_inverse=True, return_counts=True)
        twice = _repeated(words, at[count[back] > 1], data)
        for j in range(3):
            repeat[twice + j] = True
    return repeat


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(counts by text; first line of each text; feature bins by line; words by line) of a batch of texts."""
    n = len(offsets) - 1
    words = find_words(data, offsets)
    hashes = words.hashes[1]
    repeat = _in_repeats(words, data)
    lines = find_words(data, offsets, _LINE)
    first_word = np.searchsorted(words.start, lines.start)
    last_word = np.searchsorted(words.start, lines.end)
    full = last_word > first_word
    start, end, row = lines.start[full], lines.end[full], lines.row[full]
    first_word, last_word = first_word[full], last_word[full]
    keyed = mix(lines.hashes[1][full] ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[back] > 1)
    number = exact_numbers(data, start[some], end[some], keyed[some])
    _, seen = np.unique(row[some] * (int(number.max(initial=0)) + 1) + number, return_index=True)
    dup = np.zeros(len(start), dtype=bool)
    dup[some] = True
    dup[some[seen]] = False
    within = lambda table: _before(table, data, end) - _before(table, data, start)
    counts = {
        "n_words": words.counts,
        "word_chars": np.diff(_before(_CHAR, data, offsets)),
        "n_symbols": np.diff(_before(_SYMBOL, data, offsets)),
        "n_dup_lines": np.bincount(row[dup], minlength=n),
        "n_repeat_words": np.bincount(words.row[repeat], minlength=n),
    }
    n_words = last_word - first_word
    chars = np.maximum(within(_CHAR), 1)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first_word] = False
    values = {
        "words": n_words,
        "mean_chars": chars / n_words,
        "symbols": within(_SYMBOL) / chars,
        "capitals": within(_UPPER) / chars,
        "digits": within(_DIGIT) / chars,
        "stops": within(_STOP) / n_words,
        "end": _END[data[words.end[last_word - 1] - 1]] if len(start) else np.zeros(0),
        "repeated": _between(repeat, first_word, last_word) / n_words,
        "same_word": _between(same, first_word, last_word) / n_words,
        "duplicate": dup,
    }
    bins = np.stack([_BASE[i] + np.searchsorted(e, values[k], side="left") for i, (k, e) in enumerate(EDGES.items())], axis=1) if len(start) else np.zeros((0, len(EDGES)), dtype=np.int64)
    return counts, np.searchsorted(row, np.arange(n + 1)), bins, n_words


class Field:
    """Two states: 0 boilerplate, 1 content; weights of bins by state, of transitions and of the first state."""

    def __init__(self):
        self.emit, self.step, self.start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.emit[bins].sum(axis=1)

    def fit(self, chains: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Field:
        """Gradient ascent on the mean log-likelihood of chains (bins by line, state), classes weighted alike."""
        if len({y for _, y in chains}) < 2:
            return self
        chains = sorted(chains, key=lambda c: -len(c[0]))
        size = np.array([len(b) for b, _ in chains])
        label = np.array([y for _, y in chains])
        weight = 0.5 / np.bincount(label, size, minlength=2)[label]
        # Lines lie by their place in the chain: all first lines, then all second ones of the chains that have one, ...
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        edge = np.concatenate([[0], np.cumsum(active)])
        owner = np.concatenate([np.arange(m) for m in active])
        place = np.concatenate([edge[:k] for k in size]) + np.repeat(np.arange(len(size)), size)
        bins = np.empty((int(edge[-1]), len(EDGES)), dtype=np.int64)
        bins[place] = np.concatenate([b for b, _ in chains])
        kinds, kind = np.unique(bins, axis=0, return_inverse=True)
        kind = kind.ravel()
        truth, line_weight = np.eye(2)[label[owner]], weight[owner]
        kept = np.bincount(label, weight * (size - 1), minlength=2)  # steps from a state to itself
        later = np.arange(edge[1], edge[-1])
        before = np.concatenate([later[:0], *(edge[t - 1] + np.arange(active[t]) for t in range(1, len(active)))])
        params = [self.emit, self.step, self.start]
        speed = [np.zeros_like(p) for p in params]
        for _ in range(rounds):
            score = self.emit[kinds].sum(axis=1)[kind]
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            now = ahead[: edge[1]] = score[: edge[1]] + self.start
            for t in range(1, len(active)):
                x = now[: active[t], :, None] + self.step
                now = ahead[edge[t] : edge[t + 1]] = np.logaddexp(x[:, 0], x[:, 1]) + score[edge[t] : edge[t + 1]]
            for t in range(len(active) - 2, -1, -1):
                ahead_of = slice(edge[t + 1], edge[t + 2])
                x = self.step + (score[ahead_of] + back[ahead_of])[:, None, :]
                back[edge[t] : edge[t] + active[t + 1]] = np.logaddexp(x[..., 0], x[..., 1])
            both = ahead + back
            norm = np.logaddexp(both[: edge[1], 0], both[: edge[1], 1])
            gap = (truth - np.exp(both - norm[owner][:, None])) * line_weight[:, None]
            g_emit = np.empty_like(self.emit)
            for y in (0, 1):
                by_kind = np.bincount(kind, gap[:, y], minlength=len(kinds))
                g_emit[:, y] = np.bincount(kinds.ravel(), np.repeat(by_kind, len(EDGES)), minlength=N_FEATURES)
            x = np.exp(ahead[before][:, :, None] + self.step + (score[later] + back[later])[:, None, :] - norm[owner[later]][:, None, None])
            g_step = np.diag(kept) - np.tensordot(line_weight[later], x, axes=1)
            for p, v, g in zip(params, speed, [g_emit, g_step, gap[: edge[1]].sum(axis=0)], strict=True):
                v *= 0.9
                v += rate * (g - ridge * p)
                p += v
        return self

    def decode(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Most likely state of each line (Viterbi); ties go to content."""
        n_lines, size = len(bins), np.diff(first)
        state = np.ones(n_lines, dtype=np.int8)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        if not len(order):
            return state
        score = self.scores(bins)
        at, size = first[order], size[order]
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # texts with more than t lines
        best = score[at] + self.start
        finals = best.copy()
        came = np.zeros((n_lines, 2), dtype=np.int8)
        for t in range(1, int(size[0])):
            m = int(active[t])
            x = best[:m, :, None] + self.step
            from_content = x[:, 1] >= x[:, 0]
            came[at[:m] + t] = from_content
            best = np.where(from_content, x[:, 1], x[:, 0]) + score[at[:m] + t]
            finals[:m] = best
        now = (finals[:, 1] >= finals[:, 0]).astype(np.int8)
        for t in range(int(size[0]) - 1, -1, -1):
            m = int(active[t])
            state[at[:m] + t] = now[:m]
            now[:m] = came[at[:m] + t, now[:m]]
        return state


def fit_field(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> Field:
    """The field fitted to the first `sample_rows` labelled rows in the order of a hash of their id."""
    known = labels.select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).collect()
    if not chosen:
        return Field()
    small = df.sparkSession.createDataFrame([(r["__id"], r["__y"]) for r in chosen], known.schema)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).join(F.broadcast(small), "__id")  # at most sample_rows ids
    rows = rows.groupBy("__id", "__y").agg(F.min("text").alias("text"))

    def fn(_, data, offsets):
        _, first, bins, _ = measure(data, offsets)
        return {"bins": pa.array([_sampled(bins[a:b]).astype(np.uint8).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())}

    got = map_texts(rows, fn, [T.StructField("bins", T.BinaryType())], "text", ["__id", "__y"], limit=SLICE).collect()
    chains = []
    for r in sorted(got, key=lambda r: (str(r["__id"]), r["bins"])):
        bins = np.frombuffer(r["bins"], dtype=np.uint8).reshape(-1, len(EDGES)).astype(np.int64)
        chains += [(bins[i : i + CHAIN], r["__y"]) for i in range(0, len(bins), CHAIN)]
    return Field().fit(chains)


def _sampled(bins: np.ndarray) -> np.ndarray:
    """The lines of a document's chains that the fit sees."""
    n = -(-len(bins) // CHAIN)
    if n <= SAMPLE_CHAINS:
        return bins
    at = np.arange(SAMPLE_CHAINS) * n // SAMPLE_CHAINS * CHAIN  # whole chains: the last is the only short one and is left out
    return bins[(at[:, None] + np.arange(CHAIN)).ravel()]


def _judge(field: Field, share: float):
    def fn(_, data, offsets):
        counts, first, bins, n_words = measure(data, offsets)
        content = np.concatenate([[0], np.cumsum(np.where(field.decode(bins, first) == 1, n_words, 0))])[first]
        total = np.concatenate([[0], np.cumsum(n_words)])[first]
        part = np.diff(content) / np.maximum(np.diff(total), 1)
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
        out = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
        return out | {"base_failed": pa.array(failed), "content_share": pa.array(part, pa.float64()), "kept": pa.array(~failed & (part >= share))}

    return fn


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """Adds the base counts, base_failed, content_share and kept to every row (columns of these names are replaced)."""
    field = fit_field(df, labels, id_col=id_col, text=text)
    return map_texts(rest(df, *(f.name for f in FIELDS)), _judge(field, share), FIELDS, text, carry, limit=SLICE)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows that the rules keep, with the table's own columns, in one pass."""
    judge = _judge(fit_field(df, labels, id_col=id_col, text=text), share)
    return map_texts(df, lambda *a: {"__keep": judge(*a)["kept"]}, [T.StructField("__keep", T.BooleanType())], text, keep="__keep", limit=SLICE)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )
