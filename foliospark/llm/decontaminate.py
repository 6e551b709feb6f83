"""Benchmark decontamination with an FM-index per training shard.

The phrases are the 13-word windows of the benchmark items (an item of fewer words is one
phrase).  A shard is a slice of documents inside one task.  Its words are numbered by the
phrases' vocabulary; a word outside it can be in no occurrence, so runs of such words become one
separator and runs shorter than the shortest phrase go.  Over what is left stand a suffix array,
the Burrows-Wheeler transform in a wavelet matrix with rank counts, and suffix positions sampled
every SAMPLE.  All phrases are searched backwards at once through the ranks; each occurrence is
located by stepping to a sampled position; hit words are merged per document.  No row leaves its
task, so nothing is shuffled and no key is hot.

The phrases are broadcast in blocks of about BLOCK_BYTES of benchmark text, as word numbers and the
places where phrases begin, some five times that size; a larger benchmark takes one pass per block,
whose word spans are then merged by id and text (two hashes).  Either way every row is judged by its
own text, whatever rows share its id or have none.  A word is one of the vocabulary where its bytes
are; its XXH64 only says where to look.

Null texts have no words; items with a null id or no word are ignored; items that repeat an id count
once, with the windows of all their texts.  A single item longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import cut, map_texts, quoted, read, rest
from foliospark.llm.words import ALNUM, LOWER, equal_spans, exact_numbers, find_words, text_buffers

WIDTH, SAMPLE, BLOCK_BYTES, SHARD_BYTES, RUN = 13, 8, 8 << 20, 8 << 20, 1 << 20
_FILTER_BITS = 22
FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")] + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
_SPANS = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


class Wavelet:
    """Wavelet matrix over integers with vectorised access and rank."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.bits = len(values), max(1, int(sigma).bit_length())
        self.levels = []
        now = values
        for b in range(self.bits - 1, -1, -1):
            bit = (now >> b) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view("<u8")
            count = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = int(len(bit) - bit.sum())
            self.levels.append((packed, count, zeros))
            now = np.concatenate([now[~bit], now[bit]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, count, _ = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return count[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of `value` before position `at`, elementwise."""
        lo, hi = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for k, level in enumerate(self.levels):
            one = (value >> (self.bits - 1 - k)) & 1 == 1
            lo1, hi1 = self._ones(level, lo), self._ones(level, hi)
            lo = np.where(one, level[2] + lo1, lo - lo1)
            hi = np.where(one, level[2] + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value at each position, its rank before that position)."""
        value, lo, hi = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for level in self.levels:
            one = (level[0][hi >> 6] >> (hi & 63).astype(np.uint64)) & np.uint64(1) == 1
            value = value * 2 + one
            lo1, hi1 = self._ones(level, lo), self._ones(level, hi)
            lo = np.where(one, level[2] + lo1, lo - lo1)
            hi = np.where(one, level[2] + hi1, hi - hi1)
        return value, hi - lo


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Order of all suffixes (the shorter of two equal beginnings first), by prefix doubling."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], values[order][1:] != values[order][:-1]]))
    width = 1
    while n and rank[order[-1]] < n - 1:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        width *= 2
    return order


class FMIndex:
    """Backward search and sampled location over a sequence of integers from 1 to sigma, 0 separating runs."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n = len(values)
        order = suffix_array(values)
        last = values[order - 1]
        last[order == 0] = sigma + 1  # what stands before the first position is no value of the text
        self.wave = Wavelet(last, sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=sigma + 2))])
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.number = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, number: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases number[start:start + size] that occur."""
        live = np.arange(len(start))
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), self.n, dtype=np.int64)
        for k in range(size - 1, -1, -1):
            c = number[start[live] + k].astype(np.int64)
            lo, hi = self.before[c] + self.wave.rank(c, lo), self.before[c] + self.wave.rank(c, hi)
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            if not len(live):
                break
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix of each row, by steps back to a sampled one."""
        out, at, left, steps = np.empty(len(rows), dtype=np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(left):
            known = self.sampled[at]
            out[left[known]] = self.positions[self.number[at[known]]] + steps
            left, at = left[~known], at[~known]
            c, r = self.wave.access(at)
            at = self.before[c] + r + (c == 0)  # the separator at the end is the first of its kind and no row's past
            steps += 1
        return out


def distinct_runs(numbers: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The number of each run numbers[start:start + size] among the distinct ones: words are taken in one by one, so runs are compared exactly."""
    kind = np.zeros(len(start), dtype=np.int64)
    top = int(numbers.max(initial=0)) + 1
    for k in range(size):
        _, kind = np.unique(kind * top + numbers[start + k], return_inverse=True)
    return kind


@dataclass
class Phrases:
    """Distinct windows of benchmark items by length, with the items of each."""

    vocabulary: np.ndarray  # sorted word hashes (two words may share one); word number = place + 1
    letters: np.ndarray  # the bytes of the vocabulary's words, one after the other
    edges: np.ndarray  # where each word begins in them, and their end
    maybe: np.ndarray  # low hash bits that some vocabulary word has
    numbers: np.ndarray  # word numbers of all items, one after the other
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # (length, where each phrase begins, first owner of each, owners)
    items: list[str]
    shortest: int

    @classmethod
    def of(cls, items: list[tuple[str, str]], width: int = WIDTH) -> Phrases:
        data, offsets = text_buffers(pa.array([t for _, t in items], pa.large_string()))
        words = find_words(data, offsets, ALNUM, LOWER)
        low = LOWER[data]
        exact = exact_numbers(low, words.start, words.end, words.hashes[1])
        _, model = np.unique(exact, return_index=True)
        order = np.argsort(words.hashes[1][model], kind="stable")
        place_of = np.empty(len(model), dtype=np.int32)
        place_of[order] = np.arange(1, len(model) + 1)
        numbers, model = place_of[exact], model[order]
        vocabulary, size = words.hashes[1][model], words.end[model] - words.start[model]
        edges = np.concatenate([[0], np.cumsum(size)])
        letters = low[np.repeat(words.start[model] - edges[:-1], size) + np.arange(int(edges[-1]))]
        maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        maybe[(vocabulary & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        names = sorted({i for i, _ in items})
        place = {name: k for k, name in enumerate(names)}
        owner = np.array([place[name] for name, _ in items], dtype=np.int64)
        count = words.counts
        groups = []
        for size in np.unique(np.minimum(count[count > 0], width)).tolist():
            some = np.flatnonzero(np.minimum(count, width) == size)
            n = count[some] - size + 1
            start = np.repeat(words.first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            kind = distinct_runs(numbers, start, size)
            pair = np.unique(kind * len(names) + np.repeat(owner[some], n))  # an item owns a phrase once
            _, first = np.unique(kind, return_index=True)
            groups.append((size, start[first], np.searchsorted(pair // len(names), np.arange(len(first) + 1)), (pair % len(names)).astype(np.int32)))
        return cls(vocabulary, letters, edges, maybe, numbers, groups, names, min((g[0] for g in groups), default=0))

    def number(self, data: np.ndarray, words) -> np.ndarray:
        """Numbers of the words of texts, compared in lower case; 0 for a word in no phrase."""
        hashes = words.hashes[1]
        out = np.zeros(len(hashes), dtype=np.int64)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[some])
        low = LOWER[data]
        while len(some):  # more than once only where words of the vocabulary share a hash
            there = np.minimum(at, len(self.vocabulary) - 1)
            met = (at < len(self.vocabulary)) & (self.vocabulary[there] == hashes[some])
            some, at = some[met], at[met]
            size = words.end[some] - words.start[some]
            right = self.edges[at + 1] - self.edges[at] == size
            near = np.flatnonzero(right)
            right[near] = equal_spans(low, words.start[some[near]], self.letters, self.edges[at[near]], size[near])
            out[some[right]] = at[right] + 1
            some, at = some[~right], at[~right] + 1
        return out


def occurrences(phrases: Phrases, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over one shard's words by number: (first word, word after the last) of each occurrence; (row, item number) pairs."""
    none = np.zeros(0, dtype=np.int64)
    if not phrases.groups:
        return none, none, none, none
    inside = np.flatnonzero(number)
    if not len(inside):
        return none, none, none, none
    row = np.searchsorted(first, inside, side="right") - 1
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (np.diff(inside) > 1) | (np.diff(row) > 0)
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(inside)]]))
    long = size >= phrases.shortest
    begin, size = begin[long], size[long]
    width = max(g[0] for g in phrases.groups)
    if len(size) and size.max() > RUN:  # very long runs become overlapping ones, so an index stays small
        parts = [(b + k, min(RUN, s - k)) for b, s in zip(begin.tolist(), size.tolist(), strict=True) for k in range(0, max(1, s - width + 1), RUN - width + 1)]
        begin, size = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    starts, ends, rows, items = [], [], [], []
    at = 0
    while at < len(size):  # indexes of about RUN words
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:] + 1), RUN, side="right")) + at)
        b, s = begin[at:to], size[at:to]
        at = to
        place = np.cumsum(s + 1) - s - 1  # where each run begins; a separator ends it
        values, word = np.zeros(int((s + 1).sum()), dtype=np.int64), np.zeros(int((s + 1).sum()), dtype=np.int64)
        inner = np.repeat(b - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        spot = np.repeat(place - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        values[spot], word[spot] = number[inside[inner]], inside[inner]
        index = FMIndex(values, len(phrases.vocabulary))
        for length, begins, owner_at, owners in phrases.groups:
            which, lo, hi = index.search(phrases.numbers, begins, length)
            n = hi - lo
            hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            which = np.repeat(which, n)
            where = word[index.locate(hit)]
            starts.append(where)
            ends.append(where + length)
            met = np.unique((np.searchsorted(first, where, side="right") - 1) * len(begins) + which)  # a text names a phrase's owners once
            which = met % len(begins)
            k = owner_at[which + 1] - owner_at[which]
            take = np.repeat(owner_at[which] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            rows.append(np.repeat(met // len(begins), k))
            items.append(owners[take].astype(np.int64))
    if not starts:
        return none, none, none, none
    pair = np.unique(np.concatenate(rows) * (len(phrases.items) + 1) + np.concatenate(items))
    return np.concatenate(starts), np.concatenate(ends), pair // (len(phrases.items) + 1), pair % (len(phrases.items) + 1)


def merged(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words that any span covers."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _columns(n_words, n_hit, items: list[list[str]]) -> dict[str, pa.Array]:
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array(sha, pa.string()),
        "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words), pa.bool_()),
    }


def _scan(phrases: Phrases, data: np.ndarray, offsets: np.ndarray):
    words = find_words(data, offsets, ALNUM, LOWER)
    start, end, row, item = occurrences(phrases, phrases.number(data, words), words.first)
    hit = merged(start, end, len(words.start))
    items: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    for r, i in zip(row.tolist(), item.tolist(), strict=True):
        items[r].append(phrases.items[i])
    return words, hit, items


def _blocks(benchmark: DataFrame, id_col: str, text: str) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(number of blocks, items) of about BLOCK_BYTES each; only one block is collected at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("item is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("item"), F.lit(n))
    for k in range(n):
        yield n, [(r["item"], r["text"]) for r in items.filter(block == k).distinct().collect()]


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", carry: list[str] | None = None, clean_only: bool = False) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to every row (columns of these names are replaced).

    With clean_only the table's own columns of the rows that are not contaminated return instead.
    """
    spark = df.sparkSession
    version = {"__h1": F.xxhash64(F.col(text)), "__h2": F.xxhash64(F.lit(1), F.col(text))}
    parts: list[DataFrame] = []
    for n, items in _blocks(benchmark, item_col, text):
        shared = spark.sparkContext.broadcast(Phrases.of(items))

        def fn(_, data, offsets, shared=shared):
            words, hit, items = _scan(shared.value, data, offsets)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
            got = _columns(words.counts, n_hit, items)
            return {"__keep": pa.array(~np.asarray(got["contaminated"].to_numpy(zero_copy_only=False)))} if clean_only else got

        if n == 1 and clean_only:
            return map_texts(df, fn, [T.StructField("__keep", T.BooleanType())], text, keep="__keep", limit=SHARD_BYTES)
        base = rest(df, *(f.name for f in FIELDS))
        if n == 1:
            return map_texts(base, fn, FIELDS, text, carry, limit=SHARD_BYTES)

        def spans(_, data, offsets, shared=shared):
            words, hit, items = _scan(shared.value, data, offsets)
            lists = [np.flatnonzero(hit[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            return {"n_words": pa.array(words.counts, pa.int64()), "spans": pa.array(lists, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}

        keyed = df.select(F.col(id_col).alias("__id"), *(h.alias(k) for k, h in version.items()), F.col(text).alias("text"))
        parts.append(cut(map_texts(keyed, spans, _SPANS, "text", ["__id", *version], limit=SHARD_BYTES)))
        shared.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hits = every.groupBy("__id", *version).agg(
        F.max("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set("spans")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hits = hits.select("__id", *version, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hits = hits.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    def with_hits(rows: DataFrame, hits: DataFrame, how: str) -> DataFrame:
        same = [rows[id_col].eqNullSafe(hits["__id"]), *(h == hits[k] for k, h in version.items())]
        return rows.join(hits, same, how)

    if clean_only:
        return with_hits(df, hits.filter("contaminated").select("__id", *version), "left_anti")
    base = rest(df, *(f.name for f in FIELDS)) if carry is None else df.select(*map(quoted, dict.fromkeys([*carry, id_col, text])))
    done = with_hits(base, hits, "left").drop("__id", *version)
    return done if carry is None or text in [*carry, id_col] else done.drop(text)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"])
