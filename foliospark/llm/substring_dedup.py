"""Substring dedup: words inside 50-word windows that a smaller document has as well are removed.

Count-min prefilter.  Each window is filed under its anchor, the smallest number among the 25-word
runs in it, so equal windows have equal anchors and a window occurs no more often than its anchor.
The sketch has about CELL_BYTES bytes of text a cell and row, so its share of cells in use does not
grow with the corpus.  It consists of slices: an anchor's hash names its slice, and DEPTH cells in
it.  Every partition sketches the anchors of its documents (each once a document); partition
sketches travel as cell lists and are added up slice by slice.  A sketch only overestimates, so no
repeated window is lost; an anchor that stands alone passes by chance only (see README).

Asking the sketch.  Up to BROADCAST_BYTES, the cells counted twice or more are broadcast as a
bitmap, and units that are estimated single never leave their task.  A larger sketch stays dealt by
slice: the distinct anchors of the units travel to their slices, and units meet the anchors that
come back in a join.  Both give the same units.

Exact pass.  Consecutive windows of one anchor make a unit.  Units whose anchor is estimated
repeated are grouped by a hash of all their words and the smallest document of each is found with
map-side combining.  Other holders of the unit lose it whole.  Where one anchor has different
units, texts differ nearby, and the windows of each distinct unit's smallest document are grouped
one by one the same way.  Rows that meet carry hashes and positions, never texts; a hot passage
combines to one row per task.  Equality of words is equality of two XXH64 (seeds 1 and 2), that of
windows equality of a polynomial over each in the field of 2**61 - 1 elements, 122 bits in all.

Null texts have no words.  Every row is judged by its own text: equal rows of a doc_id are one
document, and rows of one doc_id with different texts lose nothing to one another, but each to the
documents of smaller ids.  Rows with a null id keep all words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import cut, id_bitmap, map_texts, met_by, quoted, read, rest, split_by_bitmap, total_bytes
from foliospark.llm.words import find_words, mix, slices, text_buffers, window_at, window_sums

WINDOW, ANCHOR = 50, 25
#: Rows of the sketch, bytes of text for each cell of a row, cells of a slice's row, and the largest bitmap that is broadcast.
DEPTH, CELL_BYTES, LOG2_SLICE, BROADCAST_BYTES = 4, 64, 19, 64 << 20
#: Bytes of text that a task works on at once, and anchors that it gathers before it sends cells on.
SLICE, GATHER = 2 << 20, 1 << 19
_BASES = (0xD6E8FEB86659FD93, 0xCA5A826395121157)
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    extra = width - span
    return np.minimum(x[: len(x) - extra], x[extra:]) if extra else x


class Anchored:
    """Windows of a batch of texts: first word, row and anchor of each, and hashes of word runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR, exact: bool = True):
        words = find_words(data, offsets, seeds=(1, 2) if exact else (1,))
        self.words, self.window = words, window
        self.sums = [window_sums(h, b) for h, b in zip(words.hashes.values(), _BASES, strict=True)] if exact else []
        n = len(words.start)
        none = np.zeros(0, dtype=np.int64)
        self.at, self.row, self.anchor = none, none, np.zeros(0, dtype=np.uint64)
        if n < window:
            return
        last = words.first[1:][words.row]  # where each word's text ends
        ok = np.arange(n - window + 1) + window <= last[: n - window + 1]
        # Equal runs need equal numbers and no more: sums of the hashes of neighbouring words do.
        hashes = words.hashes[1]
        pairs = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]), dtype=np.uint64)])
        grams = mix(pairs[anchor - 1 :] - pairs[: n - anchor + 1])
        self.at = np.flatnonzero(ok)
        self.row = words.row[self.at]
        self.anchor = sliding_min(grams, window - anchor + 1)[self.at]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(window_at(s, start, end, b).view(np.int64) for s, b in zip(self.sums, _BASES, strict=True))

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) indexes into the windows of each run of one anchor in one row."""
        if not len(self.at):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        first = np.flatnonzero(new)
        return first, np.concatenate([first[1:], [len(self.at)]])


def width_for(n_bytes: int) -> int:
    """Logarithm of the number of cells in a row of the sketch of so many bytes of text."""
    return max(10, math.ceil(math.log2(max(n_bytes, 1) / CELL_BYTES)))


def slices_of(anchors: np.ndarray, log2_width: int) -> np.ndarray:
    """The slice of each anchor."""
    high = log2_width - min(LOG2_SLICE, log2_width)
    return (mix(anchors + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - high)).astype(np.int64) if high else np.zeros(len(anchors), dtype=np.int64)


def cells(anchors: np.ndarray, log2_width: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of its slice."""
    low = min(LOG2_SLICE, log2_width)
    return [(mix(anchors + np.uint64(0x9E3779B97F4A7C15 * (r + 2) & (1 << 64) - 1)) >> np.uint64(64 - low)).astype(np.int64) for r in range(DEPTH)]


def _partition_sketches(df: DataFrame, window: int, anchor: int, log2_width: int) -> DataFrame:
    """(slice, row, cells) of every partition: its sketch, as each cell repeated as often as counted, twice at most."""
    low = min(LOG2_SLICE, log2_width)
    n_slices = 1 << (log2_width - low)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        place = slices_of(anchors, log2_width) << low
        for r, cell in enumerate(cells(anchors, log2_width)):
            cell += place
            cell.sort()
            keep = np.ones(len(cell), dtype=bool)
            keep[2:] = cell[2:] != cell[:-2]
            cell = cell[keep]
            some, at = np.unique(cell >> low, return_index=True)
            edge = np.append(at, len(cell))
            own = (cell & ((1 << low) - 1)).astype(np.uint32)
            for k in range(0, len(some), 1 << 12):  # a batch holds few slices, however many there are
                part = range(k, min(k + (1 << 12), len(some)))
                lists = [own[edge[i] : edge[i + 1]].tobytes() for i in part]
                yield pa.RecordBatch.from_arrays([pa.array(some[part.start : part.stop], pa.int64()), pa.array(np.full(len(part), r), pa.int32()), pa.array(lists, pa.binary())], names=["s", "r", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in slices(offsets, SLICE):
                a = Anchored(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window, anchor, exact=False)
                first, _ = a.units()
                if not len(first):
                    continue
                pair = np.stack([a.row[first].astype(np.uint64), a.anchor[first]])
                order = np.lexsort((pair[1], pair[0]))
                pair = pair[:, order]
                once = np.ones(len(order), dtype=bool)  # each anchor once a document
                once[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
                held.append(pair[1, once])
                size += int(once.sum())
                if size >= max(GATHER, 8 * n_slices):
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    return df.mapInArrow(run, "s long, r int, cells binary")


def _add_up(sketches: DataFrame, log2_width: int) -> DataFrame:
    """(slice, bitmap of the cells counted twice or more, row after row) over all partitions; a task holds one slice at a time."""
    low = min(LOG2_SLICE, log2_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def done():
            bits = b"".join(np.packbits(row > 1, bitorder="little").tobytes() for row in count)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits], pa.binary())], names=["s", "bits"])

        for batch in batches:
            for s, r, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield done()
                    now, count = s, np.zeros((DEPTH, 1 << low), dtype=np.uint8)
                cell, times = np.unique(np.frombuffer(cell, dtype=np.uint32), return_counts=True)
                count[r, cell] = np.minimum(count[r, cell] + times, 2)
        if now is not None:
            yield done()

    return sketches.repartition("s").sortWithinPartitions("s").mapInArrow(run, "s long, bits binary")


def passes(bits: np.ndarray, anchors: np.ndarray, log2_width: int, place: np.ndarray | int = 0) -> np.ndarray:
    """Which anchors have all their cells in the bitmap (slices, DEPTH, bytes); `place` is the slice of each."""
    out = np.ones(len(anchors), dtype=bool)
    for r, cell in enumerate(cells(anchors, log2_width)):
        some = np.flatnonzero(out)
        where = place[some] if isinstance(place, np.ndarray) else place
        out[some] = (bits[where, r, cell[some] >> 3] >> (cell[some] & 7).astype(np.uint8)) & 1 == 1
    return out


def _shape(log2_width: int) -> tuple[int, int, int]:
    low = min(LOG2_SLICE, log2_width)
    return 1 << (log2_width - low), DEPTH, (1 << low) // 8


def _units(docs: DataFrame, window: int, anchor: int, log2_width: int, bitmap=None) -> DataFrame:
    """(id, v, anchor, slice, k1, k2, first word, windows) of every unit, or of those whose anchor passes the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets, SLICE):
                a = Anchored(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window, anchor)
                first, end = a.units()
                place = slices_of(a.anchor[first], log2_width)
                if bitmap is not None:
                    some = passes(bitmap.value, a.anchor[first], log2_width, place)
                    first, end, place = first[some], end[some], place[some]
                begin = a.at[first]
                k1, k2 = a.hashes(begin, a.at[end - 1] + window) if len(first) else (begin, begin)
                own = begin - a.words.first[a.row[first]]
                row = pa.array(a.row[first] + lo)
                cols = [ids.take(row), versions.take(row), pa.array(a.anchor[first].view(np.int64)), pa.array(place), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(own.astype(np.int32)), pa.array((end - first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "anchor", "s", "k1", "k2", "at", "n"])

    return docs.select("id", "v", "text").mapInArrow(run, "id long, v long, anchor long, s long, k1 long, k2 long, at int, n int")


def _ask_slices(anchors: DataFrame, sketch: DataFrame, log2_width: int) -> DataFrame:
    """The rows (anchor) of (anchor, s) whose anchors pass the sketch's slices: both are dealt by slice, the bitmap before its anchors."""
    shape = _shape(log2_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, now = None, None
        for batch in batches:
            place, given = batch.column(0).to_numpy(), batch.column(1)
            asked = np.asarray(batch.column(2).fill_null(0)).view(np.uint64)
            heads = np.flatnonzero(np.asarray(given.is_valid()))
            edge = [0, *heads.tolist(), len(place)]
            for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                if k:
                    now, bits = place[a], np.frombuffer(given[a].as_py(), dtype=np.uint8).reshape(1, *shape[1:])
                    a += 1
                if a < b and bits is not None:
                    own = asked[a:b][place[a:b] == now]
                    own = own[passes(bits, own, log2_width)]
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["anchor"])

    none = F.lit(None)
    met = sketch.select("s", "bits", none.cast("long").alias("anchor")).unionByName(anchors.select("s", none.cast("binary").alias("bits"), "anchor"))
    return met.repartition("s").sortWithinPartitions("s", F.col("bits").isNull(), "anchor").mapInArrow(run, "anchor long")


def repeated_units(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, log2_width: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """(id, v, anchor, k1, k2, at, n) of the units whose anchor the count-min sketch estimates repeated."""
    log2_width = width_for(total_bytes(docs, "text")) if log2_width is None else log2_width
    shape = _shape(log2_width)
    sketch = _add_up(_partition_sketches(docs.select("text"), window, anchor, log2_width), log2_width)
    if math.prod(shape) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        bits = np.zeros(shape, dtype=np.uint8)
        for row in sketch.toLocalIterator():
            bits[row["s"]] = np.frombuffer(row["bits"], dtype=np.uint8).reshape(shape[1:])
        return cut(_units(docs, window, anchor, log2_width, docs.sparkSession.sparkContext.broadcast(bits)).drop("s"))
    units = cut(_units(docs, window, anchor, log2_width))
    repeated = _ask_slices(units.select("anchor", "s").distinct(), sketch, log2_width)
    return cut(met_by(units.drop("s"), repeated, ["anchor"]))


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(id, v, k1, k2, at) of each window of the runs that each row of (id, v, text, runs) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets, SLICE):
                words = find_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], seeds=(1, 2))
                sums = [window_sums(h, b) for h, b in zip(words.hashes.values(), _BASES, strict=True)]
                runs = batch.column(3).slice(lo, hi - lo)
                size = np.diff(runs.offsets.to_numpy())
                flat = runs.flatten()
                row = np.repeat(np.arange(hi - lo), size)
                at, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
                row, n_before = np.repeat(row, n), np.cumsum(n) - n
                own = np.repeat(at - n_before, n) + np.arange(int(n.sum()))
                begin = own + words.first[row]
                k1, k2 = (window_at(s, begin, begin + window, b).view(np.int64) for s, b in zip(sums, _BASES, strict=True))
                which = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([ids.take(which), versions.take(which), pa.array(k1), pa.array(k2), pa.array(own.astype(np.int32))], names=["id", "v", "k1", "k2", "at"])

    return docs.select("id", "v", "text", "runs").mapInArrow(run, "id long, v long, k1 long, k2 long, at int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, log2_width: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """(id, v, at, n): runs of n consecutive windows, from word `at`, that a document of a smaller id has as well."""
    units = repeated_units(docs, window, anchor, log2_width, broadcast_bytes)
    least = units.groupBy("k1", "k2").agg(F.min("id").alias("least"))
    marked = cut(met_by(units, least, ["k1", "k2"]).select("id", "v", "anchor", "k1", "k2", "at", "n", "least"))
    copies = marked.filter("id > least").select("id", "v", "at", "n")
    # Anchors with different units: only there can a window be shared without its unit.
    mixed = units.groupBy("anchor").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d")).filter("a <> b or c <> d").select("anchor")
    ask = met_by(marked.filter("id = least"), mixed, ["anchor"]).groupBy("id", "v").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    ask = cut(ask)
    asked, _ = split_by_bitmap(docs, ["id", "v"], id_bitmap(ask, ["id", "v"]))  # texts that no window is asked of are not shuffled
    rows = cut(_window_rows(asked.join(ask.hint("shuffle_hash"), ["id", "v"]), window))
    first = rows.groupBy("k1", "k2").agg(F.min("id").alias("least"))
    single = met_by(rows, first, ["k1", "k2"]).filter("id > least").select("id", "v", "at", F.lit(1).alias("n"))
    return copies.union(single)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, log2_width: int | None = None, broadcast_bytes: int | None = None, carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by one space) to every row.

    `log2_width` and `broadcast_bytes` replace the sketch's size and the bound of its broadcast; neither changes a result.
    """
    key, version = quoted(id_col).cast("long"), F.xxhash64(quoted(text))
    docs = df.select(key.alias("id"), version.alias("v"), quoted(text).alias("text"))
    spans = repeated_spans(docs.filter("id is not null"), window, anchor, log2_width, broadcast_bytes)
    spans = spans.groupBy("id", "v").agg(F.collect_set(F.struct("at", "n")).alias("__spans")).withColumnsRenamed({"id": "__id", "v": "__v"})
    fields = FIELDS + ([T.StructField("kept_text", T.StringType())] if with_text else [])
    base = rest(df, *(f.name for f in fields))
    carry = list(base.columns) if carry is None else carry
    # Only texts that may lose a word meet their spans in a shuffle; the others stay where they are.
    spans = cut(spans)
    keyed = base.select(*map(quoted, dict.fromkeys([*carry, id_col, text])), key.alias("__key"), version.alias("__version"))
    some, none = split_by_bitmap(keyed, ["__key", "__version"], id_bitmap(spans, ["__id", "__v"]))
    met = some.join(spans.hint("shuffle_hash"), (some["__key"] == spans["__id"]) & (some["__version"] == spans["__v"]), "left").select(*map(quoted, keyed.columns), "__spans")
    joined = met.unionByName(none.withColumn("__spans", F.lit(None).cast(spans.schema["__spans"].dataType)))

    def fn(batch, data, offsets):
        raw = data.tobytes()
        given = batch.column(batch.schema.get_field_index("__spans"))
        n_words, n_removed, sha, kept_text = [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = raw[a:b].split()
            n_words.append(len(words))
            if given[i].is_valid:
                flat = given[i].values
                at, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + window - 1, minlength=len(words) + 1)
                gone = np.cumsum(edge[: len(words)]) > 0
                words = [words[k] for k in np.flatnonzero(~gone)]
            n_removed.append(n_words[-1] - len(words))
            kept = b" ".join(words)
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode() if with_text else None)
        out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha)}
        return out | ({"kept_text": pa.array(kept_text, pa.string())} if with_text else {})

    # The spans ride along only to the function; they are no column of the result.
    out = map_texts(joined, fn, fields, text, [*carry, "__spans"], limit=SLICE)
    return out.drop("__spans")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed words of every document, windows of 50 words."""
    return remove_repeats(read(spark, sf_dir, "documents"), carry=["doc_id"], with_text=False)
