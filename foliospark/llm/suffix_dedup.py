"""Suffix-array dedup: bytes inside strings of WINDOW bytes that start anywhere else as well are removed.

Units.  Every window (WINDOW consecutive bytes) is filed under its anchor, the smallest hash among
the GRAM-byte strings in it, so equal windows have equal anchors.  Consecutive windows of one anchor
make a unit.  Anchors that occur once in the corpus hold no repeated window; the units of the others
are candidates.  Equal units (BLAKE2b, 128 bits) are one content with a count, and one text that has
it stands for all, so that copies and hot passages are indexed once.

Transforms.  The contents' bytes are taken from those texts and dealt to buckets by a hash of the
anchor.  A bucket's bytes stream through a task, which builds the Burrows-Wheeler transform of every
SHARD bytes and keeps nothing else of them (see bwt); then it merges the transforms by refining an
interleave, without texts and without sorting all suffixes again.  Intervals of suffixes with equal
first WINDOW bytes whose contents count two or more are repeated.  Buckets hold about BUCKET bytes
however large the corpus is, and a task takes its buckets one after the other.

Crowded anchors (more than CROWD contents, such as a passage in front of ever different texts) would
make a bucket large.  Their windows become units of their own, filed under a hash of the whole window;
those that stay single there are dropped before their bytes travel, and equal ones are one content.

Results go from contents to all units, then to the texts that hold them.  Only texts that lose bytes
are shuffled.  Anchors only choose what meets; equality of windows is that of bytes inside a bucket,
of units BLAKE2b's, and texts are told apart by 120 bits of SHA-256.

A null text is empty.  Every row is a document, whatever its id: equal rows repeat each other, ids may
be null or repeat.  Texts of fewer bytes than WINDOW stay whole.  What is left may cut a character in
two, so it is binary.  Any bytes are allowed.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.bwt import merge, transform
from foliospark.llm.common import checkpoint_folder, cut, id_bitmap, map_texts, met_by, quoted, read, remove, rest, split_by_bitmap
from foliospark.llm.substring_dedup import sliding_min
from foliospark.llm.words import mix, slices, text_buffers

WINDOW, GRAM = 200, 64
#: Bytes of text hashed at once, bytes of a bucket and of a shard; contents of an anchor beyond which it is crowded, as they alone fill two buckets.
PIECE, BUCKET, SHARD, CROWD = 1 << 19, 1 << 20, 1 << 18, 8192
_BASE, _BASE_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FIELDS = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
KEY = ["anchor", "k1", "k2"]


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base & (1 << 64) - 1, dtype=np.uint64)]))


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of `width` bytes; hashes only choose anchors, so collisions cost time at most."""
    up, down = (_powers(b, len(data)) for b in (_BASE, _BASE_INVERSE))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * up[:-1], dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])


def units(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, windows, anchor, weight) of the units of some texts, worked on in pieces however long a text is.

    A unit's windows share one occurrence of their anchor.  Equal windows of one unit hold the anchor
    twice, so a unit with such a window weighs two, as if its anchor stood in two units.
    """
    most = window - gram + 1
    out = []
    for at in range(0, len(data), PIECE):
        stop = min(at + PIECE, len(data))
        a, b = np.searchsorted(offsets, at, side="right") - 1, np.searchsorted(offsets, stop, side="left")
        lo = np.clip(offsets[a:b], at, stop) - at
        hi = np.maximum(np.clip(offsets[a + 1 : b + 1] - window + 1, at, stop) - at, lo)
        edge = np.bincount(lo, minlength=stop - at + 1) - np.bincount(hi, minlength=stop - at + 1)
        valid = np.cumsum(edge[:-1]) > 0
        piece = data[at : min(stop + window - 1, len(data))]
        if len(piece) < window or not valid.any():
            continue
        # The low byte is the place: rising for the first occurrence of the smallest hash, falling for the last (most <= 256).
        hashes, place = grams(piece, gram) & ~np.uint64(255), np.arange(len(piece) - gram + 1, dtype=np.uint64) & np.uint64(255)
        low = sliding_min(hashes | place, most)[: stop - at]
        high = sliding_min(hashes | (np.uint64(255) - place), most)[: stop - at]
        valid = valid[: len(low)]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        gone = np.append(np.flatnonzero(valid[:-1] & ~valid[1:]) + 1, len(valid))
        end = np.minimum(np.append(first[1:], len(valid)), gone[np.searchsorted(gone, first, side="right")])
        twice = np.append(0, np.cumsum((low & np.uint64(255)) + (high & np.uint64(255)) != 255))
        out.append((first + at, end - first, (low[first] & ~np.uint64(255)).view(np.int64), 1 + (twice[end] > twice[first])))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))


def digests(raw: bytes | memoryview, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two longs for the bytes of each unit."""
    hashed = hashlib.blake2b
    got = b"".join([hashed(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)])
    return np.frombuffer(got, dtype="<i8").reshape(-1, 2)


def _text_key(text: F.Column) -> list[F.Column]:
    """(t1, t2), 60 bits each, from the SHA-256 of a text."""
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"t{k + 1}") for k in range(2)]


def _all_units(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(t1, t2, at, n, w, anchor, k1, k2) of every unit of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets, PIECE):
                part, edge = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                begin, n, anchor, weight = units(part, edge, window, gram)
                row = np.searchsorted(edge, begin, side="right") - 1
                key = digests(part.tobytes(), begin, n + window - 1)
                which = pa.array(row + lo)
                cols = [batch.column(0).take(which), batch.column(1).take(which), pa.array(begin - edge[row]), pa.array(n), pa.array(weight), pa.array(anchor), pa.array(key[:, 0]), pa.array(key[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "at", "n", "w", *KEY])

    return docs.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, at long, n long, w long, anchor long, k1 long, k2 long")


def _repeated(rows: DataFrame, weight: F.Column, store: _Store) -> DataFrame:
    """The rows whose anchor may weigh two or more; rows of single anchors stay where they are."""
    some = store.put(rows.groupBy("anchor").agg(F.sum(weight).alias("w")).filter("w > 1").select("anchor"))
    bitmap = id_bitmap(some, ["anchor"])
    left, _ = split_by_bitmap(rows, ["anchor"], bitmap)  # one in eight of the others passes by chance, and is found single later
    return met_by(left, some, ["anchor"]) if bitmap.rows is None else left


class _Seen:
    """Lets the first row of each key pass."""

    def __init__(self):
        self.keys: set[tuple[int, int]] = set()

    def fresh(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(key not in self.keys)
            self.keys.add(key)
        return batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


class _Store:
    """Tables of one run as Parquet in the shared folder; columns compress, so they take half of what checkpoints would."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{checkpoint_folder(spark)}/suffixes-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.parquet(f"{self.folder}/{self.n}")

    def clear(self) -> None:
        remove(self.spark, self.folder)


def _with_texts(docs: DataFrame, contents: DataFrame, store: _Store) -> DataFrame:
    """(t1, t2, text, wanted): the texts that stand for contents (t1, t2, at, n, ...), with the list of them; copies of a text from several tasks may meet."""
    own = [c for c in contents.columns if c not in ("t1", "t2")]
    wanted = store.put(contents.groupBy("t1", "t2").agg(F.collect_list(F.struct(*own)).alias("wanted")))  # as many as the text holds
    some, _ = split_by_bitmap(docs, ["t1", "t2"], id_bitmap(wanted, ["t1", "t2"]))


    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            yield seen.fresh(batch)

    some = some.mapInArrow(once, some.schema)  # a task sends each text once
    return some.join(wanted.hint("shuffle_hash"), ["t1", "t2"]).select("t1", "t2", "text", "wanted")


def _structs(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row of each, fields) of a column of lists of structs."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
    return row, {flat.type.field(k).name: np.asarray(flat.field(k)) for k in range(flat.type.num_fields)}


def _unit_bytes(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, anchor, k1, k2, n, c, data): the wanted contents' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in map(seen.fresh, batches):
            data, offsets = text_buffers(batch.column(2))
            row, f = _structs(batch.column(3))
            raw = memoryview(data)  # batches of whole texts are large: no copy
            begin = offsets[row] + f["at"]
            end = begin + f["n"] + window - 1
            for lo in range(0, len(row), 1 << 14):
                some = slice(lo, lo + (1 << 14))
                place = (mix(f["anchor"][some].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                parts = [bytes(raw[a:b]) for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(f[n][some]) for n in (*KEY, "n", "c")), pa.array(parts, pa.binary())], names=["bucket", *KEY, "n", "c", "data"])

    return texts.mapInArrow(run, "bucket long, anchor long, k1 long, k2 long, n long, c long, data binary")


class _Bucket:
    """The shards of a bucket so far, and the contents gathered for the next one."""

    def __init__(self, window: int):
        self.window, self.shards, self.meta, self.held, self.size, self.last = window, [], [], [], 0, None

    def add(self, meta: np.ndarray, data: pa.Array) -> None:
        """Contents in order of their keys: meta has anchor, k1, k2, n and c of each."""
        fresh = np.ones(meta.shape[1], dtype=bool)  # a content that two tasks took from copies of a text comes twice
        fresh[1:] = (meta[:3, 1:] != meta[:3, :-1]).any(axis=0)
        if self.last is not None and (meta[:3, 0] == self.last).all():
            fresh[0] = False
        self.last = meta[:3, -1]
        at = np.flatnonzero(fresh)
        self.held.append((meta[:, at], data.take(pa.array(at))))
        self.size += int(meta[3, at].sum()) + (self.window - 1) * len(at)
        if self.size >= SHARD:
            self.close()

    def close(self) -> None:
        """Builds the shard of what is gathered; from here on its bytes are held by its transform only."""
        meta = np.concatenate([m for m, _ in self.held], axis=1)
        raw = np.frombuffer(b"".join(x for _, d in self.held for x in d.to_pylist()), dtype=np.uint8)
        self.shards.append(transform(raw, meta[3] + self.window - 1, self.window))
        self.meta.append(meta)
        self.held, self.size = [], 0

    def repeated(self) -> pa.RecordBatch:
        """(anchor, k1, k2, at, n): runs of windows whose interval in the merged transforms weighs two or more."""
        if self.held:
            self.close()
        meta = np.concatenate(self.meta, axis=1)
        owner, string, offset, interval = merge(self.shards, [m[3] for m in self.meta], self.window)
        unit = np.cumsum([0, *(m.shape[1] for m in self.meta)])[owner] + string
        hit = np.bincount(interval, weights=meta[4][unit])[interval] > 1 if len(interval) else np.zeros(0, dtype=bool)
        unit, offset = unit[hit], offset[hit]
        by = np.lexsort((offset, unit))
        unit, offset = unit[by], offset[by]
        new = np.ones(len(unit), dtype=bool)
        new[1:] = (unit[1:] != unit[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(new)
        cols = [*(meta[k][unit[head]] for k in range(3)), offset[head], np.diff(np.append(head, len(unit)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*KEY, "at", "n"])


def _merged(contents: DataFrame, window: int, buckets: int) -> DataFrame:
    """(anchor, k1, k2, at, n): runs of repeated windows in contents; a task takes its buckets one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, None
        for batch in batches:
            place = batch.column(0).to_numpy()
            meta, data = np.stack([batch.column(k).to_numpy() for k in range(1, 6)]), batch.column(6)
            edge = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                if place[a] != now:
                    if bucket is not None:
                        yield bucket.repeated()
                    now, bucket = place[a], _Bucket(window)
                for lo in range(a, b, 512):
                    bucket.add(meta[:, lo : min(lo + 512, b)], data.slice(lo, min(lo + 512, b) - lo))
        if bucket is not None:
            yield bucket.repeated()

    parts = min(buckets, 4 * int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return contents.repartition(parts, "bucket").sortWithinPartitions("bucket", *KEY).mapInArrow(run, "anchor long, k1 long, k2 long, at long, n long")


def _contents(rows: DataFrame, weight: F.Column, store: _Store) -> DataFrame:
    """(anchor, k1, k2, c, t1, t2, at, n): every content once, with its count and a text that has it."""
    some = rows.groupBy(*KEY).agg(F.sum(weight).alias("c"), F.min(F.struct("t1", "t2", "at", "n")).alias("s"))
    return store.put(some.select(*KEY, "c", "s.*"))


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, k1, k2, c, t1, t2, at, n, p...): each window of the wanted contents as a unit of its own, filed under its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in map(seen.fresh, batches):
            data, offsets = text_buffers(batch.column(2))
            row, f = _structs(batch.column(3))
            raw = memoryview(data)  # batches of whole texts are large: no copy
            for lo in range(0, len(row), 1 << 10):
                some = slice(lo, lo + (1 << 10))
                n = f["n"][some]
                up = lambda x: np.repeat(x[some], n)  # noqa: B023, E731
                off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                key = digests(raw, np.repeat(offsets[row[some]], n) + up(f["at"]) + off, np.full(len(off), window))
                cols = [key[:, 0], key[:, 0], key[:, 1], up(f["c"]), up(f["o1"]), up(f["o2"]), up(f["at"]) + off, np.ones(len(off), dtype=np.int64), *(up(f[k]) for k in KEY), off]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*KEY, "c", "t1", "t2", "at", "n", "p0", "p1", "p2", "off"])

    return texts.mapInArrow(run, "anchor long, k1 long, k2 long, c long, t1 long, t2 long, at long, n long, p0 long, p1 long, p2 long, off long")


def _runs(docs: DataFrame, contents: DataFrame, window: int, store: _Store) -> DataFrame:
    """(anchor, k1, k2, at, n) of the contents: runs of windows that are repeated, by merged transforms."""
    size = contents.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    buckets = -(-size // BUCKET) or 1
    return _merged(_unit_bytes(_with_texts(docs, contents, store), window, buckets), window, buckets)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int | None = None) -> DataFrame:
    """(t1, t2, spans): runs (at, n) of n windows from byte `at` of the texts of (t1, t2, text) that start elsewhere as well."""
    store = _Store(docs.sparkSession)
    spans = _spans(docs, store.put(_all_units(docs, window, gram)), window, CROWD if crowd is None else crowd, store)
    spans = cut(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n")).alias("spans")))
    store.clear()
    return spans


def _spans(docs: DataFrame, rows: DataFrame, window: int, crowd: int, store: _Store) -> DataFrame:
    """(t1, t2, at, n) of every run of repeated windows in units."""
    held = _repeated(rows, F.col("w"), store)
    contents = _contents(held, F.lit(1), store)
    crowded = store.put(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > crowd).select("anchor"))
    if crowded.isEmpty():
        runs = _runs(docs, contents, window, store)
    else:
        runs = _runs(docs, contents.join(crowded, "anchor", "left_anti"), window, store)
        many = met_by(contents, crowded, ["anchor"]).withColumns({"o1": F.col("t1"), "o2": F.col("t2")})
        fine = store.put(_windows(_with_texts(docs, many, store), window).dropDuplicates(["p0", "p1", "p2", "off"]))
        fine = _repeated(fine, F.col("c"), store)
        single = _runs(docs, _contents(fine, F.col("c"), store), window, store).select(*KEY).distinct()
        back = met_by(fine.select(*KEY, "p0", "p1", "p2", "off"), single, KEY)
        runs = runs.unionByName(back.select(F.col("p0").alias("anchor"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("off").alias("at"), F.lit(1).cast("long").alias("n")))
    runs = store.put(runs.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("runs")))
    met = met_by(held.select("t1", "t2", F.col("at").alias("from"), *KEY), runs, KEY)
    return met.select("t1", "t2", "from", F.explode("runs").alias("r")).select("t1", "t2", (F.col("from") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"))


def remove_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int | None = None, carry: list[str] | None = None, with_bytes: bool = True) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with_bytes, kept_bytes to every row.

    `crowd` replaces the number of contents beyond which an anchor is crowded; it changes no result.
    """
    key = _text_key(quoted(text))
    docs = df.filter(F.octet_length(quoted(text)) >= window).select(*key, quoted(text).alias("text"))
    spans = repeated_spans(docs, window, gram, crowd).withColumnsRenamed({"t1": "__t1", "t2": "__t2", "spans": "__spans"})
    fields = FIELDS + ([T.StructField("kept_bytes", T.BinaryType())] if with_bytes else [])
    base = rest(df, *(f.name for f in fields), "__t1", "__t2", "__spans")
    carry = list(base.columns) if carry is None else carry
    own = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*carry, text]))}
    keyed = base.select(*[quoted(c).alias(name) for c, name in own.items()], *key)
    some, none = split_by_bitmap(keyed, ["t1", "t2"], id_bitmap(spans, ["__t1", "__t2"]))  # other texts are not shuffled
    met = some.join(spans.hint("shuffle_hash"), (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")), "left").select(*own.values(), "__spans")
    joined = met.unionByName(none.select(*own.values(), F.lit(None).cast(spans.schema["__spans"].dataType).alias("__spans")))

    def fn(batch, data, offsets):
        raw = memoryview(data.tobytes())
        given = batch.column(batch.schema.get_field_index("__spans"))
        removed, runs, sha, kept = [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            ranges = [(a, b)]
            if given[i].is_valid:
                flat = given[i].values
                at, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
                by = np.argsort(at, kind="stable")
                lo, hi = at[by], np.maximum.accumulate((at + n + window - 1)[by])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                ranges = list(zip([a, *(a + hi).tolist()], [*(a + lo).tolist(), b], strict=True))
            hashed = hashlib.sha256()
            for lo, hi in ranges:
                hashed.update(raw[lo:hi])
            left = sum(hi - lo for lo, hi in ranges)
            removed.append(b - a - left)
            runs.append(len(ranges) - 1)
            sha.append(hashed.hexdigest())
            kept.append(b"".join(raw[lo:hi] for lo, hi in ranges) if with_bytes else None)
        out = {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return out | ({"kept_bytes": pa.array(kept, pa.binary())} if with_bytes else {})

    got = map_texts(joined, fn, fields, own[text], [*(own[c] for c in carry), "__spans"], limit=2 << 20)
    return got.select(*[F.col(own[c]).alias(c) for c in carry], *(f.name for f in fields))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes of every document, strings of 200 bytes."""
    return remove_repeats(read(spark, sf_dir, "documents"), carry=["doc_id"], with_bytes=False)
