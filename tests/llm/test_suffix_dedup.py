"""Suffix dedup against brute force, with and without crowded anchors; transforms and their merge against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import suffix_dedup
from foliospark.llm.bwt import Shard, merge, transform

DATA = "/root/testdata/sf0.001"


def brute(texts, width=200):
    """[(n_bytes, n_removed, n_spans, sha, kept)] of a list of bytes."""
    count = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - width + 1):
            if count[t[k : k + width]] > 1:
                edge[k] += 1
                edge[k + width] -= 1
        gone = np.cumsum(edge)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(1000)) for _ in range(n))


SHARED = prose(0, 60)
HARD = [
    (0, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "y" * 201), (5, "z" * 5000), (6, "ab" * 120), (7, "ab" * 120 + "c" + "ab" * 120), (8, prose(1, 30) + SHARED + prose(2, 30)), (9, SHARED + prose(3, 5)),
    (10, SHARED + SHARED), (11, "é" * 150), (12, "aé" * 150), (13, prose(4, 100)), (13, prose(4, 100)), (14, prose(5, 100)), (None, prose(5, 100)), (None, None), (15, prose(6, 100)), (15, prose(7, 100)), (16, "😀é\x00" * 300),
    (17, prose(8, 150_000)), (18, prose(9, 40) + prose(8, 150_000)[600_000:601_000] + prose(10, 40)), (19, "q" * 700_000), (20, "p" * 199 + "r" + "p" * 199),
]
CLASH = ["1 AS n_bytes", "'x' AS t1", "2 AS T2", "array(1) AS __spans", "'k' AS kept_sha256", "null AS lang", "3 AS `a.b`", "4 AS anchor"]


def results(df, key):
    rows = df.collect()
    return sorted(((r[key], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept_bytes"])) for r in rows), key=str)


@pytest.mark.parametrize("crowd", [None, 0])
def test_hard_cases_by_brute_force(spark, crowd):
    df = spark.createDataFrame(HARD, "doc_id long, text string").selectExpr("doc_id", "text", *CLASH).repartition(3)
    want = [(i, *got) for (i, _), got in zip(HARD, brute([(t or "").encode() for _, t in HARD]), strict=True)]
    assert results(suffix_dedup.remove_repeats(df, crowd=crowd), "doc_id") == sorted(want, key=str)


@pytest.mark.parametrize("crowd", [None, 3])
def test_documents_by_brute_force(spark, crowd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = [(r["doc_id"], *got) for r, got in zip(rows, brute([(r["text"] or "").encode() for r in rows]), strict=True)]
    assert results(suffix_dedup.remove_repeats(docs, crowd=crowd), "doc_id") == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


def test_query_is_the_operator(spark):
    got = suffix_dedup.op12_suffix_dedup(spark, DATA)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = [(r["doc_id"], *g[:4]) for r, g in zip(rows, brute([(r["text"] or "").encode() for r in rows]), strict=True)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_rows(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    assert results(suffix_dedup.remove_repeats(docs.filter("doc_id = 2")), "doc_id")[0][:4] == (2, 199, 0, 0)


def test_one_passage_in_front_of_many_texts(spark):
    """The passage's anchors are crowded: they hold one content a text."""
    texts = [SHARED[:150] + f" {k} " + prose(100 + k, 40) for k in range(120)] + [SHARED[:150] + " 7 " + prose(107, 40) + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((k, *g) for k, g in enumerate(brute([t.encode() for t in texts]))), key=str)
    for crowd in (None, 20):
        assert results(suffix_dedup.remove_repeats(df, crowd=crowd), "doc_id") == want


def test_units_cover_every_window_and_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(400))) for _ in range(60)] + [b"abc" * 400, b"z" * 900]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    begin, n, anchor, weight = suffix_dedup.units(data, offsets, 60, 20)
    row = np.searchsorted(offsets, begin, side="right") - 1
    seen, anchors = set(), {}
    for b, size, a, w, r in zip(begin.tolist(), n.tolist(), anchor.tolist(), weight.tolist(), row.tolist(), strict=True):
        own = [bytes(data[k : k + 60]) for k in range(b, b + size)]
        assert b + size - 1 + 60 <= offsets[r + 1] and size <= 41
        assert w == 2 or len(set(own)) == len(own)
        for k, window in zip(range(b, b + size), own, strict=True):
            assert k not in seen
            seen.add(k)
            assert anchors.setdefault(window, a) == a
    assert len(seen) == sum(max(0, len(t) - 59) for t in texts)


@pytest.mark.parametrize("seed", range(40))
def test_merged_intervals_are_the_equal_prefixes(seed):
    rng = random.Random(seed)
    width, alphabet = rng.choice([7, 8, 13, 14, 15, 20, 50]), rng.choice([b"a", b"ab", b"abcd", bytes(range(250, 256))])
    base = bytes(rng.choice(alphabet) for _ in range(200))
    pick = lambda: base[(a := rng.randrange(150)) : a + rng.randrange(60)] if rng.random() < 0.7 else bytes(rng.choice(alphabet) for _ in range(rng.randrange(60)))
    parts = [[pick() for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
    shards = [transform(np.frombuffer(b"".join(p), dtype=np.uint8), np.array([len(u) for u in p]), width) for p in parts]
    counts = [np.array([max(0, len(u) - width + 1) for u in p]) for p in parts]
    interval = {}
    for s, u, at, k in zip(*(x.tolist() for x in merge(shards, counts, width)), strict=True):
        interval.setdefault(k, []).append(parts[s][u][at : at + width])
    assert all(len(set(w)) == 1 and len(w[0]) == width for w in interval.values())
    assert len({w[0] for w in interval.values()}) == len(interval)
    assert sum(map(len, interval.values())) == sum(int(c.sum()) for c in counts)


def test_a_transform_holds_its_strings():
    """Byte by byte, the transform is that of sorted suffixes."""
    units = [b"banana", b"", b"bandana", b"banana"]
    got = transform(np.frombuffer(b"".join(units), dtype=np.uint8), np.array([len(u) for u in units]), 7)
    rows = sorted(([*u[k:], 256 + i], (i, k)) for i, u in enumerate(units) for k in range(len(u) + 1))
    assert isinstance(got, Shard)
    assert [int(b) for b, (_, (i, k)) in zip(got.bwt, rows, strict=True) if k] == [units[i][k - 1] for _, (i, k) in rows if k]
    assert got.starts.tolist() == [next(r for r, (_, x) in enumerate(rows) if x == (i, 0)) for i in range(len(units))]


def test_kept_bytes_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, SHARED, "a"), (2, SHARED + "!", "b")], "doc_id long, text string, tag string")
    got = suffix_dedup.remove_repeats(docs).orderBy("doc_id").select("tag", "n_removed", F.decode("kept_bytes", "UTF-8")).collect()
    assert [tuple(r) for r in got] == [("a", len(SHARED), ""), ("b", len(SHARED), "!")]
