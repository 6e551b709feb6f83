"""Hard negatives against brute force: ties, copies, nulls, negative scores, several groups of anchors, and the bounds of node pairs."""

import math

import numpy as np
import pytest

from foliospark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{(anchor_id, positive_id, rank): (negative_id, positive_score, negative_score)} of distinct rows with distinct ids."""
    e = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
    out = {}
    for a in (i for i in e if i % 50 == 0):
        score = {i: sum(x * y for x, y in zip(e[a][1], v[1], strict=False)) for i, v in e.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if e[i][0] == e[a][0]][:5]:
            fit = [i for i in best if e[i][0] != e[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            for rank, i in enumerate(fit[:3], 1):
                out[a, p, rank] = (i, score[p], score[i])
    return out


def mined(df):
    rows = hn.mine(df, relabel=True).collect()
    got = {(r["anchor_id"], r["positive_id"], r["rank"]): (r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def table(kind):
    rng = np.random.default_rng(5)
    if kind == "clusters":  # tight groups far apart, as trees like them
        centres = rng.standard_normal((9, 16))
        return [(k, (centres[k % 9] + 0.1 * rng.standard_normal(16)).tolist(), int(rng.integers(4))) for k in range(900)]
    if kind == "ties":  # few values, so most scores tie; a third of all rows is one vector
        return [(k, [1.0, 1.0, 0.5] if k % 3 == 0 else rng.integers(-2, 3, 3).tolist(), int(rng.integers(3))) for k in range(700)]
    if kind == "lengths":
        return [(k, rng.standard_normal(int(rng.integers(0, 5))).tolist(), int(rng.integers(2))) for k in range(300)]
    if kind == "wide":  # past 32 bits: packed as doubles
        return [(k, (1000 * rng.standard_normal(8)).tolist(), int(rng.integers(3))) for k in range(400)]
    return [(50 * k, [float(k + 1), -1.0], k % 2) for k in range(12)] + [(1, [3.0, 1.0], 5)]


@pytest.mark.parametrize("kind", ["clusters", "ties", "lengths", "wide", "anchors"])
@pytest.mark.parametrize("group", [7, 1 << 18])
def test_negatives_by_brute_force(spark, monkeypatch, kind, group):
    monkeypatch.setattr(hn, "GROUP", group)
    rows = table(kind)
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows) != {}


def test_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None, 1), (50, [1.0, nan], 1), (100, [inf, 1.0], 1), (150, [1.0, None], 1), (200, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (250, [], 1), (300, [3e38, 3e38], 1), (301, [-3e38, 3e38], 1)]
    rows = [(k, [float(v) for v in row], label) for k, row, label in table("ties")]
    rows = [r for r in rows if r[0] % 50 or r[0] > 300] + odd
    clash = "1 AS key", "'x' AS id", "2 AS place", "null AS v", "array(1) AS low", "3 AS `a.b`", "4 AS anchor", "5 AS score", "6 AS rank"
    df = spark.createDataFrame(rows, SCHEMA)
    got = mined(df.selectExpr("*", *clash))
    want = brute(rows)
    assert {k: v for k, v in got.items() if abs(v[1]) < 1 << 53} == {k: v for k, v in want.items() if abs(v[1]) < 1 << 53} != {}
    assert not {50, 100, 150, 200, None} & {x for k, v in got.items() for x in (*k[:2], v[0])}
    assert mined(df.unionAll(df)) == got  # equal rows count once
    assert mined(df.limit(0)) == {}
    assert mined(df.filter("label IS NULL")) == {}


def test_intervals_hold_all_inner_products_and_prune():
    rng = np.random.default_rng(8)
    centres = 200 * rng.standard_normal((6, 32))
    x = np.floor(np.repeat(centres, 256, axis=0) + 5 * rng.standard_normal((1536, 32)))
    labels = np.repeat([0, 1], 768)
    tree = hn.Tree(x, labels)
    for i in range(len(tree.lo)):
        for j in range(len(tree.lo)):
            lo, hi = hn.interval(tree, np.array([i]), tree, np.array([j]))
            s = x[tree.lo[i] : tree.hi[i]] @ x[tree.lo[j] : tree.hi[j]].T
            assert lo[0] <= s.min() and s.max() <= hi[0]
    none = np.full((len(x), 1), -hn._FAR), np.full((len(x), 1), hn._FAR)
    key = np.arange(len(x))
    asked = hn.Questions(key, labels, x, *none, 3, True)
    assert asked.search(key, key, labels, x) < 0.5 * 2 * 768**2  # of the pairs with fitting labels
