"""Joins by range and as-of, roll-ups, sketches, changes, first rows of groups and stateful streams against plain versions."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.operators.nodes import NUMBER, parse_nodes
from foliospark.plans.analytics import document_sketches, estimated, merge_sketches, problem_cube, top_by_group
from foliospark.plans.changes import changes
from foliospark.plans.places import as_of_join, interval_join, node_intervals, nodes_at
from foliospark.streaming.documents import drained, newest_versions, problem_counts, problem_sessions


def each(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_by_brute_force(spark, how):
    rng = random.Random(3)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(300)]), k) for k in range(150)]
    lengths = [0, 1, 2, 3, 4, 5, 31, 32, 33, 64, 100, 5000]
    spans = [(rng.choice("ab"), s := rng.randrange(-50, 300), s + rng.choice(lengths), k) for k in range(120)] + [("a", None, 9, 1), ("a", 5, 2, 2)]
    want = []
    for g, at, k in points:
        held = [(s, e, n) for h, s, e, n in spans if g == h and at is not None and s is not None and s <= at < e]
        want += [(g, at, k, *x) for x in held] or ([(g, at, k, None, None, None)] if how == "left" else [])
    left, right = spark.createDataFrame(points, "g string, at int, k int"), spark.createDataFrame(spans, "g string, start int, stop int, n int")
    got = interval_join(left, right, ["g"], how=how)
    assert each(got) == sorted(want, key=str) and got.columns == ["g", "at", "k", "start", "stop", "n"]
    assert each(interval_join(left, right.limit(0), ["g"], how="left").select("k", "n")) == sorted(((k, None) for _, _, k in points), key=str)


def test_interval_join_has_no_nested_loop(spark):
    left, right = spark.range(9).selectExpr("id AS at", "id % 2 AS g"), spark.range(9).selectExpr("id % 2 AS g", "id AS start", "id + 3 AS stop")
    plan = interval_join(left, right, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_join_by_brute_force(spark):
    rng = random.Random(4)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)]), k) for k in range(120)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), f"v{k:03}", k) for k in range(50)]
    want = []
    for g, at, k in left:
        before = [(t, v, n) for h, t, v, n in right if h == g and t is not None and at is not None and t <= at]
        want.append((g, at, k, *(max(before)[1:] if before else (None, None))))
    got = as_of_join(spark.createDataFrame(left, "g string, at int, k int"), spark.createDataFrame(right, "g string, by int, v string, n int"), ["g"], "at", "by")
    assert each(got) == sorted(want, key=str) and got.columns == ["g", "at", "k", "v", "n"]


def test_the_deepest_node_holds_a_place(spark):
    source = "# A é *b*\n\n- c **d**\n\n{% x %}\ne\n{% /x %}\n"
    nodes = Engine(spark).parse(spark.createDataFrame([(1, source)], "doc_id long, source string"))
    number = nodes.first()[NUMBER]
    size = len(source.encode())
    got = {r["at"]: r["node_id"] for r in nodes_at(spark.createDataFrame([(number, k) for k in range(size + 2)], f"{NUMBER} long, at int"), nodes).collect()}
    spans = [tuple(r) for r in node_intervals(nodes).select("start", "stop", "depth", "node_id").collect()]
    for at in range(size + 2):
        held = [(d, n) for a, b, d, n in spans if a <= at < b]
        assert got[at] == (max(held)[1] if held else None)


def problems(spark):
    rng = random.Random(5)
    rows = [(d, d % 97, rng.choice("rst"), rng.choice(["error", "warning"]), rng.choice(["x", None])) for d in range(4000) for _ in range(rng.randrange(3))]
    return rows, spark.createDataFrame(rows, f"{NUMBER} long, doc_id long, error_id string, level string, name string")


def test_cube_by_brute_force(spark):
    rows, df = problems(spark)
    for cube in (False, True):
        want = set()
        for grain in range(8) if cube else (0, 1, 3, 7):
            keep = lambda r: tuple(None if grain >> (2 - k) & 1 else r[2 + k] for k in range(3))  # noqa: B023, E731
            for group in {keep(r) for r in rows}:
                own = [r for r in rows if keep(r) == group]
                want.add((*group, grain, len(own), len({r[0] for r in own})))
        assert {tuple(r) for r in problem_cube(df, cube=cube).collect()} == want


def test_merged_sketches_estimate_distinct_documents(spark):
    rng = random.Random(6)
    rows = [(d, rng.choice("rs"), rng.choice(["error", "warning"])) for d in range(30_000)] * 2
    df = spark.createDataFrame(rows, "doc_id long, error_id string, level string").repartition(4)
    days = [document_sketches(df.filter(F.col("doc_id") % 3 == k)) for k in range(3)] + [document_sketches(df.filter("doc_id < 9000"))]
    stored = days[0].unionByName(days[1]).unionByName(days[2]).unionByName(days[3])
    for by in (("error_id", "level"), ("level",)):
        exact = {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).agg(F.count_distinct("doc_id")).collect()}
        got = estimated(merge_sketches(stored, by)).collect()
        assert {tuple(r[b] for b in by) for r in got} == set(exact)
        assert all(abs(r["n_docs"] / exact[tuple(r[b] for b in by)] - 1) < 0.05 for r in got)  # three standard errors
    assert sum(r["n"] for r in merge_sketches(stored, ("level",)).collect()) == len(rows) + 18_000


def test_first_rows_of_groups_are_bounded_before_the_shuffle(spark):
    rng = random.Random(7)
    rows = [("hot" if k % 3 else f"g{k % 5}", rng.randrange(4), k) for k in range(600)]
    got = top_by_group(spark.createDataFrame(rows, "g string, n int, k int"), ["g"], [F.desc("n"), "k"], 3)
    want = [(g, n, k, i + 1) for g in {r[0] for r in rows} for i, (n, k) in enumerate(sorted(((n, k) for h, n, k in rows if h == g), key=lambda x: (-x[0], x[1]))[:3])]
    assert each(got) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")


def test_changes_by_comparing_subtrees(spark):
    pieces = ["a", "b", "- x\n- y", "- x\n- z", "> q\n>\n> r", "# h", "{% t n=1 %}\ni\n{% /t %}"]
    rng = random.Random(9)
    docs = [(k, "\n\n".join(rng.choice(pieces) for _ in range(rng.randrange(5))), "\n\n".join(rng.choice(pieces) for _ in range(rng.randrange(5)))) for k in range(40)] + [(None, "a", "a"), (99, "a", None), (98, None, "b")]
    df = spark.createDataFrame(docs, "doc_id long, old string, new string")
    states = [parse_nodes(df, source=s, digests=True) for s in ("old", "new")]
    got = {tuple(r) for r in changes(*states).select("doc_id", "change", "node_id", "n_nodes").collect()}
    want = set()
    for k, *_ in docs:
        old, new = ([r.asDict() for r in s.filter(F.col("doc_id").eqNullSafe(k)).orderBy("node_id").collect()] for s in states)

        def fresh(row, rows, known):
            return not any(r["digest"] in known for r in rows if row["node_id"] <= r["node_id"] <= row["last_desc"])

        had = {r["digest"] for r in old} if k is not None else set()
        has = {r["digest"] for r in new} if k is not None else set()
        at = {(r["digest"], r["place"]) for r in old}
        for rows, known, side in ((new, had, "new"), (old, has, "gone")):
            for r in rows:
                up = None if r["parent_id"] is None else rows[r["parent_id"]]
                if fresh(r, rows, known):
                    change = None if up is not None and fresh(up, rows, known) else side
                elif side == "gone":
                    change = None
                elif r["digest"] in known:
                    change = None if up is not None and up["digest"] in known else "kept" if (r["digest"], r["place"]) in at else "moved"
                else:
                    change = "changed"
                if change:
                    want.add((k, change, r["node_id"], r["last_desc"] - r["node_id"] + 1))
    assert got == want and {c for _, c, _, _ in got} == {"kept", "moved", "new", "changed", "gone"}


def streamed(spark, folder, batches, schema):
    """A stream that takes one batch after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for path in (folder / str(k)).glob("*.parquet"):
            (folder / "in").mkdir(exist_ok=True)
            os.utime(path, (1_700_000_000 + 60 * k,) * 2)
            path.rename(folder / "in" / f"{k}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_the_newest_version_wins_and_timers_end_documents(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [
        [("a", 1, at(0), "a1"), ("a", 3, at(1), "a3"), ("a", 2, at(1), "a2"), ("b", 5, at(0), "b5"), (None, 1, at(0), "x"), ("c", None, at(0), "y"), ("d", 1, at(0), None), ("d", 1, at(0), "d")],
        [("a", 2, at(2), "a2 again"), ("a", 4, at(2), "a4"), ("b", 5, at(1), "b5 again")],
        [("z", 1, at(100), "z1")],
        [("z", 2, at(101), "z2")],
        [("a", 1, at(102), "a new life")],
    ]
    stream = streamed(spark, tmp_path, batches, "doc_id string, version long, at timestamp, source string")
    got = drained(newest_versions(stream))
    want = [
        ("a", 3, "new", "a3"), ("a", 1, "late", "a1"), ("a", 2, "late", "a2"), ("b", 5, "new", "b5"), ("d", 1, "new", "d"), ("d", 1, "late", None), ("a", 2, "late", "a2 again"), ("a", 4, "newer", "a4"),
        ("b", 5, "late", "b5 again"), ("z", 1, "new", "z1"), ("z", 2, "newer", "z2"), ("a", 4, "ended", None), ("b", 5, "ended", None), ("d", 1, "ended", None), ("a", 1, "new", "a new life"),
    ]
    assert each(got.select("doc_id", "version", "status", "source")) == sorted(want, key=str)


def test_problems_in_sliding_and_session_windows(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    minutes = [0, 10, 25, 90, 100, 5000, 5001]
    stream = streamed(spark, tmp_path, [[("r", "error", at(m))] for m in minutes[:5]] + [[("r", "error", at(5000))], [("r", "error", at(5001))]], "error_id string, level string, at timestamp")
    sessions = drained(problem_sessions(stream, "at", ["error_id"]))
    assert each(sessions) == sorted([(at(0), at(55), "r", 3), (at(90), at(130), "r", 2)], key=str)
    slid = drained(problem_counts(stream, "at", window="1 hour", slide="30 minutes"))
    want = {w: sum(w <= m < w + 60 for m in minutes[:5]) for w in range(-30, 120, 30)}
    assert each(slid) == sorted([(at(w), "r", "error", n) for w, n in want.items() if n], key=str)
