"""The manifest against a plain version: every coordinate, nulls, ties, lone leaves and clashing names."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import merkle


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(nodes):
    """The last node, and each leaf's steps: nodes left and right of its way up."""
    steps, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for j in run:
                for k in own[j]:
                    steps[k].append(([nodes[i] for i in run if i < j], [nodes[i] for i in run if i > j]))
        own = [[k for j in run for k in own[j]] for run in runs]
        nodes = [hashed(*(nodes[j] for j in run)) for run in runs]
    return nodes[0], steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: tree([leaf(r, r["text"]) for r in groups[s]]) for s in order}
    root, above = tree([trees[s][0] for s in order]) if order else (None, [])
    for s, up in zip(order, above, strict=True):
        for r, own in zip(groups[s], trees[s][1], strict=True):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in own + up:
                node = hashed(*left, node, *right)
            yield r["doc_id"], leaf(r, r["text"]), trees[s][0], root, hashed(*(x for pair in own + up for side in pair for x in side)), node, node == root


def made(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({k: F.expr(v) for k, v in extra.items()})


def result(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op13_merkle_manifest(spark, str(tmp_path))


CASES = {
    "empty": [],
    "one": [(7, "a\nb", "en", "web", 3)],
    "nulls": [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "", None), (None, "x\n", None, None, 1), (3, "é\n😀", "fr", "é", 3)],
    "ties": [(5, "a\n", "en", "s", 2)] * 4 + [(5, "b", "en", "s", 1), (5, None, "en", "s", 1)],
    "runs": [(k, f"line {k}\nend", "en", f"s{k % 3 if k < 40 else 0}", k) for k in range(100)] + [(500 + k, "z" * 1000 * k + "\n", "de", f"t{k}", 1) for k in range(11)],
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_by_brute_force_and_by_sql(spark, tmp_path, case):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in CASES[case]]
    got = [tuple(r) for r in result(spark, tmp_path, made(spark, CASES[case])).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(merkle.oracle(6)).fetchall(), key=str) == sorted(got, key=str)


def test_columns_of_clashing_names_pass_by(spark, tmp_path):
    docs = made(spark, CASES["runs"], g="'x'", pos="1", n="2", id="3", node="'y'", kids="array(1)", steps="null", root="'q'", leaf="4", part="5")
    got = [tuple(r) for r in result(spark, tmp_path, docs).collect()]
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in CASES["runs"]]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_the_store_has_a_folder_a_level_and_every_coordinate_once(spark, tmp_path):
    docs = made(spark, [(k, "t", "en", "one" if k % 4 else "two", 1) for k in range(120)])
    merkle.manifest(docs, folder=f"{tmp_path}/store").collect()
    store = spark.read.parquet(*(f"{tmp_path}/store/rows/level={k}" for k in range(6)))
    sizes = {(r["g"], r["level"]): r["n"] for r in store.withColumn("level", F.regexp_extract(F.input_file_name(), r"level=(\d+)", 1).cast("int")).groupBy("g", "level").agg(F.countDistinct("pos").alias("n")).collect()}
    assert sizes == {("1one", k): n for k, n in enumerate((90, 30, 10, 4, 2, 1))} | {("1two", k): n for k, n in enumerate((30, 10, 4, 2, 1))}
