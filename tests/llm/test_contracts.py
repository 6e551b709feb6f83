"""Every operator against its contract: brute force on small tables, and the hard cases of all of them.

The cases: nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
extra columns whose names clash with an operator's own.
"""

import hashlib
import itertools
import json
import random
import time
import zlib

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, license_scan, line_dedup, packing, quality, simhash, substring_dedup, token_counts, tool_calls, toxicity
from foliospark.llm.license_templates import templates
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(99, 70)
ITEM = prose(98, 20)
HARD = [
    (0, "Alpha beta\tgamma\x0bdelta  epsilon\nzeta"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, prose(1, 30) + " " + PASSAGE + " " + prose(2, 30)),
    (6, prose(3, 10) + "\n" + PASSAGE),
    (7, PASSAGE + " " + PASSAGE),
    (8, "é " * 60 + "😀 ñandú x ﬀ"),
    (9, prose(4, 200)),
    (10, prose(4, 200)),
    (11, prose(4, 199) + " changed"),
    (12, "a b c " * 100),
    (13, prose(5, 40) + " " + ITEM + " " + prose(6, 40)),
    (14, ITEM.upper() + "."),
    (15, "\n".join(["line one two", "line three four", "line five six"] * 5)),
    (16, prose(7, 30_000)),
    (17, "x" * 200_000),
    (18, prose(4, 200).upper()),
    (19, "\x00 <s> </s> <unk> ▁ <0x41>  two  spaces "),
    (20, "ALPHA BETA GAMMA"),
]
CLASH = ["1 AS n_words", "'x' AS fp", "'y' AS `ID`", "true AS kept", "2.5 AS score", "'z' AS Fingerprint", "3 AS n_lines", "array(1) AS n_tokens", "'q' AS dice", "null AS lang", "1 AS `a.b`"]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [*HARD, HARD[9], (None, prose(4, 200)), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *CLASH).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(k + 10**9, t) for k, t in HARD], "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(more)


@pytest.fixture(scope="module")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def by_id(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# ---- 1: licence scans


def dice(a, b):
    from collections import Counter

    x, y = (Counter(zip(w, w[1:], strict=False)) for w in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def test_licence_scan_by_brute_force(spark):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    known = [(name, split(text)) for name, _, text in templates()]
    rng = random.Random(5)
    docs = [(0, None), (1, ""), (2, "no licence at all here"), (3, templates()[0][2]), (4, "x\n" + templates()[5][2].upper() + "\n\ny z")]
    for k in range(5, 40):
        words = rng.choice(templates())[2].split()
        for _ in range(rng.randrange(0, max(2, len(words) // 8))):
            words[rng.randrange(len(words))] = rng.choice(["foo", "bar", words[0]])
        docs.append((k, "intro words\n\n" * (k % 3) + " ".join(words) + "\nmore" * (k % 2)))
    got = by_id(license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")), "n_templates", "template", "dice")
    for k, text in docs:
        text = text or ""
        units = [text, *text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text)]
        best = {name: max(dice(split(u), words) for u in units) for name, words in known}
        good = {n: d for n, d in best.items() if d >= license_scan.THRESHOLD}
        top = min(((-d, n) for n, d in good.items()), default=None)
        assert got[k][0] == len(good) and got[k][1] == (top[1] if top else None) and (top is None or got[k][2] == pytest.approx(-top[0]))


def test_licences_inside_longer_texts_by_brute_force(spark):
    known = {name: (licence, text) for name, licence, text in templates()}
    rng = random.Random(8)
    docs, expected = [], []
    for k, (name, size) in enumerate((n, s) for n in ("MIT/text/1", "BSD-2-Clause/text/1", "GPL-3.0/text/1", "GPL-3.0/notice/1", "MIT/notice/1") for s in (0, 1, 2)):
        words = known[name][1].split()
        a, b = len(words) // 3, 2 * len(words) // 3
        gap = ["\n\n", "\n", " "][size]  # over paragraphs, over lines, within a line of prose
        passage = gap.join([" ".join(words[:a]), " ".join(words[a:b]), " ".join(words[b:])])
        docs.append((k, f"{prose(rng.random(), 80)} {passage} {prose(rng.random(), 80)}"))
        expected.append((name, 1.0, known[name][0]))
    got = by_id(license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")), "template", "dice", "licenses")
    assert all(got[k][:2] == e[:2] and e[2] in got[k][2].split(",") for k, e in enumerate(expected))

    rows = [("x", "X", "a b a b a c"), ("y", "Y", "c d e c d e f a")]
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 60)))) for k in range(200)]
    got = by_id(license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), rows, 0.6), "n_templates", "template", "dice")
    for k, text in docs:
        words, best = text.split(), {}
        for name, _, body in rows:
            n = len(body.split())
            best[name] = max([dice(words, body.split()), *(dice(words[i : i + n], body.split()) for i in range(len(words) - n + 1))])
        if dice(words, rows[0][2].split()) < 0.6 and dice(words, rows[1][2].split()) < 0.6:  # no unit takes bigrams
            good = {n: d for n, d in best.items() if d >= 0.6}
            top = min(((-d, n) for n, d in good.items()), default=(None, None))
            assert got[k][:2] == (len(good), top[1]) and (not good or got[k][2] == pytest.approx(-top[0]))


def test_a_notice_in_prose_stands_beside_a_matching_unit(spark):
    text = f"{templates()[6][2]}\n{prose(1, 40)} licensed under\nthe MIT License. {prose(2, 40)}"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["licenses"] == "AGPL-3.0,GPL-2.0,GPL-3.0,LGPL-3.0,MIT" and row["template"] == "GPL-3.0/notice/1"


def test_full_licences_are_known_alone_inside_prose_and_with_changes(spark):
    full = [t for t in templates() if "/full/" in t[0]]
    assert {t[1] for t in full} == {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    rng, rows = random.Random(5), []
    for name, licence, text in full:
        words = text.split(" ")
        for k in rng.sample(range(len(words)), len(words) // 30):  # a changed word changes two bigrams
            words[k] += "x"
        other = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
        rows += [(name, licence, text), (name, licence, f"{other}\n{text}\n{other}"), (name, licence, " ".join(words)), (name, "", text[: len(text) // 2])]
    df = spark.createDataFrame(rows, "name string, licence string, text string")
    for r in license_scan.scan(df).collect():  # with the notices that stand inside some of them
        assert r["licence"] in ("", *r["licenses"].split(","))
    for r in license_scan.scan(df, full).collect():
        assert r["licence"] == "" or r["template"] == r["name"] and r["licence"] in r["licenses"].split(",") and r["dice"] >= 0.8
        assert r["licence"] or r["template"] != r["name"]


def test_licence_scan_hard_cases(spark, hard):
    got = license_scan.scan(hard)
    assert got.count() == hard.count() and set(hard.columns) - {"dice"} <= set(got.columns)
    assert got.filter("doc_id in (1, 2, 3) and (n_templates <> 0 or template is not null)").isEmpty()
    assert license_scan.scan(hard.limit(0)).isEmpty()


# ---- 2: SimHash


def test_fingerprints_and_components_by_brute_force(spark, corpus, texts):
    got = by_id(simhash.near_groups(corpus), "fp", "component_id", key="id")
    fps = {i: brute.fingerprint(t) for i, t in texts.items()}
    assert {i: f % (1 << 64) for i, (f, _) in got.items()} == fps
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {i: c for i, (_, c) in got.items()} == brute.components(ids, links)


def test_planted_links_at_the_radius_are_found_at_every_block_count(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(400)]
    rows = list(enumerate(base))
    for k, x in enumerate(base[:150]):
        for bits in (4, 5):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            rows.append((10_000 * bits + k, y))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    reps = spark.createDataFrame(signed, "id long, fp long")
    from foliospark.llm.graph import components

    links = [(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[n + 1 :] if (x ^ y).bit_count() <= 4]
    expected = {i: c for i, c in brute.components([i for i, _ in rows], links).items()}
    for n in (1 << 10, 1 << 24, 1 << 40):  # the number of fingerprints sets the number of blocks
        found = {r["node"]: r["component"] for r in components(simhash.link_fingerprints(reps, n)).collect()}
        assert {i: found.get(i, i) for i in expected} == expected


def test_a_crowded_shard_is_split_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(4)
    fps = sorted({(0xABC << 52) | sum(1 << b for b in rng.sample(range(40), 3)) for _ in range(150)})
    rows = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)]
    from foliospark.llm.graph import components

    links = [(a, b) for a, x in enumerate(fps) for b, y in enumerate(fps) if a < b and (x ^ y).bit_count() <= 4]
    found = {r["node"]: r["component"] for r in components(simhash.link_fingerprints(spark.createDataFrame(rows, "id long, fp long"), len(fps))).collect()}
    expected = brute.components(range(len(fps)), links)
    assert {i: found.get(i, i) for i in expected} == expected


def test_near_dedup_hard_cases(spark, hard):
    kept = simhash.near_dedup(hard)
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and 10 not in ids and 18 not in ids and 2 not in ids and ids.count(9) == 2
    assert simhash.near_dedup(hard.limit(0)).isEmpty()


def test_rows_of_one_id_have_the_component_of_their_own_text(spark):
    t, other, big = prose(41, 80), prose(42, 80), 2**62
    rows = [(5, t), (5, other), (7, other), (None, t), (None, prose(43, 9)), (None, None), (big + 1, t), (big + 3, prose(44, 60)), (big + 5, prose(44, 60)), (5, t), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_groups(df).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    component = {t: 5, other: 5, prose(44, 60): big + 3, None: 8, "": 8}
    expected = [(i, signed(brute.fingerprint(x)), None if i is None else component[x]) for i, x in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    kept = simhash.near_dedup(df).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr(r) for r in rows if r[0] is None or r[0] == component[r[1]])


# ---- 3: line dedup


def chunks(text, roll=line_dedup.ROLL, divisor=line_dedup.DIVISOR, longest=line_dedup.LONGEST):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    marked = lambda i: i >= roll and sum(h[i - 1 - k] * line_dedup.FACTOR**k for k in range(roll)) % divisor == 0
    ends = [i for i in range(1, len(lines) - 1) if marked(i) and not marked(i - 1)] + [len(lines)]
    out = []
    for begin, end in zip([0, *ends], ends, strict=False):
        while end - begin >= longest + 2:
            out.append(lines[begin : begin + longest])
            begin += longest
        out.append(lines[begin:end])
    return out


def line_rows(rows):
    """{(id, text): result} of rows (id, text); texts of one id in the order of Spark's hash."""
    order = lambda r: (r[0], (x := xxhash.xxh64_intdigest(r[1].encode(), 42)) - ((x >> 63) << 64))
    seen, out = set(), {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None and i is not None}, key=order):
        kept, n, removed, n_chunks = [], 0, 0, 0
        for c in chunks(text):
            n += len(c)
            body = "\n".join(c)
            if len(c) >= 2 and brute.words(body):
                if body in seen:
                    removed += len(c)
                    n_chunks += 1
                    continue
                seen.add(body)
            kept.append(body)
        out[i, text] = (n, removed, n_chunks, "\n".join(kept))
    return out


def line_result(docs):
    return {i: r for (i, _), r in line_rows(docs.items()).items()}


def test_line_dedup_by_brute_force(spark, corpus, texts):
    page = "\n".join(f"shared line {k} of a long notice" for k in range(30))
    more = {2 * 10**9 + k: f"start {k}\n" * (k % 3) + page + f"\nend {k}" for k in range(6)}
    docs = texts | more
    df = corpus.unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = by_id(line_dedup.dedup_lines(df), "n_lines", "n_removed_lines", "n_removed_chunks", "kept_text")
    expected = line_result(docs)
    assert {i: got[i] for i in expected} == expected
    assert sum(e[1] for i, e in expected.items() if i >= 2 * 10**9) > 60  # shifted copies fall into the same chunks
    assert all(got[i] == (0, 0, 0, None) for i, t in docs.items() if t is None)


def test_line_dedup_hard_cases(spark, hard):
    got = line_dedup.dedup_lines(hard)
    assert got.count() == hard.count() and set(got.columns) >= set(hard.columns)
    assert got.filter("doc_id is null and n_removed_lines <> 0").isEmpty()
    assert line_dedup.dedup_lines(hard.limit(0)).isEmpty()


IDENTITY = [(1, "t"), (2, "t"), (2, "other"), (2, "t"), (2, "other"), (None, "t"), (None, "other"), (2**62 + 1, "t"), (2**62 + 3, "mixed"), (3, None), (3, "")]


def identity_rows(t, other):
    """Rows of equal, null and large ids with equal and with different texts."""
    text = {"t": t, "other": other, "mixed": other + "\n" + t}
    return [(i, text.get(x, x)) for i, x in IDENTITY]


@pytest.mark.parametrize("collide", [False, True])
def test_line_dedup_keeps_rows_of_one_id_apart(spark, monkeypatch, collide):
    if collide:  # keys that stand for many bodies
        monkeypatch.setattr(line_dedup, "keys_of", lambda body: (F.pmod(F.xxhash64(body), F.lit(3)), F.lit(0).cast("long")))
    rows = identity_rows("\n".join(f"shared {k}" for k in range(9)), "\n".join(f"own {k % 5}" for k in range(20)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df).collect()
    expected = line_rows(rows)
    whole = lambda t: (0 if t is None else t.count("\n") + 1, 0, 0, t)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == (whole(r["text"]) if r["doc_id"] is None or r["text"] is None else expected[r["doc_id"], r["text"]])
    assert sum(e[1] for e in expected.values()) > 20


def test_texts_of_one_line_over_and_over_have_short_chunks(spark):
    df = spark.createDataFrame([(1, "same\n" * 50 + "end"), (2, "a\nb\n" * 40)], "doc_id long, text string")
    sizes = df.select(F.expr("doc_id"), F.explode(line_dedup.chunks_of(F.col("text"))).alias("c")).groupBy("doc_id").agg(F.max("c.n").alias("n")).collect()
    assert all(r["n"] <= line_dedup.LONGEST + 1 for r in sizes)


# ---- 4: tool calls


def test_tool_calls_are_linked_ordered_and_checked(spark):
    call = lambda i, turn, args, deps=(), name="search", conv=1: (conv, i, turn, name, args, list(deps))
    good = '{"limit": 3, "query": "x"}'
    calls = [
        call("a", 0, good),
        call("b", 1, '{"query":"é \\"q\\"","limit":"3"}', ["a"]),
        call("c", 2, '{"limit":1}', ["b", "a"]),
        call("d", 3, "not json", ["zz"]),
        call("e", 4, '{"limit":2,"query":"y","more":1}', ["f"]),
        call("f", 5, good, ["e"]),
        call("g", 6, good, name="nope"),
        call("a", 9, '{"limit":9,"query":"late"}'),
        call(None, 7, good),
        call("h", 8, None),
        call("i", 10, "[1]"),
        call("j", None, good, conv=None),
    ]
    results = [(1, "a", 1, "ra"), (1, "a", 2, "rb"), (1, "b", 2, None), (1, "zz", 3, "lost"), (1, None, 3, "x"), (1, "c", 5, "rc")]
    df = spark.createDataFrame(calls, "conv_id long, id string, turn long, name string, arguments string, depends_on array<string>")
    got = {r["id"]: r for r in tool_calls.link(df, spark.createDataFrame(results, "conv_id long, id string, turn long, content string")).collect()}
    assert (got["a"]["status"], got["a"]["level"], got["a"]["position"], got["a"]["n_calls"], got["a"]["n_results"], got["a"]["valid"]) == ("linked", 0, 0, 2, 2, True)
    assert got["a"]["canonical"] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","result":"ra"}'
    assert (got["b"]["level"], got["b"]["errors"], got["b"]["valid"]) == (1, "type:limit", False) and json.loads(got["b"]["canonical"])["arguments"] == {"limit": "3", "query": 'é "q"'}
    assert (got["c"]["level"], got["c"]["errors"]) == (2, "missing:query")
    assert set(got["d"]["errors"].split(",")) == {"not_json", "missing_dependency"} and got["d"]["status"] == "no_result"
    assert got["e"]["level"] is None and "cycle" in got["e"]["errors"] and "unknown:more" in got["e"]["errors"] and "cycle" in got["f"]["errors"]
    assert got["g"]["errors"] == "unknown_tool" and got["h"]["errors"] == "not_json" and got["i"]["errors"] == "not_json"
    assert got["zz"]["status"] == "no_call" and got["zz"]["position"] is None and got[None]["status"] == "no_id" and got["j"]["conv_id"] is None
    order = sorted((r["position"], i) for i, r in got.items() if r["position"] is not None and r["conv_id"] == 1)
    assert [p for p, _ in order] == list(range(len(order))) and [i for _, i in order][-2:] == ["e", "f"]


def test_results_without_an_identifier_are_rows(spark):
    calls = spark.createDataFrame([(1, None, 7, "search", "{}", [])], "conv_id long, id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, None, 3, "x"), (None, None, None, "y"), (1, None, 3, None)], "conv_id long, id string, turn long, content string")
    got = tool_calls.link(calls, results).select("conv_id", "turn", "name", "status", "n_calls", "n_results", "valid", "canonical").collect()
    none = (None, None, None, "no_id", 0, 1, False, '{"result":"y"}')
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 7, "search", "no_id", 1, 0, False, None), (1, 3, None, "no_id", 0, 1, False, '{"result":"x"}'), none, (1, 3, None, "no_id", 0, 1, False, "{}")]))
    said = spark.createDataFrame([(None, 1, "assistant", "z"), (1, None, "assistant", "z"), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert sorted(r["status"] for r in tool_calls.link(*tool_calls.messages(said)).collect()) == ["no_call", "no_id", "no_result"]  # a null conv_id is a conversation, a null turn gives no identifier


def test_no_calls_give_no_rows(spark):
    calls = spark.createDataFrame([], "conv_id long, id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, id string, turn long, content string")
    assert tool_calls.link(calls, results).isEmpty()


@pytest.mark.parametrize("fold", [tool_calls.FOLD, 5, 0])
def test_levels_by_brute_force(spark, fold):
    rng = random.Random(12)
    deps = {}
    for c in range(6):
        ids = [f"n{k}" for k in range(12)]
        for k, i in enumerate(ids):
            pool = ids if c % 3 == 0 else ids[:k]  # forward dependencies and cycles, or none
            deps[f"c{c}", i] = set(rng.sample(pool, min(len(pool), rng.randrange(0, 3))))
    deps |= {("chain", f"n{k}"): {f"n{k - 1}"} if k else set() for k in range(8)}
    expected = {}
    while more := {key for key, d in deps.items() if key not in expected and all((key[0], x) in expected for x in d)}:
        expected |= {k: max((expected[k[0], x] + 1 for x in deps[k]), default=0) for k in more}
    nodes = spark.createDataFrame([(c, i, int(i[1:])) for c, i in deps], "conv string, id string, turn long")
    edges = spark.createDataFrame([(c, i, d) for (c, i), ds in deps.items() for d in ds], "conv string, id string, dep string")
    assert {(r["conv"], r["id"]): r["level"] for r in tool_calls.levels(nodes, edges, fold).collect()} == expected


def test_a_chain_of_a_thousand_calls_needs_no_round_a_level(spark):
    n = 1000
    calls = [(1, f"call_{k}", k, "search", '{"limit":1,"query":"q"}', [f"call_{k - 1}"] if k else []) for k in range(n)]
    df = spark.createDataFrame(calls, "conv_id long, id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, f"call_{k}", k, "r") for k in range(n)], "conv_id long, id string, turn long, content string")
    began = time.time()
    got = tool_calls.link(df, results).filter("valid and level = position and level = turn").count()
    assert got == n and time.time() - began < 60


def test_conversations_may_share_identifiers_and_extra_columns_pass_by(spark):
    long = "x" * 100_000
    calls = [(c, "call_1", 1, "search", f'{{"limit":1,"query":"{c}"}}', ["call_0"], "own") for c in (1, 2, None)] + [(2, "call_0", 0, "search", f'{{"limit":1,"query":"{long}"}}', [], "own"), (3, "", 0, "", "", None, "own")]
    df = spark.createDataFrame(calls, "conv_id long, id string, turn long, name string, arguments string, depends_on array<string>, level string")
    results = spark.createDataFrame([(1, "call_1", 2, "one", 1), (2, "call_1", 2, "two", 1), (None, "call_1", 2, "none", 1), (2, "call_0", 1, "", 1)], "conv_id long, id string, turn long, content string, position int")
    got = {(r["conv_id"], r["id"]): r for r in tool_calls.link(df, results).collect()}
    assert len(got) == 5 and all(json.loads(got[c, "call_1"]["canonical"])["result"] == t and got[c, "call_1"]["n_calls"] == 1 for c, t in ((1, "one"), (2, "two"), (None, "none")))
    assert got[2, "call_1"]["level"] == 1 and got[2, "call_1"]["valid"] and got[1, "call_1"]["errors"] == "missing_dependency"
    assert got[3, ""]["errors"] == "not_json" and long in got[2, "call_0"]["canonical"]


def test_registered_calls_show_every_kind_of_error(spark):
    got = tool_calls.op4_tool_calls(spark, "/root/testdata/sf0.01").collect()
    kinds = {e for r in got for e in r["errors"].split(",")}
    assert {"unknown_tool", "not_json", "missing:limit", "type:limit", "unknown:fast", "unknown:note", "missing_dependency", "cycle"} <= kinds
    on_cycle = [r for r in got if "cycle" in r["errors"].split(",") and json.loads(r["canonical"])["arguments"].get("after") != r["id"]]
    assert on_cycle


# ---- 5: toxicity


def test_segments_are_all_maximal(spark):
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 25)
        hits = sorted(rng.sample(range(n), rng.randrange(0, n)))
        scores = [rng.choice([1.5, 2.0, 3.25]) for _ in hits]
        every = [-0.5] * n
        for p, s in zip(hits, scores, strict=True):
            every[p] = s
        expected = []

        def split(lo, hi):  # the best segment, then those left and right of it
            best = max(((sum(every[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] > 0:
                a = -best[2]
                b = a - best[1]
                split(lo, a)
                expected.append((a, b - 1, best[0]))
                split(b, hi)

        split(0, n)
        import numpy as np

        got = toxicity.segments(np.array(hits, dtype=int), np.array(scores), cost=0.5)
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in expected]) and [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]


def test_segments_are_found_in_linear_time():
    import numpy as np

    n = 1_000_000
    began = time.time()
    falling = toxicity.segments(np.arange(n) * 40, np.full(n, 2.0))  # every hit is a segment and each sum a new low
    rng = np.random.default_rng(1)
    toxicity.segments(np.sort(rng.choice(20 * n, n, replace=False)), rng.choice([1.5, 2.0, 4.0], n))
    assert len(falling) == n and time.time() - began < 10


def test_labels_and_texts_of_one_id_are_chosen_alike_in_any_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet(f"{DATA}/labels.parquet")
    more = spark.createDataFrame([(k, prose(k, 60)) for k in range(0, 200, 3)], "doc_id long, text string")
    twice = known.unionByName(known.select("doc_id", F.lit(0).alias("quality"), F.lit(1).alias("toxic")).filter("doc_id % 5 = 0"))
    docs = docs.unionByName(more)
    first, second = (toxicity.fit(d.repartition(p), k.repartition(p)) for d, k, p in ((docs, twice, 1), (docs.orderBy(F.desc("text")), twice.orderBy(F.desc("doc_id")), 5)))
    assert all((getattr(first, f) == getattr(second, f)).all() for f in ("words", "stems")) and (first.slope, first.base) == pytest.approx((second.slope, second.base), rel=1e-9)
    one, two = (quality.fit_field(d.repartition(p), k.repartition(p)) for d, k, p in ((docs, twice, 1), (docs.orderBy(F.desc("text")), twice.orderBy(F.desc("doc_id")), 5)))
    assert (one.emit == two.emit).all() and (one.step == two.step).all()


def test_log_odds_and_calibration_against_an_independent_fit(spark):
    """The lexicon from plain counts of distinct contexts, and the law from its defining equation."""
    import math
    import re
    from collections import defaultdict

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    lexicon = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    stem = lambda w: w.encode()[: toxicity.PREFIX]
    contexts = defaultdict(set)
    for i, y in label.items():
        w = [None, *split(docs.get(i)), None]
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            contexts[b].add((a, c, y))
    counts = {w: [len({x[:2] for x in c if x[2] == y}) for y in (1, 0)] for w, c in contexts.items()}
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    stems = defaultdict(lambda: [0, 0])
    for w, c in counts.items():
        stems[stem(w)] = [a + b for a, b in zip(stems[stem(w)], c, strict=True)]
    expected = {}
    for s, c in stems.items():
        prior = toxicity.BASE_PRIOR * sum(c) / sum(total)
        odds = math.log((c[0] + prior) / (total[0] + toxicity.BASE_PRIOR)) - math.log((c[1] + prior) / (total[1] + toxicity.BASE_PRIOR))
        if odds >= toxicity.LEAST and sum(c) >= toxicity.LEAST_COUNT and odds / math.sqrt(1 / (c[0] + prior) + 1 / (c[1] + prior)) >= toxicity.SURE:
            expected[int.from_bytes(s, "little")] = odds
    got = dict(zip(lexicon.stems.tolist(), lexicon.stem_scores.tolist(), strict=True))
    assert got == pytest.approx(expected) and got
    # lambda solves E[exp(lambda s)] = 1 over clean tokens, so the expected step of the tilted walk is positive and the plain one negative.
    hits = n = gain = 0
    for i, y in label.items():
        if y == 0:
            data, offsets = toxicity.text_buffers(pa.array([docs.get(i) or ""]))
            words = toxicity.find_words(data, offsets, toxicity.ALNUM, toxicity.LOWER)
            score = lexicon.scores(data, words)
            n, hits, gain = n + len(score), hits + int((score > 0).sum()), gain + float(score.sum())
    mean_hit = gain / hits if hits else (toxicity.LEAST + toxicity.TOP) / 2
    p = min((hits + 1) / (n + 2), 0.5 * toxicity.COST / (mean_hit + toxicity.COST))
    assert p * math.exp(lexicon.rate * mean_hit) + (1 - p) * math.exp(-lexicon.rate * toxicity.COST) == pytest.approx(1, abs=1e-6) and lexicon.rate > 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, sf)
    met = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").select("predicted", "toxic", "score").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in met)
    # About one label in forty says toxic of a text without a toxic passage, and the other way round.
    assert hit / max(1, sum(r["predicted"] for r in met)) >= 0.93 and hit / sum(r["toxic"] for r in met) >= 0.87
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in met)


def test_toxicity_hard_cases(spark, hard, labels):
    lexicon = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    got = toxicity.toxicity(hard, lexicon)
    assert got.count() == hard.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.toxicity(hard.limit(0), lexicon).isEmpty()
    none = toxicity.fit(hard, labels.limit(0))
    assert toxicity.toxicity(hard, none).filter("score <> 0").isEmpty()
    folds = by_id(hard.filter("doc_id is not null").select("doc_id", toxicity.held_out("doc_id").alias("h")), "h")
    assert folds == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in folds}


# ---- 6: substring dedup


@pytest.mark.parametrize(("log2_width", "broadcast_bytes"), [(6, None), (24, None), (None, None), (22, 0), (10, 0)])
def test_substring_dedup_by_brute_force(spark, corpus, texts, log2_width, broadcast_bytes):
    got = by_id(substring_dedup.remove_repeats(corpus, log2_width=log2_width, broadcast_bytes=broadcast_bytes), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(texts)


def test_substring_dedup_of_overlapping_and_self_repeating_texts(spark):
    rng = random.Random(8)
    long = prose(11, 400).split()
    docs = {k: " ".join(long[a : a + rng.randrange(40, 160)]) for k, a in enumerate(rng.randrange(0, 300) for _ in range(30))}
    docs |= {100 + k: " ".join(["a b c d e"] * (8 + k)) for k in range(6)}
    docs |= {200: PASSAGE + " mid " + PASSAGE, 201: PASSAGE, 202: "x " + PASSAGE + " " + prose(12, 60) + " " + PASSAGE}
    got = by_id(substring_dedup.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(docs)


def test_substring_dedup_hard_cases(spark, hard):
    got = substring_dedup.remove_repeats(hard)
    assert got.count() == hard.count() and set(got.columns) >= set(hard.columns)
    assert got.filter("doc_id is null and n_removed <> 0").isEmpty()
    assert {r["n_removed"] for r in got.filter("doc_id = 9").collect()} == {0}
    assert got.filter("doc_id = 10").first()["n_removed"] == 200 and got.filter("doc_id = 10").first()["kept_text"] == ""
    assert substring_dedup.remove_repeats(hard.limit(0)).isEmpty()


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_substring_dedup_keeps_rows_of_one_id_apart(spark, broadcast_bytes):
    rows = identity_rows(prose(31, 150), prose(32, 300))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(df, broadcast_bytes=broadcast_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        # Only documents of smaller ids count, each with all its texts.
        smaller = {-1 - k: t for k, (i, t) in enumerate(rows) if i is not None and r["doc_id"] is not None and i < r["doc_id"]}
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == brute.substring(smaller | {0: r["text"]})[0]


def test_windows_and_words_that_weaker_hashes_take_for_equal(spark):
    pattern = lambda n, a, b: [(a, b)[k.bit_count() & 1] for k in range(n)]
    one, two = "".join(pattern(1024, "a", "b")), "".join(pattern(1024, "b", "a"))
    tail = prose(33, 49)
    docs = {1: f"{one} {tail}", 2: f"{two} {tail}", 3: " ".join(pattern(2048, "x", "y")), 4: " ".join(pattern(2048, "y", "x"))}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert by_id(substring_dedup.remove_repeats(df), "n_words", "n_removed", "kept_sha256") == brute.substring(docs)
    item = [(7, one + " " + " ".join(tail.split()[:12]))]
    assert by_id(decontaminate.decontaminate(df, spark.createDataFrame(item, "item_id long, text string")), *FIVE) == brute.contamination(docs, item)
    lines = {1: f"{one}\n{two}\n{one}\n{two} x", 2: f"{one} a b {two} a b"}
    df = spark.createDataFrame(list(lines.items()), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = by_id(quality.quality_rules(df, none), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality_base(t) for i, t in lines.items()}


def test_the_sketch_grows_with_the_text_and_seldom_passes_single_anchors():
    import numpy as np

    assert substring_dedup.width_for(30 << 30) == 29 and substring_dedup.width_for(0) == 10
    anchors = np.arange(1, 200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    log2_width = substring_dedup.width_for(100 * len(anchors))
    shape = substring_dedup._shape(log2_width)
    bits = np.zeros(shape, dtype=np.uint8)
    count = np.zeros((shape[0], shape[1], shape[2] * 8), dtype=np.int64)
    place = substring_dedup.slices_of(anchors, log2_width)
    for r, cell in enumerate(substring_dedup.cells(anchors, log2_width)):
        np.add.at(count, (place, r, cell), 1)
    bits = np.packbits(count > 1, axis=2, bitorder="little")
    assert substring_dedup.passes(bits, anchors, log2_width, place).mean() < 0.1


# ---- 7: decontamination

ITEMS = [(1, ITEM), (2, "short item"), (3, None), (4, "..."), (None, PASSAGE), (5, ITEM), (10, " ".join(ITEM.split()[3:18])), (1, prose(97, 15)), (6, PASSAGE)]
FIVE = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contaminated(df):
    return by_id(df, *FIVE)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 1000])
def test_decontamination_by_brute_force(spark, corpus, texts, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [i for i in ITEMS if i[0] is not None]
    df = spark.createDataFrame(bench, "item_id long, text string")
    got = contaminated(decontaminate.decontaminate(corpus, df))
    expected = brute.contamination(texts, bench)
    assert got == expected
    clean = decontaminate.decontaminate(corpus, df, clean_only=True)
    assert clean.columns == corpus.columns and {r["doc_id"] for r in clean.collect()} == {i for i, e in expected.items() if not e[4]}


def test_decontamination_hard_cases(spark, hard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("contaminated", F.lit("x"))
    got = decontaminate.decontaminate(hard, items)
    assert got.count() == hard.count() and got.filter("text is null and (n_words <> 0 or contaminated)").isEmpty()
    assert got.filter("doc_id = 14").first()["contaminated"] and got.filter("doc_id = 13").first()["n_items"] == 3
    assert decontaminate.decontaminate(hard, items.limit(0)).filter("n_hit <> 0").isEmpty()
    assert decontaminate.decontaminate(hard.limit(0), items).isEmpty()


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 1000])
def test_every_row_is_judged_by_its_own_text(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = [(None, prose(1, 30)), (None, ITEM), (None, None), (1, prose(2, 40)), (1, ITEM + " " + prose(3, 9)), (1, ITEM + " " + prose(3, 9)), (2, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(k, prose(50 + k, 20)) for k in range(8)] + [(9, ITEM)], "item_id long, text string")
    got = decontaminate.decontaminate(df, items)
    words = [30, 20, 0, 40, 29, 29, 1]
    expected = [(i, t, n, 20 * (t is not None and ITEM in t)) for (i, t), n in zip(rows, words, strict=True)]
    assert sorted(map(repr, [tuple(r)[:4] for r in got.collect()])) == sorted(map(repr, expected))
    clean = decontaminate.decontaminate(df, items, clean_only=True)
    assert sorted(repr(tuple(r)) for r in clean.collect()) == sorted(repr(r) for r in rows if r[1] is None or ITEM not in r[1])
    carried = decontaminate.decontaminate(df, items, carry=["doc_id"])
    assert carried.columns == ["doc_id", *FIVE] and carried.count() == len(rows)


def test_runs_are_numbered_by_their_words():
    import numpy as np

    rng = np.random.default_rng(3)
    numbers = rng.integers(1, 4, 500).astype(np.int32)
    start = np.arange(490)
    kind = decontaminate.distinct_runs(numbers, start, 5)
    runs = [tuple(numbers[a : a + 5].tolist()) for a in start]
    order = {run: k for k, run in enumerate(sorted(set(runs)))}
    assert kind.tolist() == [order[run] for run in runs]


# ---- 8: token counts


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_are_the_librarys(spark, corpus, texts, name):
    path = token_counts.vocabulary(name)
    got = by_id(token_counts.count_tokens(corpus, path), "n_bytes", "n_tokens", "over_limit")
    if name.endswith(".model"):
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(plain.encode(t))
    else:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    for i, t in texts.items():
        n = count(t or "")
        assert got[i] == (len((t or "").encode()), n, n > 4096), i


def test_splitting_before_spaces_changes_no_count():
    import sentencepiece

    path = token_counts.vocabulary("piece_bpe_32k.model")
    plain, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Counter(path)
    rng = random.Random(9)
    alphabet = [" ", "  ", "a", "the", "▁", "\n", "\t", "é", "😀", " ", "Ünïcode", "<s>", "</s>", "<unk>", "<0x0A>", ".", "1", "　", "﻿", "ﬁ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    assert counter.count(texts) == [len(x) for x in plain.encode(texts)]


def test_token_counts_hard_cases(spark, hard):
    got = token_counts.count_tokens(hard, token_counts.vocabulary("piece_bpe_32k.model"), limit=100)
    assert got.count() == hard.count() and got.filter("text is null and n_tokens <> 0").isEmpty() and got.filter("doc_id = 16").first()["over_limit"]
    assert token_counts.count_tokens(hard.limit(0), token_counts.vocabulary("byte_bpe_50k.json")).isEmpty()


# ---- 9: packing


def least_padding(lengths, buckets):
    sizes = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(sizes))):
        for inner in itertools.combinations(sizes[:-1], k):
            edges = [*inner, sizes[-1]]
            cost = sum(next(e for e in edges if e >= n) - n for n in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_minimise_padding():
    rng = random.Random(10)
    for _ in range(60):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        rows = [(n, lengths.count(n), n * lengths.count(n)) for n in set(lengths)]
        edges = packing.boundaries(rows, 3)
        assert len(edges) <= 3 and edges[-1] == max(lengths)
        assert sum(next(e for e in edges if e >= n) - n for n in lengths) == least_padding(lengths, 3)
    assert packing.boundaries([]) == [] and packing.boundaries([(0, 5, 0)]) == [1]


def test_batches_keep_to_the_budget_and_hold_every_row(spark, corpus, texts):
    got = packing.pack(corpus, budget=2048).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["n_tokens"] == len(brute.words(texts[r["doc_id"]])) and r["n_tokens"] <= r["bucket_length"] for r in got)
    rooms = {}
    for r in got:
        rooms.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in rooms.values():
        limit = rows[0]["bucket_length"]
        assert len(rows) * limit <= 2048 or len(rows) == 1
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    for b in {k[0] for k in rooms}:
        own = sorted((r["batch"], r["slot"], r["doc_id"]) for r in got if r["bucket"] == b)
        assert [x[2] for x in own] == sorted(x[2] for x in own) and {x[0] for x in own} == set(range(max(x[0] for x in own) + 1))


@pytest.mark.parametrize("kind", ["hashed", "null", "one", "mixed"])
def test_rows_are_numbered_however_their_ids_lie(spark, kind):
    rng = random.Random(13)
    ids = {"hashed": lambda: rng.getrandbits(63) - 2**62, "null": lambda: None, "one": lambda: 7, "mixed": lambda: rng.choice([None, 7, rng.getrandbits(62)])}[kind]
    rows = [(ids(), rng.randrange(0, 40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, size int").repartition(5)
    got = packing.pack(df, length="size", buckets=3, budget=200).collect()
    assert sorted(map(repr, rows)) == sorted(repr((r["doc_id"], r["n_tokens"])) for r in got)
    for b in {r["bucket"] for r in got}:
        own = sorted(((r["batch"], r["slot"]), (r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"])) for r in got if r["bucket"] == b)
        per = max(1, 200 // next(r["bucket_length"] for r in got if r["bucket"] == b))
        assert [x[0] for x in own] == [(k // per, k % per) for k in range(len(own))] and [x[1] for x in own] == sorted(x[1] for x in own)


def test_many_lengths_are_cut_by_the_whole_dynamic_programme():
    rng = random.Random(14)
    rows = sorted((n, c, n * c) for n, c in ((n, rng.randrange(1, 9)) for n in rng.sample(range(1, 30_000), 300)))
    edges = packing.boundaries(rows, 4)
    count, total = ([0, *itertools.accumulate(r[k] for r in rows)] for k in (1, 2))
    cost = [0] + [float("inf")] * len(rows)
    for _ in range(4):  # the plain programme over all pairs
        cost = [0] + [min(cost[i] + rows[j - 1][0] * (count[j] - count[i]) - (total[j] - total[i]) for i in range(j)) for j in range(1, len(rows) + 1)]
    assert len(edges) == 4 and sum(c * next(e for e in edges if e >= n) - s for n, c, s in rows) == cost[-1]


def test_packing_hard_cases(spark, hard):
    got = packing.pack(hard)
    assert got.count() == hard.count() and got.filter("doc_id is null").count() == 2
    assert packing.pack(hard.limit(0)).isEmpty()
    assert packing.pack(hard.select("doc_id", F.lit(-3).alias("size")), length="size").filter("n_tokens <> 0").isEmpty()


# ---- 10: quality rules


def test_base_counts_by_brute_force(spark, corpus, texts, labels):
    got = by_id(quality.quality_rules(corpus, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality_base(t) for i, t in texts.items()}


def test_viterbi_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    field = quality.Field()
    field.emit, field.step, field.start = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [0, 1, 2, 7, 3, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    bins = rng.integers(0, quality.N_FEATURES, size=(first[-1], len(quality.EDGES)))
    got = field.decode(bins, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        score = field.scores(bins[a:b])
        total = lambda p: sum(score[k, y] for k, y in enumerate(p)) + (field.start[p[0]] if p else 0) + sum(field.step[x, y] for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=int(b - a)), key=total)
        assert tuple(got[a:b]) == best


def test_quality_on_rows_it_was_not_fitted_to(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = quality.quality_rules(docs, train, carry=["doc_id"])
    met = got.join(known.join(train, "doc_id", "left_anti"), "doc_id").filter("quality is not null").select("kept", "quality", "base_failed").collect()
    good = [r for r in met if r["quality"] == 1]
    bad = [r for r in met if r["quality"] == 0]
    assert sum(r["kept"] for r in good) / len(good) >= 0.95 and sum(not r["kept"] for r in bad) / len(bad) >= 0.7


def test_quality_hard_cases(spark, hard, labels):
    got = quality.quality_rules(hard, labels)
    assert got.count() == hard.count() and got.filter("text is null and (kept or not base_failed)").isEmpty()
    assert quality.quality_rules(hard, labels.limit(0)).filter("kept <> (not base_failed)").isEmpty()
    assert quality.keep_good(hard, labels).columns == hard.columns
    assert quality.quality_rules(hard.limit(0), labels).isEmpty()
