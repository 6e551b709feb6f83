"""What only large tables show: plans that must not broadcast, tasks that must be many, memory that must not follow rows."""

from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.schema import Config, Schema
from foliospark.kernel.tree import Problem
from foliospark.operators import kernels
from foliospark.operators.kernels import Kernels
from foliospark.operators.nodes import NUMBER, parse_nodes
from foliospark.plans.analytics import OUTLINE
from foliospark.plans.branches import BRANCHES
from foliospark.plans.changes import changes
from foliospark.plans.places import as_of_join, interval_join, nodes_at
from foliospark.plans.validate import READ
from foliospark.sources.documents import dealt, spread, tasks
from foliospark.sources.sinks import diagnostics_json, format_check
from foliospark.streaming.documents import _newest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    return spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").alias(NUMBER), F.lit("# A\n\nb\n").alias("source"))


def test_places_meet_nodes_without_a_broadcast(spark, docs):
    nodes = parse_nodes(docs)
    places = docs.select(NUMBER, F.lit(3).alias("at"))
    heads = nodes.filter("type = 'heading'").select(NUMBER, F.lit(0).alias("by"), "type")
    assert "Broadcast" not in plan(nodes_at(places, nodes)) and "Broadcast" not in plan(as_of_join(places, heads, [NUMBER], "at", "by"))
    spans = nodes.select(NUMBER, F.lit(0).alias("start"), F.lit(9).alias("stop"), "node_id")
    assert "Broadcast" not in plan(interval_join(places, spans, [NUMBER], how="left"))


def test_states_meet_without_a_broadcast(spark, docs):
    states = [parse_nodes(docs.withColumn("source", F.lit(s)), options=ParseOptions(location=False), digests=True) for s in ("a\n\nb\n", "b\n\na\n")]
    assert "Broadcast" not in plan(changes(*states))


def test_documents_of_one_bundle_render_in_many_tasks(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit('{% partial file="p.md" /%}\n\nx'), F.col("id")).alias("source"))
    partials = spark.createDataFrame([("p.md", "hello\n")], "file string, source string")
    html = Engine(spark).render_with_partials(docs, partials)
    filled = [n for n in html.select("doc_id").rdd.glom().map(len).collect() if n]
    assert len(filled) > spark.sparkContext.defaultParallelism and sum(filled) == 200
    assert {r["html"] for r in html.collect()} == {f"<article><p>hello</p><p>x{k}</p></article>" for k in range(200)}
    assert spread(spark.range(9).coalesce(1)).rdd.getNumPartitions() == tasks(spark) > spark.sparkContext.defaultParallelism


def test_equal_sources_are_parsed_once_unless_hooks_see_the_tree():
    text, options = "{% if $a %}\nequal sources\n{% /if %}\n", ParseOptions(bare=True)
    hits = kernels.kept_tree.cache_info().hits
    got = [kernels.render(kernels.renderables(text, Config.of(variables={"a": k % 2 == 0}), options, keep=True)) for k in range(4)]
    assert got == ["<article><p>equal sources</p></article>", "<article></article>"] * 2
    assert kernels.kept_tree.cache_info().hits == hits + 3
    assert not kernels.has_own_hooks(Config()) and kernels.has_own_hooks(Config.of({"x": Schema("b", transform=lambda node, config: None)}))


def test_results_leave_a_worker_by_pieces():
    rows = pd.Series(["x" * 1000] * 3000 + [None] + ["y" * 3_000_000] * 2)
    found = list(kernels.pieces(rows, rows))
    assert [r[0] for piece in found for r in piece] == list(rows) and max(map(len, found)) <= kernels.PIECE_ROWS
    assert all(sum(len(r[0] or "") for r in piece[:-1]) < kernels.PIECE_CHARS for piece in found)


def test_nodes_of_wanted_columns_and_types(spark):
    docs = spark.createDataFrame([(1, "# A {% #x %}\n\n{% if true %}\nb\n{% /if %}\n"), (2, None)], "doc_id long, source string")
    whole = parse_nodes(docs)
    some = parse_nodes(docs, columns=("loc", "path", "depth"), types=("tag", "heading"))
    assert some.columns == ["doc_id", NUMBER, "depth", "path", "loc"]
    assert sorted(some.collect()) == sorted(whole.filter("type in ('tag', 'heading')").select(*some.columns).collect())
    for columns in (BRANCHES, READ, OUTLINE["columns"]):
        own = parse_nodes(docs, columns=columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, whole.select(*own.columns).collect()))
    with pytest.raises(ValueError, match="lost"):
        parse_nodes(docs, columns=("lost",))


def test_versions_are_judged_by_rows_with_few_calls_of_the_state():
    calls, noon = [], datetime(2024, 1, 1, 12, tzinfo=timezone.utc)

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def listTimers(self):
            calls.append("list")
            return iter([])

        def registerTimer(self, at):
            calls.append(at)

    newest = _newest(1000)
    newest.init(Handle())
    rows = [("a", 1, noon, "x"), ("a", 3, noon, None), ("a", 3, noon, "y"), ("a", 2, noon, "z")]
    got = [tuple(r) for r in newest.handleInputRows(("a",), iter(rows), None)]
    assert got == [("a", 1, noon, "late", "x"), ("a", 3, noon, "late", None), ("a", 2, noon, "late", "z"), ("a", 3, noon, "new", "y")]
    assert calls == ["get", "update", 1704110400000 + 1000]
    assert [r[3] for r in newest.handleInputRows(("a",), iter([("a", 3, noon, "w"), ("a", 4, noon, "v")]), None)] == ["late", "newer"]


def test_diagnostics_meet_documents_without_a_broadcast(spark, docs):
    own = docs.withColumn("file", F.lit("a.md"))
    assert "SortMergeJoin [__key" in plan(diagnostics_json(Engine(spark).validate(own, file="file"), own))


def test_formatting_stays_behind_the_deal_and_runs_once(spark, docs):
    rows = dealt(docs.withColumn("file", F.col("doc_id").cast("string")))
    steps = [line for line in plan(format_check(Engine(spark).format(rows))).split("\n") if "[run(" in line or "Exchange" in line]
    assert ["[run(" in line for line in steps] == [True, False]  # once, above the exchange


def test_clean_documents_are_judged_without_places_or_pandas(spark, docs, monkeypatch):
    options = ParseOptions()
    monkeypatch.setattr(kernels, "Positions", None)
    assert kernels.diagnostics("# A\n", Config(), options) == []
    monkeypatch.undo()
    hook = Schema("i", validate=lambda node, config: [Problem("inside", "info", ".".join(n.type for n in config.parents))])
    config = Config.of({"outer": Schema("div"), "inner": hook})
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "{% outer %}\n{% inner /%}\n{% /outer %}\n").when(F.col("doc_id") % 5 != 0, "x\n").alias("source"))
    problems = Kernels(spark, config, options).problems(F.col("source"))
    got = rows.select("doc_id", problems.alias("p"))
    assert "Arrow-optimized" not in plan(got) and " 204" not in plan(got)  # 204 is an iterator of pandas series
    for row in got.collect():
        found = None if row["p"] is None else [(p["error"]["id"], p["error"]["message"], p["loc"]["start"]["line"]) for p in row["p"]]
        assert found == ([("inside", "document.tag", 1)] if row["doc_id"] % 2 == 0 else [] if row["doc_id"] % 5 else None)
