"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are each reduced to one row for a conversation's identifier (the earliest; repeats
are counted), so the hash join by conversation and identifier meets unique keys however often one
repeats; two conversations may use the same identifiers.  Dependencies name calls of their own
conversation.

Topological order: a call without dependencies has level 0, any other one more than the largest
level among them.  Conversations of up to FOLD calls and dependencies whose calls depend on earlier
ones only are folded in one ordered aggregate, whatever the length of their chains.  The others go
by rounds, one a level: a call whose dependencies all have a level gets the next one; calls left
over when a round adds none stand on a cycle or behind one.  Positions inside a conversation are
numbered over ranges, so no task holds a conversation.  Only keys, levels and turns take part in
that; texts meet them once, at the end.  Arguments are parsed as VARIANT, checked against the tool's
parameters (type, required, unknown) and serialised with sorted keys and no white space.  DataFrame
functions only.

Calls and results without an identifier are not linked and return with status no_id, one row each
(n_calls and n_results tell which); rows with a null conv_id are one conversation; a null turn comes
before all others.  Arguments that are null, empty or no JSON object have the error not_json; results
without a call are returned with status no_call.  Dependencies that name no call of the conversation
are the error missing_dependency and do not count in the order.  Columns besides those named are not
read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import cut, numbered, read

#: Calls and dependencies of a conversation that one fold takes.
FOLD = 8192
KEY = ["conv", "id"]

#: (tool, parameter, type, required): the schemas of the registered query.
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("search", "after", "string", False),
    ("translate", "text", "string", True),
    ("translate", "target", "string", True),
    ("translate", "after", "string", False),
    ("summarise", "text", "string", True),
    ("summarise", "ratio", "number", False),
    ("summarise", "after", "string", False),
]

# The type names that a parsed JSON value reports, by schema type.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


def argument_errors(arguments: F.Column, tool: F.Column, tools: list[tuple[str, str, str, bool]]) -> F.Column:
    """Sorted errors of a call's parsed arguments: not_json, unknown_tool, missing:p, type:p, unknown:p."""
    fields = arguments.cast("map<string,variant>")

    def check(name: str) -> F.Column:
        own = [t for t in tools if t[0] == name]
        out = []
        for _, p, kind, required in own:
            value = F.element_at(fields, F.lit(p))
            base = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            absent = ~F.map_contains_key(fields, F.lit(p))
            out.append(F.when(absent, F.lit(f"missing:{p}") if required else F.lit(None)).when(~base.isin(_TYPES[kind]), F.lit(f"type:{p}")))
        extra = F.transform(F.array_except(F.map_keys(fields), F.array(*[F.lit(t[1]) for t in own])), lambda k: F.concat(F.lit("unknown:"), k))
        return F.array_sort(F.array_union(F.array_compact(F.array(*out)), extra))

    errors = F.array(F.lit("unknown_tool"))
    for name in sorted({t[0] for t in tools}):
        errors = F.when(tool == name, check(name)).otherwise(errors)
    is_object = F.schema_of_variant(arguments).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), errors).otherwise(F.array(F.lit("not_json")))


def _fold(nodes: DataFrame, edges: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(conv, id, level) of conversations of at most `fold` rows whose edges lead to earlier nodes, by turn and id; (conv) of these."""
    small = nodes.select("conv").unionAll(edges.select("conv")).groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= fold).select("conv")
    deps = edges.groupBy(*KEY).agg(F.collect_set("dep").alias("deps"))
    lists = nodes.join(small, "conv", "left_semi").join(deps.join(small, "conv", "left_semi"), KEY, "left").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "deps"))).alias("calls"))

    def level(done, call):
        found = F.transform(call["deps"], lambda d: F.get(done, (F.array_position("ids", d) - 1).cast("int")))
        return F.when(call["deps"].isNull(), F.lit(0)).when(~F.exists(found, lambda x: x.isNull()), F.array_max(found) + 1)

    levels = F.aggregate("calls", F.array().cast("array<int>"), lambda done, call: F.array_append(done, level(done, call)))
    folded = cut(lists.withColumn("ids", F.col("calls.id")).select("conv", "ids", levels.alias("levels")).filter(~F.exists("levels", lambda x: x.isNull())))
    return folded.select("conv", F.explode(F.arrays_zip("ids", "levels")).alias("x")).select("conv", F.col("x.ids").alias("id"), F.col("x.levels").alias("level")), folded.select("conv")


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, id, level) of the nodes that stand on no cycle nor behind one, a round for each level."""
    now = cut(nodes.select(*KEY).join(edges.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit(0).alias("level")))
    left, done, level = cut(edges), [now], 0
    while not left.isEmpty():
        level += 1
        known = now.select("conv", F.col("id").alias("dep"))
        met = left.join(known, ["conv", "dep"], "left_semi").select(*KEY).distinct()
        still = cut(left.join(known, ["conv", "dep"], "left_anti").select(*KEY, "dep"))
        now = cut(met.join(still.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit(level).alias("level")))
        left = still
        if now.isEmpty():
            break
        done.append(now)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def levels(nodes: DataFrame, edges: DataFrame, fold: int = FOLD) -> DataFrame:
    """(conv, id, level) of every node that stands on no cycle nor behind one.

    `nodes` (conv, id, turn) are distinct; `edges` (conv, id, dep) are distinct and name nodes on both sides.
    """
    folded, known = _fold(nodes, edges, fold)
    rest = cut(nodes.join(known, "conv", "left_anti"))
    return folded if rest.isEmpty() else folded.unionByName(_rounds(rest, edges.join(known, "conv", "left_anti")))


def link(calls: DataFrame, results: DataFrame, tools: list[tuple[str, str, str, bool]] | None = None, fold: int = FOLD) -> DataFrame:
    """One row per conversation and identifier and per call or result without one, from calls (conv_id, id, turn, name, arguments, depends_on) and results (conv_id, id, turn, content).

    Columns: conv_id, id, turn, name, status (linked, no_result, no_call, no_id), level and position (null for no_call
    and no_id; level also on a cycle or behind one), n_calls, n_results, errors (comma-joined), canonical (JSON of name,
    id, arguments and result, keys sorted), valid.
    """
    tools = TOOLS if tools is None else tools
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("conv")  # null is a key too
    first = F.min_by(F.struct("conv_id", "turn", "name", "arguments", "depends_on"), F.struct("turn", "name", "arguments", "depends_on"))
    own = calls.filter("id is not null").groupBy(conv, "id").agg(first.alias("c"), F.count(F.lit(1)).alias("n_calls"))
    got = results.filter("id is not null").groupBy(conv, "id").agg(F.min_by(F.struct("conv_id", "turn", "content"), F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    met = cut(own.join(got, KEY, "full_outer"))
    nodes = cut(met.filter("c is not null").select(*KEY, "c.turn"))
    asked = met.filter("c is not null").select(*KEY, F.explode(F.array_distinct("c.depends_on")).alias("dep")).filter("dep is not null")
    asked = asked.join(nodes.select("conv", F.col("id").alias("dep"), F.lit(True).alias("known")), ["conv", "dep"], "left")
    asked = cut(asked.select(*KEY, "dep", F.col("known").isNull().alias("missing")))
    missing = asked.filter("missing").select(*KEY, "missing").distinct()
    placed = nodes.join(levels(nodes, asked.filter("not missing").select(*KEY, "dep"), fold), KEY, "left").join(missing, KEY, "left")
    placed = cut(placed.withColumn("rank", F.coalesce("level", F.lit((1 << 31) - 1))))
    placed = numbered(placed, ["conv"], ["rank", "turn", "id"], "position").select(*KEY, "level", "missing", "position")
    rows = met.join(placed, KEY, "left").withColumn("args", F.try_parse_json("c.arguments"))
    errors = F.array_compact(
        F.concat(
            argument_errors(F.col("args"), F.col("c.name"), tools),
            F.array(F.when(F.col("missing"), F.lit("missing_dependency")), F.when(F.col("level").isNull(), F.lit("cycle"))),
        )
    )
    status = F.when(F.col("c").isNull(), "no_call").when(F.col("r").isNull(), "no_result").otherwise("linked")
    text = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("id"), F.col("c.name").alias("name"), F.col("r.content").alias("result")))
    rows = rows.select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"),
        "id",
        F.when(F.col("c").isNotNull(), F.col("c.turn")).otherwise(F.col("r.turn")).alias("turn"),
        F.col("c.name").alias("name"),
        status.alias("status"),
        "level",
        "position",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("c").isNotNull(), F.array_join(errors, ",")).otherwise("").alias("errors"),
        text.alias("canonical"),
    )

    def lost(rows: DataFrame, name: F.Column, canonical: F.Column, n_calls: int) -> DataFrame:
        none = {"id": "string", "level": "int", "position": "long"}
        own = rows.filter("id is null").select("conv_id", "turn", name.cast("string").alias("name"), canonical.cast("string").alias("canonical"))
        own = own.withColumns({k: F.lit(None).cast(t) for k, t in none.items()} | {"status": F.lit("no_id"), "errors": F.lit("")})
        return own.withColumns({"n_calls": F.lit(n_calls).cast("long"), "n_results": F.lit(1 - n_calls).cast("long")})

    result = F.to_json(F.struct(F.col("content").alias("result")))
    every = rows.unionByName(lost(calls, F.col("name"), F.lit(None), 1)).unionByName(lost(results, F.lit(None), result, 0))
    return every.withColumn("valid", (F.col("errors") == "") & (F.col("status") == "linked"))


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a conversations table: each system or user turn calls a tool, the assistant's next turn answers it.

    Identifiers begin anew in every conversation.  A system turn calls a tool that has no schema.  A user turn's tool
    follows from its text's length; turn t depends on the turn that halves its number of exchanges, or, by every
    eleventh length, on the next exchange.  Some lengths leave an argument out, give it a wrong type or an unknown name,
    make a call depend on itself, or pass the bare text as arguments.
    """
    n = F.length("text")
    turn, user = F.col("turn"), F.col("role") == "user"
    key = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    parent = F.floor(F.floor(turn / 2) / 2) * 2 + turn % 2
    after = F.when(n % 11 == 0, key(turn + 2)).when(turn >= 2, key(parent))
    ask = lambda limit: F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"), after.alias("after")))
    args = (
        F.when(~user, F.to_json(F.struct("text")))
        .when(n % 13 == 0, F.col("text"))
        .when(n % 3 == 0, F.when(n % 7 == 1, ask(F.lit("many"))).otherwise(ask(F.when(n % 7 != 0, n % 20 + 1))))
        .when(n % 3 == 1, F.to_json(F.struct(after.alias("after"), F.lit("en").alias("target"), F.col("text").alias("text"), F.when(n % 7 == 0, F.lit(True)).alias("fast"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"), F.when(n % 7 != 0, (n % 8) / 8).alias("ratio"), F.when(n % 7 == 0, key(turn)).alias("after"), F.when(n % 14 == 0, F.lit("half")).alias("note"))))
    )
    name = F.when(~user, "configure").when(n % 3 == 0, "search").when(n % 3 == 1, "translate").otherwise("summarise")
    calls = conversations.filter("role in ('user', 'system')").select("conv_id", key(turn).alias("id"), "turn", name.alias("name"), args.alias("arguments"))
    calls = calls.withColumn("depends_on", F.array_compact(F.array(F.get_json_object("arguments", "$.after"))))
    results = conversations.filter("role = 'assistant'").select("conv_id", key(turn - 1).alias("id"), "turn", F.col("text").alias("content"))
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked calls of the whole conversations table; a level or position that is not there is -1."""
    got = link(*messages(read(spark, sf_dir, "conversations")))
    place = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("level", "position")]
    return got.select("conv_id", "id", "turn", "name", "status", *place, "n_calls", "n_results", "errors", "valid", "canonical")


def oracle() -> str:
    """DuckDB SQL of op4_tool_calls, levels by recursion."""
    return """
WITH RECURSIVE u AS (SELECT conv_id, turn, text, role = 'user' AS own, length(text) AS n, 'call_' || turn AS id,
    CASE WHEN length(text) % 11 = 0 THEN 'call_' || (turn + 2) WHEN turn >= 2 THEN 'call_' || ((turn // 2) // 2 * 2 + turn % 2) END AS heap FROM conversations WHERE role IN ('user', 'system')),
c AS (SELECT *, CASE WHEN NOT own THEN 'configure' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'translate' ELSE 'summarise' END AS name,
    CASE WHEN NOT own OR n % 13 = 0 THEN NULL WHEN n % 3 < 2 THEN heap WHEN n % 7 = 0 THEN id END AS after FROM u),
x AS (SELECT conv_id, min(turn) AS turn, id, min(name) AS name, bool_and(own) AS own, min(n) AS n, min(text) AS text, min(after) AS after, count(*) AS n_calls FROM c GROUP BY conv_id, id),
r AS (SELECT conv_id, 'call_' || (turn - 1) AS id, min(turn) AS turn, arg_min(text, turn) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY conv_id, 2),
k AS (SELECT x.conv_id, x.id, x.after, p.id IS NULL AS lost FROM x LEFT JOIN x p ON p.conv_id = x.conv_id AND p.id = x.after),
lv AS (SELECT conv_id, id, 0 AS level FROM k WHERE lost UNION ALL SELECT k.conv_id, k.id, lv.level + 1 FROM k JOIN lv ON k.conv_id = lv.conv_id AND k.after = lv.id),
m AS (SELECT conv_id, id, coalesce(x.turn, r.turn) AS turn, x.name, x.id IS NULL AS orphan, own, n, text, k.after, level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, content,
    k.after IS NOT NULL AND k.lost AS lost
    FROM x FULL JOIN r USING (conv_id, id) LEFT JOIN k USING (conv_id, id) LEFT JOIN lv USING (conv_id, id)),
e AS (SELECT *, CASE WHEN orphan THEN 'no_call' WHEN content IS NULL THEN 'no_result' ELSE 'linked' END AS status,
    CASE WHEN orphan THEN '' ELSE array_to_string(list_filter([
      CASE WHEN NOT own THEN 'unknown_tool' WHEN n % 13 = 0 THEN 'not_json'
        WHEN n % 3 = 0 AND n % 7 = 0 THEN 'missing:limit' WHEN n % 3 = 0 AND n % 7 = 1 THEN 'type:limit'
        WHEN n % 3 = 1 AND n % 7 = 0 THEN 'unknown:fast' WHEN n % 3 = 2 AND n % 14 = 0 THEN 'unknown:note' END,
      CASE WHEN lost THEN 'missing_dependency' END, CASE WHEN level IS NULL THEN 'cycle' END], lambda z: z IS NOT NULL), ',') END AS errors,
    CASE WHEN NOT own THEN '{"text":' || to_json(text) || '}' WHEN n % 13 = 0 THEN NULL
      WHEN n % 3 = 0 THEN '{' || CASE WHEN after IS NOT NULL THEN '"after":' || to_json(after) || ',' ELSE '' END || CASE n % 7 WHEN 0 THEN '' WHEN 1 THEN '"limit":"many",' ELSE '"limit":' || (n % 20 + 1) || ',' END || '"query":' || to_json(text) || '}'
      WHEN n % 3 = 1 THEN '{' || CASE WHEN after IS NOT NULL THEN '"after":' || to_json(after) || ',' ELSE '' END || CASE WHEN n % 7 = 0 THEN '"fast":true,' ELSE '' END || '"target":"en","text":' || to_json(text) || '}'
      ELSE '{' || CASE WHEN after IS NOT NULL THEN '"after":' || to_json(after) || ',' ELSE '' END || CASE WHEN n % 14 = 0 THEN '"note":"half",' ELSE '' END
        || CASE WHEN n % 7 <> 0 THEN '"ratio":' || CASE n % 8 WHEN 0 THEN '0' ELSE ((n % 8) / 8.0)::DOUBLE::VARCHAR END || ',' ELSE '' END || '"text":' || to_json(text) || '}' END AS args FROM m)
SELECT conv_id, id, turn, name, status, coalesce(level, -1)::INTEGER AS level, CASE WHEN orphan THEN -1 ELSE row_number() OVER (PARTITION BY conv_id, orphan ORDER BY coalesce(level, 2147483647), turn, id) - 1 END AS position,
  n_calls, n_results, errors, errors = '' AND status = 'linked' AS valid,
  '{' || CASE WHEN orphan OR args IS NULL THEN '' ELSE '"arguments":' || args || ',' END || '"id":' || to_json(id) || CASE WHEN orphan THEN '' ELSE ',"name":' || to_json(name) END || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}' AS canonical
FROM e
"""
