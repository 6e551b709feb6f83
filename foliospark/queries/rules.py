"""Queries for every validation rule, the printers, extension points and streams."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.functions import sql
from foliospark.functions.document import Function
from foliospark.kernel.blocks import Block
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.format import FormatOptions
from foliospark.kernel.schema import Attribute, AttributeType, Config, Pattern, Schema, Slot
from foliospark.kernel.tokenizer import Tokens, masked
from foliospark.kernel.tree import Problem
from foliospark.operators.nodes import parse_nodes
from foliospark.operators.values import format_value_column, parse_value_column, tag_end_column
from foliospark.queries.registry import query, read, written
from foliospark.sources.sinks import exit_code
from foliospark.streaming.documents import drained, newest_versions, render_stream

# ---- every rule

_RULES = Config.of(
    {
        "block": Schema("div", inline=False, attributes={"n": Attribute("Number")}, slots={"head": Slot()}),
        "closed": Schema("hr", self_closing=True),
        "needs": Schema("div", slots={"head": Slot(required=True)}),
    }
)
_CALLS = replace(
    Config.of(
        {"row": Schema("div", attributes={"v": Attribute()})},
        functions={"pick": Function(lambda p, c: p.get("0"), parameters={"0": Attribute("Number", required=True), "name": Attribute("String")})},
    ),
    validate_functions=True,
)

#: (source with @ for the key, error id, level, message with @ for the key)
_CASES = [
    ("a {% block %}x{% /block %}", "tag-placement-invalid", "critical", "'block' tag should be block"),
    ("{% closed %}\nx @\n{% /closed %}", "tag-selfclosing-has-children", "critical", "'closed' tag should be self-closing"),
    ('{% block %}\n\n{% slot "s@" %}\nx\n{% /slot %}\n\n{% /block %}', "slot-undefined", "error", "Invalid slot: 's@'"),
    ("{% needs /%}", "slot-missing-required", "error", "Missing required slot: 'head'"),
    ("{% /block %}", "missing-opening", "critical", "Node 'block' is missing opening"),
    ("{% block %}\nx @", "missing-closing", "critical", "Node 'block' is missing closing"),
    ("{% block n=@ n=1 /%}", "duplicate-attribute", "warning", "Attribute 'n' already set"),
    ("{% #x@ %}", "no-inline-annotations", "error", "Can't apply inline annotations to 'document'"),
    ("[a](https://x.example/{% $v%})", "href-format-invalid", "error", "The 'href' format cannot contain a tag or variable. URLs must be static strings."),
    ("``` {% a= %}\nx @\n```", "fence-tag-error", "error", None),
    ("{% table %}\n* a\n---\nx @\n{% /table %}", "table-syntax", "critical", "Found paragraph where a list was expected. Make sure all content inside table cells is indented."),
]


def _faults_sql() -> str:
    ids = " ".join(f"WHEN {k} THEN '{c[1]}'" for k, c in enumerate(_CASES))
    levels = " ".join(f"WHEN {k} THEN '{c[2]}'" for k, c in enumerate(_CASES))
    texts = " ".join(f"WHEN {k} THEN replace('{c[3].replace(chr(39), chr(39) * 2)}', '@', CAST(o_orderkey AS VARCHAR))" for k, c in enumerate(_CASES) if c[3])
    n = len(_CASES)
    return f"SELECT o_orderkey, CASE o_orderkey % {n} {ids} END AS error_id, CASE o_orderkey % {n} {levels} END AS level, CASE o_orderkey % {n} {texts} END AS message FROM orders"


@query(_faults_sql())
def validate_every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fault an order, of every rule that the other validation queries do not show."""
    source = F.lit("")
    for k, case in enumerate(_CASES):
        parts: list = []
        for piece in case[0].split("@"):
            parts += [piece, F.col("o_orderkey")]
        source = F.when(F.col("o_orderkey") % len(_CASES) == k, written(*parts[:-1])).otherwise(source)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"))
    engine = Engine(spark, _RULES, ParseOptions(slots=True, validated_protocols=("https",)))
    wanted = F.array(*[F.lit(c[1]) for c in _CASES])
    found = engine.validate(rows, "o_orderkey").filter(F.array_contains(wanted, F.col("error_id")))
    return found.select("o_orderkey", "error_id", "level", F.when(F.col("error_id") != "fence-tag-error", F.col("message")).alias("message"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'function-undefined' WHEN 1 THEN 'parameter-undefined' WHEN 2 THEN 'parameter-type-invalid' ELSE 'parameter-missing-required' END AS error_id,
  CASE p_partkey % 4 WHEN 0 THEN 'Undefined function: ''nope''' WHEN 1 THEN 'Invalid parameter: ''size''' WHEN 2 THEN 'Parameter ''0'' of ''pick'' must be type of ''Number''' ELSE 'Missing required parameter: ''0''' END AS message FROM part""")
def validate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls checked against declared functions, by the kernel."""
    k = F.col("p_partkey") % 4
    call = F.when(k == 0, "nope(1)").when(k == 1, written("pick(1, size=", F.col("p_size"), ")")).when(k == 2, 'pick("x")').otherwise('pick(name="x")')
    rows = read(spark, sf_dir, "part").select("p_partkey", written("{% row v=", call, " /%}\n").alias("source"))
    return Engine(spark, _CALLS).validate(rows, "p_partkey").select("p_partkey", "error_id", "message")


@query("""SELECT 1 AS code, count(*) AS n FROM customer""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of a run over all customers' documents, one of which has an error."""
    first = F.col("c_custkey") == 0
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(first, F.lit("{% nope /%}\n")).otherwise(written("# ", F.col("c_name"), "\n")).alias("source"))
    code = exit_code(Engine(spark).validate(rows, "c_custkey"))
    return rows.agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"))


# ---- extension points


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'Attribute ''code'' must match /^S/. Got ''x' || s_suppkey || ''' instead.' END AS message,
  '<article><b code="' || CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 'x' END || s_suppkey || '" size="' || s_suppkey * 2 || '">' || upper(s_name) || '</b></article>' AS html FROM supplier""")
def own_types_patterns_and_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute type, a pattern, a function and a transform hook, all in Python."""
    double = AttributeType("Double", lambda v, c, k: [], lambda v, c: v * 2)
    config = Config.of(
        {"item": Schema("b", attributes={"code": Attribute("String", matches=Pattern(lambda s: s.startswith("S"), "/^S/")), "size": Attribute(double)})},
        functions={"shout": Function(lambda p, c: str(p["0"]).upper())},
    )
    code = written(F.when(F.col("s_suppkey") % 2 == 0, "S").otherwise("x"), F.col("s_suppkey"))
    source = written('{% item code="', code, '" size=', F.col("s_suppkey"), ' %}{% shout("', F.col("s_name"), '") %}{% /item %}\n')
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", written("x ", source).alias("source"))
    engine = Engine(spark, config)
    problems = engine.validate(rows, "s_suppkey").select("s_suppkey", "message")
    html = engine.render(rows).select("s_suppkey", F.regexp_replace("html", "<p>x |</p>", "").alias("html"))
    return html.join(problems, "s_suppkey", "left").select("s_suppkey", "message", "html")


class Dashes:
    """A renderer that writes names instead of markup."""

    def open(self, element):
        return f"({element.name} "

    def close(self, element):
        return ")"

    def text(self, text):
        return text

    def number(self, number):
        return f"#{number:g}"


@query("""SELECT n_nationkey, '(article (h2 ' || n_name || ' #' || n_regionkey || '))' AS text FROM nation""")
def own_renderer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's own renderer."""
    source = written("## ", F.replace(F.col("n_name"), F.lit("_"), F.lit("\\_")), " {% $r %}\n")
    rows = read(spark, sf_dir, "nation").select("n_nationkey", source.alias("source"), F.to_json(F.struct(F.col("n_regionkey").alias("r"))).alias("v"))
    return Engine(spark, renderer=Dashes()).render(rows, variables="v", html="text").select("n_nationkey", "text")


class PlainLines:
    """A host's own tokenizer: every line with a word is a paragraph, nothing but a tag is markup."""

    def blocks(self, source: str, comments: bool) -> Tokens:
        root, at, lines = Block("document", 0, 0), 0, source.split("\n")
        for k, text in enumerate(lines):
            if text.strip():
                root.children.append(Block("paragraph", k, at, text=[(text, at)], end_line=k + 1, end=at + len(text)))
            at += len(text) + 1
        return Tokens(root, len(lines))

    def inline(self, text: str, references: dict, comments: bool) -> list[list]:
        events, done = [], 0
        for start, stop in masked(text)[1]:
            events += [["text", text[done:start], (done, start)]] * (start > done) + [["tag", text[start + 2 : stop - 2], (start, stop)]]
            done = stop
        return events + [["text", text[done:], (done, len(text))]] * (len(text) > done)


@query("""SELECT s_suppkey, '<article><p># ' || s_name || ' *not marked*</p><p>- nation <b>' || s_nationkey || '</b></p></article>' AS html, 15 + length(s_name) AS first_end FROM supplier""")
def own_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's own tokenizer under the same tags; places of nodes count its offsets."""
    source = written("# ", F.col("s_name"), " *not marked*\n\n- nation {% b %}{% $n %}{% /b %}")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", source.alias("source"), F.to_json(F.struct(F.col("s_nationkey").alias("n"))).alias("v"))
    engine = Engine(spark, Config.of({"b": Schema("b")}), ParseOptions(tokenizer=PlainLines()))
    first = engine.parse(rows, "s_suppkey").filter("type = 'paragraph' and loc.start.offset = 0").select(F.col("s_suppkey").alias("k"), F.col("loc.end.offset").cast("long").alias("first_end"))
    return engine.render(rows, variables="v").join(first, F.col("k") == F.col("s_suppkey")).select("s_suppkey", "html", "first_end")


@query("""SELECT s_suppkey, 'see {% xxxx ' || repeat('x', length('id="*' || s_suppkey || '"')) || ' %} *it* {% open' AS masked FROM supplier""")
def segment_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked copy of a paragraph: bodies of tags written over, an open delimiter left."""
    sql.register(spark)
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", written('see {% item id="*', F.col("s_suppkey"), '" %} *it* {% open').alias("source"))
    view = f"masks_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    return spark.sql(f"SELECT s_suppkey, masked FROM {view}, LATERAL md_segments(source)")


@query("""SELECT o_orderkey, 'order ' || o_orderkey AS message FROM orders WHERE o_orderstatus = 'F'""")
def hook_with_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation hook that sees its ancestors."""

    def hook(node, config):
        inside = any(n.tag == "outer" for n in config.parents)
        return [Problem("inside", "info", str(node.attributes["t"]))] if inside else []

    config = Config.of({"outer": Schema("div"), "inner": Schema("i", attributes={"t": Attribute("String")}, validate=hook)})
    inner = written('{% inner t="order ', F.col("o_orderkey"), '" /%}\n')
    source = F.when(F.col("o_orderstatus") == "F", written("{% outer %}\n", inner, "{% /outer %}\n")).otherwise(inner)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"))
    return Engine(spark, config).validate(rows, "o_orderkey").filter("error_id = 'inside'").select("o_orderkey", "message")


# ---- Markdown


@query("""SELECT c_custkey, '<article><blockquote><p><strong>' || c_name || '</strong> <em>' || c_mktsegment || '</em><br><s>old</s> <code>' || c_nationkey || '</code></p></blockquote><hr><p><a href="/c/' || c_custkey || '" title="t">see</a> <img src="/i.png" alt="' || c_mktsegment || '"></p><ol start="3"><li><p>a</p></li><li><p>b</p><ul><li>c</li></ul></li></ol></article>' AS html FROM customer""")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, emphasis, breaks, rules, links, images, loose and nested lists."""
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("\\#"))
    parts = ["> **", name, "** *", F.col("c_mktsegment"), "*\\\n> ~~old~~ `", F.col("c_nationkey"), "`\n\n***\n\n[see](/c/", F.col("c_custkey"), ' "t") ![', F.col("c_mktsegment"), "](/i.png)\n\n3. a\n\n4. b\n   - c\n"]
    rows = read(spark, sf_dir, "customer").select("c_custkey", written(*parts).alias("source"))
    return Engine(spark).render(rows).select("c_custkey", "html")


@query("""SELECT event_id, '<article><pre data-language="js">k = ' || CAST(json_extract(props, '$.k') AS VARCHAR) || ';' || CASE WHEN event_type = 'click' THEN chr(10) || 'click();' ELSE '' END || chr(10) || 'end' || chr(10) || '</pre><p>a </p></article>' AS html FROM events""")
def render_process_and_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags inside a processed fence; comments that go."""
    source = "```js {% process=true %}\nk = {% $p.k %};\n{% if equals($t, \"click\") %}\nclick();\n{% /if %}\nend\n```\n\na <!-- b -->\n\n<!-- c\nd -->\n"
    own = F.to_json(F.struct(F.from_json("props", "k bigint").alias("p"), F.col("event_type").alias("t")))
    rows = read(spark, sf_dir, "events").select("event_id", F.lit(source).alias("source"), own.alias("v"))
    return Engine(spark, options=ParseOptions(allow_comments=True)).render(rows, variables="v").select("event_id", "html")


# ---- parsing


@query("""SELECT p_partkey, '{"$$mdtype":"Node","attributes":{"content":"' || trim(p_name) || '"},"slots":{},"children":[],"errors":[],"lines":[0,1],"type":"text","annotations":[],"inline":true}' AS text FROM part""")
def ast_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each document as JSON: the text node of a paragraph."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.trim("p_name").alias("source"))
    tree = Engine(spark, options=ParseOptions(location=False)).ast_json(rows)
    text = F.regexp_extract("ast", r'\{"\$\$mdtype":"Node","attributes":\{"content".*?"inline":true\}', 0)
    return tree.select("p_partkey", text.alias("text"))


@query("""SELECT s_suppkey, 'tag' AS kind, 2 AS line, ' item ' || s_suppkey || ' /' AS body FROM supplier UNION ALL SELECT s_suppkey, 'paragraph', 0, NULL FROM supplier UNION ALL SELECT s_suppkey, 'list', 4, NULL FROM supplier
  UNION ALL SELECT s_suppkey, 'item', 4, NULL FROM supplier UNION ALL SELECT s_suppkey, 'paragraph', 4, NULL FROM supplier""")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and block tags by the SQL table function."""
    sql.register(spark)
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", written(F.col("s_name"), "\n\n{% item ", F.col("s_suppkey"), " /%}\n\n- a\n").alias("source"))
    view = f"segments_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    return spark.sql(f"SELECT s_suppkey, kind, line, body FROM {view}, LATERAL md_segments(source)")


@query("""WITH c AS (SELECT c_custkey, c_name AS n, c_custkey % 4 AS k FROM customer), r AS (
    SELECT c_custkey, n, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 12 + length(n) ELSE 24 + length(n) END AS start, k FROM c
  ) SELECT c_custkey, start::INTEGER AS start, (start + CASE k WHEN 0 THEN 11 + length(n) WHEN 1 THEN 9 + length(n) WHEN 2 THEN 9 + length(n) ELSE 16 + length(n) END)::INTEGER AS stop FROM r""")
def comment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment blocks over several lines: in a quote, an item, behind text (of which an inline comment is none), and behind a fence in a quote whose own comment is code."""
    sql.register(spark)
    n, key = F.col("c_name"), F.col("c_custkey")
    quote, item = written("> <!-- ", n, "\n> -->\n"), written("1. <!-- ", n, "\n--> gone\nafter\n")
    behind = written("x <!-- ", n, "\n-->\n<!--", n, "\n\n--> {% no /%}\n")
    fence = written("> ```\n> <!-- a\n> ", n, "\n> ```\n<!--\n{% no %}", n, "-->\n")
    source = F.when(key % 4 == 0, quote).when(key % 4 == 1, item).when(key % 4 == 2, behind).otherwise(fence)
    view = f"comments_{uuid.uuid4().hex}"
    read(spark, sf_dir, "customer").select("c_custkey", source.alias("source")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT c_custkey, start, stop FROM {view}, LATERAL md_comments(source)")


@query("""SELECT p_partkey, 17 + length(p_brand) AS tag_end, '{"a":[1,{"$$mdtype":"Variable","path":["x",' || p_size || ']}],"b":"' || p_brand || '"}' AS value, '{a: [1, $x[' || p_size || ']], b: "' || p_brand || '"}' AS source FROM part""")
def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a tag past quoted delimiters; a value parsed and printed again."""
    text = written('ab {% x "%} \\" ', F.col("p_brand"), '" %} c')
    value = parse_value_column(written("{a: [1, $x[", F.col("p_size"), ']], b: "', F.col("p_brand"), '",}'))
    return read(spark, sf_dir, "part").select("p_partkey", tag_end_column(text).cast("long").alias("tag_end"), value.alias("value"), format_value_column(value).alias("source"))


@query("""SELECT o_orderkey, 8 + length(CAST(o_orderkey AS VARCHAR)) AS start_offset, 2 AS start_line, 0 AS start_column, 16 + length(CAST(o_orderkey AS VARCHAR)) AS end_offset FROM orders""")
def node_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, columns and byte offsets of a tag behind a line with characters of two and four bytes."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", written("é😀\n", F.col("o_orderkey"), "\n{% a /%}\n").alias("source"))
    tags = parse_nodes(rows, "o_orderkey", columns=("loc",), types=("tag",))
    start, end = F.col("loc.start"), F.col("loc.end")
    return tags.select("o_orderkey", start["offset"].cast("long").alias("start_offset"), start["line"].alias("start_line"), start["column"].alias("start_column"), end["offset"].cast("long").alias("end_offset"))


# ---- printers


@query("""SELECT c_custkey, '{% card' || chr(10) || '   name="' || c_name || '"' || chr(10) || '   segment="' || c_mktsegment || '"' || chr(10) || '   balance=1' || chr(10) || '   note="a rather long text that does not fit" %}' || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || '| a | bb |' || chr(10) || '| - | -- |' || chr(10) || '| ' || 'c' || ' | d  |' || chr(10) || '{% /card %}' || chr(10) AS text FROM customer""")
def format_long_tags_lists_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide tags one attribute a line, counted lists, padded pipe tables."""
    parts = ['{% card name="', F.col("c_name"), '"   segment="', F.col("c_mktsegment"), '" balance=1 note="a rather long text that does not fit" %}\n1. one\n1. two\n\n|a|bb|\n|-|-|\n|c|d|\n{% /card %}\n']
    rows = read(spark, sf_dir, "customer").select("c_custkey", written(*parts).alias("source"))
    return Engine(spark, formatting=FormatOptions(ordered_list_mode="increment")).format(rows).select("c_custkey", "formatted.text")


# ---- SQL and streams


@query("""SELECT s_suppkey, '<article><h1>' || s_name || '</h1></article>' AS html, '# ' || s_name || chr(10) AS canonical, 'x' AS tag, '6' AS shouted FROM supplier""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine through SQL alone."""
    sql.register(spark)
    sql.register_function(spark, "md_twice", Function(lambda p, c: p["0"] * 2))
    view = f"suppliers_{uuid.uuid4().hex}"
    read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('#   ', replace(s_name, '#', '\\\\#'), '\\n') AS source").createOrReplaceTempView(view)
    return spark.sql(f"""SELECT s_suppkey, md_html(source, null) AS html, replace(md_format(source), '\\\\#', '#') AS canonical, md_parse_tag('x a=1').name AS tag, md_twice('{{"0": 3}}') AS shouted FROM {view}""")


@query("""SELECT p_partkey, '<article><h1 id="p' || p_partkey || '">' || p_name || ' </h1></article>' AS html FROM part""")
def stream_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading documents rendered as a stream to its end."""
    table = read(spark, sf_dir, "part")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/part*.parquet")
    docs = stream.select("p_partkey", written("# ", F.col("p_name"), " {% #p", F.col("p_partkey"), " %}\n").alias("source"))
    return drained(render_stream(Engine(spark), docs).select("p_partkey", "html"))


@query("""SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS version, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'new' ELSE 'late' END AS status, 'Order ' || o_orderkey AS source FROM orders""")
def stream_newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's document, streamed to the end: the newest of each document, all others late."""
    table = read(spark, sf_dir, "orders")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/orders*.parquet")
    docs = stream.select("o_custkey", "o_orderkey", "o_orderdate", written("Order ", F.col("o_orderkey")).alias("source"))
    found = drained(newest_versions(docs, "o_custkey", "o_orderkey", "o_orderdate", idle=timedelta(days=36500)))
    return found.select("doc_id", "version", "status", "source")
