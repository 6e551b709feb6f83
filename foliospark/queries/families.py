"""Queries by family: one case a row, its whole output held against a text that SQL puts together.

A case is a source and what it must give, both with @ where the row's key stands; a row takes the
case that its key names, so every table row runs and every case occurs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.functions import sql
from foliospark.functions.document import Function
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.schema import Attribute, Config, Schema, Slot
from foliospark.kernel.transform import Element
from foliospark.kernel.transform import children as render_children
from foliospark.kernel.tree import Problem
from foliospark.operators.vocabularies import render_by_vocabulary, validate_by_vocabulary
from foliospark.queries.registry import query, read
from foliospark.sources.documents import read_config, read_documents, shared_folder
from foliospark.sources.sinks import diff_column, exit_code, format_code, utf16_position, write_formatted, write_html


def _text(value: str) -> str:
    """A text as SQL writes it; the @ in it is the row's key."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def expected(table: str, key: str, cases: list[tuple[str, str]], column: str, wrap: str = "@@") -> str:
    """SQL of (key, column): each row's case, `wrap` holding it where it says @@."""
    whens = " ".join(f"WHEN {k} THEN {_text(wrap.replace('@@', case[1]))}" for k, case in enumerate(cases))
    return f"SELECT {key}, replace(CASE {key} % {len(cases)} {whens} END, '@', CAST({key} AS VARCHAR)) AS {column} FROM {table}"


def sources(df: DataFrame, key: str, cases: list[tuple[str, str]]) -> DataFrame:
    """(key, source) of each row's case."""
    source: Column = F.lit("")
    for k, case in enumerate(cases):
        source = F.when(F.col(key) % len(cases) == k, F.replace(F.lit(case[0]), F.lit("@"), F.col(key).cast("string"))).otherwise(source)
    return df.select(key, source.alias("source"))


# ---- blocks

_BLOCKS = [
    ("- {% wrap %}\n  x @\n  {% /wrap %}\n", "<ul><li><div><p>x @</p></div></li></ul>"),
    ("> {% wrap %}\n> x @\n> {% /wrap %}\n", "<blockquote><div><p>x @</p></div></blockquote>"),
    ("> a @\nb\n>\n> c", "<blockquote><p>a @ b</p><p>c</p></blockquote>"),
    ("1. a\n\n   b @\n2. c", "<ol><li><p>a</p><p>b @</p></li><li><p>c</p></li></ol>"),
    ("a @\n{% wrap %}\nb\n{% /wrap %}\nc\n", "<p>a @</p><div><p>b</p></div><p>c</p>"),
    ("a @\n    {% wrap %}\nb\n    {% /wrap %}\nc\n", "<p>a @</p><div><p>b</p></div><p>c</p>"),
    ("    code @\n", "<pre>code @\n</pre>"),
    ("    {% wrap %}\n    x @\n    {% /wrap %}\n", "<div><pre>x @\n</pre></div>"),
    ("a @\n===", "<p>a @ ===</p>"),
    ("a @\n---\nb", "<p>a @</p><hr><p>b</p>"),
    ("<div>@</div>\n\n*a*", "<p>&lt;div&gt;@&lt;/div&gt;</p><p><em>a</em></p>"),
    ("a <!-- b @\n\nc", "<p>a &lt;!-- b @</p><p>c</p>"),
    ("a <!-- b --> @ <!-- c\n\n-->", "<p>a  @ &lt;!-- c</p><p>--&gt;</p>"),
    ("x {% nope %}y{% /nope %} z@", "<p>x y z@</p>"),
    ("a &amp; &#55; \\& @", "<p>a &amp; 7 &amp; @</p>"),
    ("a `b  @` ``c`d``", "<p>a <code>b  @</code> <code>c`d</code></p>"),
    ("* a\n  * b\n  * ```js\n    c@\n    ```\n  * d\n", '<ul><li>a<ul><li>b</li><li><pre data-language="js">c@\n</pre></li><li>d</li></ul></li></ul>'),
]


@query(expected("customer", "c_custkey", _BLOCKS, "html", "<article>@@</article>"))
def render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, continuations, splits, merges, comments, and the rules of Markdown that are undone."""
    engine = Engine(spark, Config.of({"wrap": Schema("div")}), ParseOptions(allow_comments=True))
    return engine.render(sources(read(spark, sf_dir, "customer"), "c_custkey", _BLOCKS)).select("c_custkey", "html")


_DEEP = 512


@query(f"SELECT s_suppkey, '<article>' || repeat('<blockquote>', {_DEEP - 1}) || repeat('</blockquote>', {_DEEP - 1}) || '</article>' AS html, '<article><p>s' || s_suppkey || '</p></article>' AS flat FROM supplier")
def render_too_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels below the 512th render nothing; an unbalanced run of brackets as deep is text."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.repeat(F.lit("> "), F.lit(600)), F.lit("x")).alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("short"))
    engine = Engine(spark)
    return engine.render(engine.render(rows), "short", html="flat").select("s_suppkey", "html", "flat")


# ---- slots


@query("""SELECT s_suppkey, '[{"$$mdtype":"Tag","name":"article","attributes":{},"children":[{"$$mdtype":"Tag","name":"section","attributes":{"id":"s' || s_suppkey || '","title":[{"$$mdtype":"Tag","name":"p","attributes":{},"children":["' || s_name || '"]}]},"children":[{"$$mdtype":"Tag","name":"p","attributes":{},"children":["Nation ' || s_nationkey || '"]}]}]}]' AS tree FROM supplier""")
def transform_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots as attributes of the whole renderable tree: one under its own name, one under another key's, one not rendered."""
    config = Config.of({"panel": Schema("section", slots={"head": Slot(render="title"), "quiet": Slot(render=False)})})
    parts = ['{% panel #s@ %}\n\n{% slot "head" %}\n', "\n{% /slot %}\n\n{% slot \"quiet\" %}\nunseen\n{% /slot %}\n\nNation ", "\n\n{% /panel %}\n"]
    source = F.concat(F.replace(F.lit(parts[0]), F.lit("@"), F.col("s_suppkey").cast("string")), F.replace(F.col("s_name"), F.lit("#"), F.lit("\\#")), F.lit(parts[1]), F.col("s_nationkey").cast("string"), F.lit(parts[2]))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", source.alias("source"))
    return Engine(spark, config, ParseOptions(slots=True)).renderable_json(rows, column="tree").select("s_suppkey", "tree")


# ---- types and messages

_HAS = Config.of(
    {
        "box": Schema("div", attributes={"v": Attribute("String", matches=["a"]), "o": Attribute("Object"), "l": Attribute("Array"), "t": Attribute("String")}, slots={"head": Slot()}),
        "needs": Schema("div", slots={"head": Slot(required=True)}),
    }
)
_VALUES = 'Expected "[", "{", boolean, identifier, null, number, string, or variable but '

#: (source, the messages of all problems, one a line)
_TYPES = [
    ("# a@ {% class=1 %}", "Attribute 'class' must be type 'string | object'"),
    ("# a {% class=true %}\n\nb @", "Attribute 'class' must be type 'string | object'"),
    ('# a@ {% id="1@" %}', "The 'id' attribute must start with a letter"),
    ('{% if "x@" %}\na\n{% /if %}', "Attribute 'primary' must be type 'boolean | object' (null or undefined are also allowed)"),
    ("{% if @ %}\na\n{% /if %}", "Attribute 'primary' must be type 'boolean | object' (null or undefined are also allowed)"),
    ('{% partial file="p@.md" /%}', "Partial `p@.md` not found. The 'file' attribute must be set in `config.partials`"),
    ("{% partial file=@ /%}", "Partial `Number(@.0)` not found. The 'file' attribute must be set in `config.partials`"),
    ('{% partial file=[@, "a", null] /%}', "Partial `Array([Number(@.0), String(\"a\"), Null])` not found. The 'file' attribute must be set in `config.partials`"),
    ("{% partial file={k@: true, l: []} /%}", "Partial `Hash({\"k@\": Boolean(true), \"l\": Array([])})` not found. The 'file' attribute must be set in `config.partials`"),
    ("{% box v=[@, null, [2]] /%}", "Attribute 'v' must be type of 'String'\nAttribute 'v' must match one of [\"a\"]. Got '@,,2' instead."),
    ("{% box v={a: @} /%}", "Attribute 'v' must be type of 'String'\nAttribute 'v' must match one of [\"a\"]. Got '[object Object]' instead."),
    ("{% box v=@ /%}", "Attribute 'v' must be type of 'String'\nAttribute 'v' must match one of [\"a\"]. Got '@' instead."),
    ("``` {% a= %}\nx @\n```", f"Syntax error in fence tag: {_VALUES}end of input found."),
    ("{% box t=(@ /%}", f'{_VALUES}"(" found.'),
    ("{% box l=[@ 2] /%}", 'Expected ",", "]", or whitespace but "2" found.'),
    ("{% needs %}\nx @\n{% /needs %}", "Missing required slot: 'head'"),
    ('{% box %}\n{% slot "no@" %}\nx\n{% /slot %}\n{% /box %}', "Invalid slot: 'no@'"),
    ("{% box %}\n{% slot @ %}\nx\n{% /slot %}\n{% /box %}", "Attribute 'primary' must be type of 'String'"),
    ("{% box t=" + "[" * 70 + "@" + "]" * 70 + " /%}", "Value nesting exceeds the maximum depth of 64."),
    ("# clean @", ""),
]


def _messages(engine: Engine, rows: DataFrame, key: str) -> DataFrame:
    """(key, messages) of every row, one a line in order."""
    found = engine.validate(rows, key)
    order = [c for c in ("node_id", "pos") if c in found.columns]
    lines = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "message"))).alias("m"))
    lines = lines.select(F.col(key).alias("__key"), F.array_join(F.transform("m", lambda m: m["message"]), "\n").alias("messages"))
    return rows.join(lines.hint("merge"), F.col(key) == F.col("__key"), "left").select(key, F.coalesce("messages", F.lit("")).alias("messages"))


@query(expected("part", "p_partkey", _TYPES, "messages"))
def validate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, id, condition and partial types, values as text, slots, and the words of syntax errors."""
    return _messages(Engine(spark, _HAS, ParseOptions(slots=True)), sources(read(spark, sf_dir, "part"), "p_partkey", _TYPES), "p_partkey")


@query(expected("part", "p_partkey", _TYPES, "messages"))
def validate_types_by_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages by the kernel."""
    engine = Engine(spark, _HAS, ParseOptions(slots=True))
    engine.validate = engine.validate_by_kernel
    return _messages(engine, sources(read(spark, sf_dir, "part"), "p_partkey", _TYPES), "p_partkey")


# ---- hooks


@query("""SELECT n_nationkey, '<article><h2 data-n="' || n_nationkey || '"><p>' || n_name || '</p></h2><em><p>found</p></em></article>' AS html,
  CASE WHEN n_nationkey % 2 = 1 THEN 'odd ' || n_nationkey || ' in title' || chr(10) ELSE '' END || CASE WHEN n_regionkey > 1 THEN 'Attribute ''r'' must match one of ["0","1"]. Got ''' || n_regionkey || ''' instead.' || chr(10) ELSE '' END || 'call of n with 1' AS messages FROM nation""")
def own_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform hook, an attribute's validation hook, matches by a callable, a function's validation hook, and schemas by a source."""

    def title(node, config):
        return Element("h2", {"data-n": node.attributes["n"]}, render_children(node, config))

    def odd(value, config, key):
        return [Problem("odd", "info", f"odd {value:g} in title")] if value % 2 else []

    def called(call, config):
        return [Problem("called", "info", f"call of n with {len(call.parameters)}")]

    schema = Schema("p", attributes={"n": Attribute("Number", validate=odd), "r": Attribute("String", matches=lambda config: ["0", "1"]), "c": Attribute()}, transform=title)
    config = Config.of({"title": schema}, functions={"n": Function(lambda p, c: 1, parameters={"0": Attribute("Number")}, validate=called)}, validate_functions=True, source=lambda kind, name: Schema("em") if name == "sourced" else None)
    parts = [F.lit("{% title n="), F.col("n_nationkey"), F.lit(' r="'), F.col("n_regionkey"), F.lit('" c=n(1) %}\n'), F.replace(F.col("n_name"), F.lit("_"), F.lit("\\_")), F.lit("\n{% /title %}\n\n{% sourced %}\nfound\n{% /sourced %}\n")]
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(*[p.cast("string") for p in parts]).alias("source"))
    engine = Engine(spark, config)
    messages = _messages(engine, rows, "n_nationkey").withColumnRenamed("n_nationkey", "__n")
    return engine.render(rows).join(messages, F.col("n_nationkey") == F.col("__n")).select("n_nationkey", "html", "messages")


# ---- printers

_PRINTED = [
    ("*a @* _b_ **c** ~~e~~ `f`", "*a @* _b_ **c** ~~e~~ `f`\n"),
    ("[a](/b  'it \"t\" @')  ![i](</c d> )", '[a](/b "it \\"t\\" @")  ![i](</c d>)\n'),
    ("<https://a.example/@>", "<https://a.example/@>\n"),
    ("> a @\n> b\n>> c", "> a @\n> b\n> \n> > c\n"),
    ("***\n\na @\n\n___", "---\n\na @\n\n---\n"),
    ("```js {% process=true %}\nx @\n```", "```js {% process=true %}\nx @\n```\n"),
    ("~~~\n``` @\n~~~", "````\n``` @\n````\n"),
    ("# A @ #\n\nB\n===", "# A @\n\nB\n===\n"),
    ("* a @\n* b\n\n\n* c", "* a @\n\n* b\n\n* c\n"),
    ("a  \nb\\\nc @", "a\\\nb\\\nc @\n"),
    ("{% wrap   a=1 %}\nx @\n{% /wrap %}", "{% wrap a=1 %}\nx @\n{% /wrap %}\n"),
    ('x {% mark   v="@" /%} y', 'x {% mark v="@" /%} y\n'),
    ("{% table %}\n* a\n* b @\n---\n* c\n* d\n{% /table %}", "{% table %}\n- a\n- b @\n---\n- c\n- d\n{% /table %}\n"),
    ("**a\\*b @**", "**a\\*b @**\n"),
    ("\\# a @", "\\# a @\n"),
    ("a @ {% #i .k %}", "a @ {% #i .k %}\n"),
]


@query(expected("customer", "c_custkey", _PRINTED, "text"))
def format_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline and block printers, destinations, titles and escapes."""
    return Engine(spark).format(sources(read(spark, sf_dir, "customer"), "c_custkey", _PRINTED)).select("c_custkey", "formatted.text")


@query("""SELECT s_suppkey, 's' || s_suppkey || '.md: CRLF line endings; fmt writes LF' || chr(10) || '--- a/s' || s_suppkey || '.md' || chr(10) || '+++ b/s' || s_suppkey || '.md' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' # S' || chr(10) || ' ' || chr(10) || '-*  a' || s_suppkey || chr(10) || '+* a' || s_suppkey || chr(10) AS diff,
  '# S' || chr(10) || chr(10) || '* a' || s_suppkey || chr(10) AS source, 1 AS code FROM supplier""")
def format_check_and_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole diff of each document, the code of a check, and the texts written and read again."""
    key = F.col("s_suppkey").cast("string")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), key, F.lit(".md")).alias("file"), F.concat(F.lit("# S\r\n\r\n*  a"), key, F.lit("\r\n")).alias("source"))
    done = Engine(spark).format(rows)
    folder = f"{shared_folder(spark)}/formatted"
    write_formatted(done, folder)
    written = spark.read.parquet(folder).select(F.col("file").alias("__file"), F.col("source").alias("__text"))
    met = done.join(written, F.col("file") == F.col("__file"))
    return met.select("s_suppkey", diff_column("file", "source", F.col("formatted.text")).alias("diff"), F.col("__text").alias("source"), F.lit(format_code(done)).alias("code"))


# ---- whole trees and diagnostics as JSON


@query(
    """SELECT o_orderkey, '{"file":"o' || o_orderkey || '.md","errors":[{"type":"tag","lines":[0,1],"location":{"file":"o' || o_orderkey || '.md","start":{"line":0,"character":4,"offset":4,"byteOffset":7},"end":{"line":0,"character":'
  || (17 + n) || ',"offset":' || (17 + n) || ',"byteOffset":' || (20 + n) || '}},"error":{"id":"tag-undefined","level":"critical","message":"Undefined tag: ''no' || o_orderkey || '''"}}]}' AS json, 4 AS character, 4 AS utf16_offset, 7 AS byte_offset
  FROM (SELECT o_orderkey, 2 * length(CAST(o_orderkey AS VARCHAR)) - 1 AS n FROM orders)"""
)
def diagnostics_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of each document as whole JSON, places in UTF-16 units and bytes behind characters of two and four bytes."""
    key = F.col("o_orderkey").cast("string")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("o"), key, F.lit(".md")).alias("file"), F.concat(F.lit("é😀 {% no"), key, F.lit(" a="), key, F.lit(" /%}\n")).alias("source"))
    engine = Engine(spark)
    found = rows.withColumn("json", engine.kernels.diagnostics_json(F.col("source"), F.col("file")))
    at = utf16_position(F.col("source"), F.struct(F.lit(0).alias("line"), F.lit(7).alias("column"), F.lit(7).alias("offset")))
    return found.select("o_orderkey", "json", at["character"].cast("int").alias("character"), at["offset"].cast("int").alias("utf16_offset"), at["byteOffset"].cast("int").alias("byte_offset"))


def _node_json(kind: str, end: str, children: str, attributes: str = "{}", inline: str = "false") -> str:
    """SQL of a node of a document that is one line of plain text."""
    return f"""'{{"$$mdtype":"Node","attributes":' || {attributes} || ',"slots":{{}},"children":[' || {children} || '],"errors":[],"lines":[0,1],"type":"{kind}","annotations":[],"inline":{inline},"location":{{"start":{{"line":0,"character":0,"offset":0,"byteOffset":0}},"end":' || {end} || '}}}}'"""


_END = """'{"line":0,"character":' || n || ',"offset":' || n || ',"byteOffset":' || n || '}'"""
_AST = _node_json("document", _END, _node_json("paragraph", _END, _node_json("inline", _END, _node_json("text", _END, "''", """'{"content":"' || t || '"}'""", "true"))))


@query(f"SELECT p_partkey, {_AST} AS ast FROM (SELECT p_partkey, trim(p_name) AS t, length(trim(p_name)) AS n FROM part)")
def ast_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree of each document as JSON."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.trim("p_name").alias("source"))
    return Engine(spark).ast_json(rows).select("p_partkey", "ast")


# ---- runs, files and declarations


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS code FROM nation""")
def exit_codes_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 for clean documents and warnings, 1 for errors, 2 where a document could not be read: a run each, and the worst of a row's kind."""
    config = Config.of({"w": Schema("i", inline=True, attributes={"n": Attribute("Number", error_level="warning")})})
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'a {% w n=\"x\" /%}\\n' WHEN 1 THEN '{% nope /%}\\n' END").alias("source"), F.expr("CASE WHEN n_nationkey % 3 = 2 THEN 'stream did not contain valid UTF-8' END").alias("error"))
    engine, code = Engine(spark, config), F.lit(None).cast("int")
    for k in range(3):
        own = rows.filter(F.col("n_nationkey") % 3 == k)
        code = F.when(F.col("n_nationkey") % 3 == k, F.lit(exit_code(engine.validate(own, "n_nationkey"), own))).otherwise(code)
    return rows.select("n_nationkey", code.alias("code"))


@query("""SELECT 'n' || n_nationkey || '.md' AS name, '<article><h1>' || n_name || '</h1><p>Hello reader of set</p></article>' AS html FROM nation""")
def files_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read by path, a folder of partials, a vocabulary file, a NAME=VALUE setting, and the HTML written as text and read again."""
    folder = shared_folder(spark)
    name = F.replace(F.col("n_name"), F.lit("_"), F.lit("\\_"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("# "), name, F.lit('\n\n{% partial file="hello.md" /%}\n')).alias("source"))
    rows.write.partitionBy("n_nationkey").text(f"{folder}/docs")  # a folder a document
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for at, body in ((f"{folder}/partials/hello.md", "Hello {% $who %} of {% $title %}\n"), (f"{folder}/tags.yaml", '{"variables": {"who": "reader", "title": "file"}}')):
        path = fs.Path(at)
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(body.encode()))
        out.close()
    config = read_config(spark, f"{folder}/tags.yaml", f"{folder}/partials", ["title=set"])
    docs = read_documents(spark, f"{folder}/docs", recursive=True, glob="*.txt").filter("error is null")
    number = F.regexp_extract("file", r"n_nationkey=(\d+)", 1)
    html = Engine(spark, config).render(docs).select(F.concat(F.lit("n"), number, F.lit(".md|"), F.col("html")).alias("html"))
    write_html(html, f"{folder}/html", order="html")
    lines = spark.read.text(f"{folder}/html")
    return lines.select(F.substring_index("value", "|", 1).alias("name"), F.expr("substring(value, instr(value, '|') + 1)").alias("html"))


#: (path of the refusal or null, declaration); the @ is the row's name.
_DECLARATIONS = [
    ("config.tags.@.transform", {"tags": {"@": {"transform": "f"}}}),
    ("config.tags.@.render", {"tags": {"@": {"render": True}}}),
    ("config.tags.@.attributes.a.type", {"tags": {"@": {"attributes": {"a": {"type": "Text"}}}}}),
    ("config.tags.x.attributes.@.matches", {"tags": {"x": {"attributes": {"@": {"matches": "a|b"}}}}}),
    ("config.tags.x.attributes.a.errorLevel", {"tags": {"x": {"attributes": {"a": {"errorLevel": "@"}}}}}),
    ("config.tags.x.slots.@.required", {"tags": {"x": {"slots": {"@": {"required": "yes"}}}}}),
    ("config.tags.x.slots.s.size", {"tags": {"x": {"slots": {"s": {"size": 1}}}}}),
    ("config.nodes.tag", {"nodes": {"tag": {}}}),
    ("config.nodes.@", {"nodes": {"@": {}}}),
    ("config.functions", {"functions": {}}),
    (None, {"tags": {"@": {"slots": {"s": {"render": "t", "required": True}}}}, "variables": {"a": [1, {"b": None}]}}),
    (None, None),
]


def _vocabularies(rows: DataFrame, key: str) -> DataFrame:
    """(key, declaration): each row's declaration by its key, with the key in its names."""
    texts = F.array(*[F.lit(None if d is None else json.dumps(d)).cast("string") for _, d in _DECLARATIONS])
    text = F.get(texts, (F.col(key) % len(_DECLARATIONS)).cast("int"))
    return rows.select(key, F.replace(text, F.lit("@"), F.concat(F.lit("k"), F.col(key).cast("string"))).alias("declaration"))


def _path_sql(path: str | None) -> str:
    return "NULL" if path is None else "'" + path.replace("@", "k' || p_partkey || '") + "'"


_CASES = " ".join(f"WHEN {k} THEN {_path_sql(path)}" for k, (path, _) in enumerate(_DECLARATIONS))


@query(f"SELECT p_partkey, CASE p_partkey % {len(_DECLARATIONS)} {_CASES} END AS path, CASE p_partkey % {len(_DECLARATIONS)} WHEN 10 THEN 'k' || p_partkey WHEN 11 THEN '' END AS tags FROM part")
def declarations_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the declaration of each row goes wrong, by the SQL table function; the tags of those that are accepted."""
    sql.register(spark)
    view = f"declarations_{uuid.uuid4().hex}"
    _vocabularies(read(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView(view)
    return spark.sql(f"SELECT p_partkey, path, array_join(tags, ',') AS tags FROM {view}, LATERAL md_declaration(declaration)")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN NULL ELSE '<article><n' || c_nationkey || ' kind="k' || c_nationkey % 3 || '"><p>of ' || n_name || '</p></n' || c_nationkey || '></article>' END AS html,
  CASE WHEN c_nationkey % 5 = 4 THEN NULL WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS n_problems FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def documents_by_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary a nation, a fifth of them refused: the same tag renders by the vocabulary of each document's key, and its attribute is valid by it or not."""
    key, kind = F.col("n_nationkey").cast("string"), F.concat(F.lit("k"), (F.col("n_nationkey") % 3).cast("string"))
    start = F.when(F.col("n_nationkey") % 5 == 4, '{"tags": {"box": {"render": true').otherwise(F.concat(F.lit('{"tags": {"box": {"render": "n'), key, F.lit('"')))
    rest = F.concat(F.lit(', "attributes": {"kind": {"type": "String", "matches": ["'), kind, F.lit('"], "default": "'), kind, F.lit('"}}}}, "variables": {"name": "'), F.col("n_name"), F.lit('"}}'))
    vocabularies = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(start, rest).alias("declaration"))
    wrong = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(" other=1")
    docs = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("{% box"), wrong, F.lit(" %}\nof {% $name %}\n{% /box %}\n")).alias("source"))
    found = validate_by_vocabulary(render_by_vocabulary(docs, vocabularies, "c_nationkey"), vocabularies, "c_nationkey")
    return found.select("c_custkey", "html", F.when(F.col("problems").isNotNull(), F.size("problems")).alias("n_problems"))
