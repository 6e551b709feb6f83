"""The engine over tables: plans against kernels, sources, sinks, SQL functions, streams."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.functions import sql
from foliospark.functions.columns import md_default, md_equals, truthy, unsafe_link
from foliospark.functions.document import Function
from foliospark.functions.links import SETTLED, normalize_link
from foliospark.functions.numbers import js_number
from foliospark.kernel.blocks import Block
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.inline import unsafe_link as unsafe_text
from foliospark.kernel.schema import Attribute, AttributeType, Config, Pattern, Schema, Slot
from foliospark.kernel.tokenizer import Tokens, masked
from foliospark.kernel.tree import Problem
from foliospark.operators.nodes import parse_nodes
from foliospark.operators.vocabularies import render_by_vocabulary, validate_by_vocabulary, verdicts
from foliospark.operators.values import js_number_column, normalize_link_column
from foliospark.plans.analytics import error_rollup, outline
from foliospark.plans.partials import closure, includes
from foliospark.plans.render import render_nodes
from foliospark.sources.declare import DeclarationError, configure, declare, load_text, parse_variable
from foliospark.sources.documents import read_config, read_documents, read_partials, strip_frontmatter
from foliospark.sources.sinks import diagnostics_json, exit_code, format_check, format_code, human_lines, unified_diff, write_formatted, write_html, write_lines
from foliospark.streaming.documents import first_documents, problem_counts, render_stream, validate_stream, write_batches

SOURCES = [
    "# Title {% #t .a %}\n\nText *em* **st** `co` [l](/ä b) ![i](/c).\n",
    '{% callout type="loud" n="x" z=1 %}\n# no\n{% /callout %}\n{% nope /%}\n',
    "a {% callout %}b{% /callout %} {% icon %}x{% /icon %}\n\n{% icon /%}\n",
    '{% if $flag %}\na\n{% else $n /%}\nb\n{% else /%}\nc\n{% /if %}\n\n{% if false %}\n{% if true %}\nx\n{% /if %}\n{% else /%}\ny\n{% /if %}\n',
    "{% table %}\n* A\n---\n* 1 {% colspan=2 %}\n{% /table %}\n\n| a | b |\n|---|:-:|\n| 1 | <2> & \"3\" |\n",
    '- a\n  - b\n\n3. c\n\n> q\n\n```js\nx < 1\n```\n---\n',
    "{% callout type=$user.name n=$user.missing #9 /%}\n{% callout type=[1, null, [2]] n=1.5 class=3 /%}\n{% callout type=1000000000000000000000 /%}\n{% $x",
    '{% partial file="p" variables={a: 1} /%}\n{% partial file=3 /%}\n{% /callout %}\n{% callout type="tip" type="note" /%}\n{% slot "s" /%}\n{% if "x" /%}\n{% a= %}\n',
    "",
    None,
    "é 😀 {% nope /%}\n",
]
VARIABLES = {"flag": False, "n": 1.0, "user": {"name": "tip", "list": [1.0, {"k": None}]}}
CONFIG = Config.of(
    {"callout": Schema("aside", ("paragraph",), {"type": Attribute("String", required=True, matches=["note", "tip"]), "n": Attribute(("Number", "Boolean"), error_level="warning")}, slots={"s": Slot(required=True)}), "icon": Schema("i", inline=True, self_closing=True)},
    variables=VARIABLES,
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, s, f"d{k}.md") for k, s in enumerate(SOURCES)], "doc_id long, source string, file string")


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(r[k]) for k in keys or range(len(r))))


@pytest.mark.parametrize("config", [CONFIG, Config.of(CONFIG.tags), Config()], ids=["variables", "tags", "plain"])
def test_relational_validation_agrees_with_the_kernel(spark, docs, config):
    engine = Engine(spark, config)
    fields = ["error_id", "level", "message", "lines", "loc"]
    relational = engine.validate(docs, file="file").orderBy("doc_id", "node_id", "pos").select("doc_id", *fields).collect()
    kernel = engine.validate_by_kernel(docs, file="file").orderBy("doc_id", "pos").select("doc_id", *fields).collect()
    assert relational and relational == kernel


def test_validation_is_one_stage_without_python_after_the_parser(spark, docs):
    plan = Engine(spark, CONFIG).validate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("MapInArrow") == 1 and "BroadcastHashJoin" in plan


def test_relational_rendering_agrees_with_the_kernel(spark, docs):
    engine = Engine(spark, CONFIG)
    kernel = rows(engine.render(docs).filter("html is not null and html <> ''").select("doc_id", "html"))
    assert rows(engine.render_relational(docs)) == kernel and len(kernel) == len(SOURCES) - 1


def test_plain_prose_renders_natively_as_the_kernel_does(spark):
    import random

    from foliospark.functions.columns import is_plain
    from foliospark.kernel.build import parse
    from foliospark.kernel.render import render
    from foliospark.kernel.transform import transform

    rng = random.Random(1)
    pieces = ["a", "Bc", "é", "😀", " ", "  ", "\n", "\n\n", "\n\n\n", ".", "!", "1", "-", "=", "===", ">", '"', "'", "(", ")", "#", "+", ":", "/", "$", "%", "}", "@", ";", "\u3000", "\u00a0", "\x0b", "\r", "\t", "*", "x" * 30]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(6000)] + [None, "", "\n", " "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, source string")
    got = Engine(spark).render(df).select("doc_id", "html", is_plain(F.col("source")).alias("plain")).collect()
    assert sum(bool(r["plain"]) for r in got) > 1000
    for r in got:
        text = texts[r["doc_id"]]
        assert r["html"] == (None if text is None else render(transform(parse(text), Config()))), repr(text)
    own = Engine(spark, Config.of(nodes={"paragraph": Schema("div")}))
    assert own.render(spark.createDataFrame([("x",)], "source string")).first()["html"] == "<article><div>x</div></article>"


def test_documents_that_share_an_id_or_have_none_stay_apart(spark):
    texts = ["# A\n\n- one\n", "# B\n\ntwo\n", "# C\n", "# D\n\n{% if false %}\nno\n{% /if %}\n", "a\n\nb\n\nc\n\nd\n\ne\n", "{% void /%}\n", "{% void /%}\n"]
    ids = [1, 1, None, None, None, 2, 2]
    df = spark.createDataFrame([(i, f"f{k}", t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, file string, source string").repartition(3)
    engine = Engine(spark)
    each = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert each(engine.render_relational(df)) == each(engine.render(df).select("doc_id", "html").filter("html <> ''"))
    heads = outline(engine.parse(df))
    assert each(heads.select("doc_id", "ordinal", "text")) == each(spark.createDataFrame([(1, 1, "A"), (1, 1, "B"), (None, 1, "C"), (None, 1, "D")], "a long, b int, c string"))
    assert heads.select("_document").distinct().count() == 4
    kept = engine.select_branches(engine.parse(df)).filter("type = 'text'").select("doc_id", F.get("attrs", F.lit(0))["value"])
    assert each(kept) == each(spark.createDataFrame([(1, '"A"'), (1, '"B"'), (1, '"one"'), (1, '"two"'), *((None, f'"{c}"') for c in "CDabcde")], "a long, b string"))
    docs = engine.numbered(df)
    for found in (engine.validate(docs, file="file"), engine.validate_by_kernel(docs, file="file")):
        lines = [json.loads(r["json"]) for r in diagnostics_json(found, docs).collect()]
        assert sorted((x["file"], len(x["errors"])) for x in lines) == [(f"f{k}", int(k > 4)) for k in range(7)]
    assert error_rollup(engine.validate(df)).first()["n_docs"] == 2


def test_void_elements_have_no_content(spark):
    config = Config.of({"v": Schema("br"), "w": Schema("")})
    df = spark.createDataFrame([(1, "{% v %}\nx\n{% /v %}\n{% w %}\ny\n{% /w %}\n")], "doc_id long, source string")
    engine = Engine(spark, config)
    assert render_nodes(engine.transform(df), void_content=True).first()["html"] == engine.render(df).first()["html"] == "<article><br><p>y</p></article>"


def test_branches_agree_with_the_kernel(spark, docs):
    engine = Engine(spark, CONFIG)
    kept = engine.select_branches(engine.parse(docs.filter("doc_id = 3")))
    texts = [json.loads(r["v"]) for r in kept.filter("type = 'text'").orderBy("node_id").select(F.get("attrs", F.lit(0))["value"].alias("v")).collect()]
    assert texts == ["b", "y"]
    assert engine.render(docs.filter("doc_id = 3")).first()["html"] == "<article><p>b</p><p>y</p></article>"


def test_nodes_are_intervals_in_pre_order(spark, docs):
    nodes = parse_nodes(docs)
    assert nodes.filter("last_desc < node_id").isEmpty()
    a, b = nodes.alias("a"), nodes.alias("b")
    inside = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.node_id") > F.col("a.node_id")) & (F.col("b.node_id") <= F.col("a.last_desc")))
    by_interval = inside.select("a.doc_id", F.col("a.node_id").alias("up"), "b.node_id")
    by_path = nodes.select("doc_id", F.explode("path").alias("up"), "node_id")
    assert rows(by_interval) == rows(by_path)
    assert nodes.filter("doc_id = 9").isEmpty() and nodes.filter("doc_id = 8").count() == 1


def test_hooks_patterns_and_types_run_in_the_kernel(spark):
    upper = AttributeType("Upper", lambda v, c, k: [] if str(v).isupper() else [Problem("attribute-value-invalid", "error", "not upper")], lambda v, c: str(v).lower())

    def hook(node, config):
        return [Problem("too-deep", "info", str(len(config.parents)))]

    config = Config.of({"t": Schema("b", attributes={"u": Attribute(upper), "p": Attribute("String", matches=Pattern(lambda s: s.startswith("x"), "/^x/"))}, validate=hook)})
    df = spark.createDataFrame([(1, '{% t u="ab" p="y" /%}\n')], "doc_id long, source string")
    engine = Engine(spark, config)
    assert not config.is_relational
    assert [r["message"] for r in engine.validate(df).orderBy("pos").collect()] == ["not upper", "Attribute 'p' must match /^x/. Got 'y' instead.", "1"]
    assert engine.render(df).first()["html"] == '<article><b u="ab" p="y"></b></article>'


def test_row_variables_win_over_configured_ones(spark):
    df = spark.createDataFrame([(1, "{% $n %}-{% $user.name %}", '{"n": 2}'), (2, "{% $n %}-{% $user.name %}", None)], "doc_id long, source string, v string")
    assert [r["html"] for r in Engine(spark, CONFIG).render(df, variables="v").orderBy("doc_id").collect()] == ["<article><p>2-tip</p></article>", "<article><p>1-tip</p></article>"]


def test_clashing_and_extra_columns_pass_through(spark):
    df = spark.createDataFrame([("a", "x", 1, "old")], "node_id string, source string, type int, html string")
    assert Engine(spark).render(df).first()["html"] == "<article><p>x</p></article>"
    assert Engine(spark).format(df).columns == [*df.columns, "formatted"]
    assert Engine(spark).render(df.limit(0)).isEmpty() and parse_nodes(df.withColumnRenamed("node_id", "doc_id").limit(0)).isEmpty()


def test_ast_json_has_its_keys_in_order_and_counts_utf16(spark, docs):
    text = Engine(spark).ast_json(docs.filter("doc_id = 10"), file="file").first()["ast"]
    tree = json.loads(text)
    assert list(tree) == ["$$mdtype", "attributes", "slots", "children", "errors", "lines", "type", "annotations", "inline", "location"]
    tag = tree["children"][0]["children"][0]["children"][1]
    assert tag["tag"] == "nope" and tag["location"]["start"] == {"line": 0, "character": 5, "offset": 5, "byteOffset": 8} and tag["location"]["file"] == "d10.md"


def test_diagnostics_for_people_and_programs(spark, docs):
    found = Engine(spark).validate(docs, file="file")
    lines = {r["line"] for r in human_lines(found.join(docs.select("doc_id", "source", F.col("file").alias("label")), "doc_id"), "label").collect()}
    assert "d10.md:1:5: critical[tag-undefined]: Undefined tag: 'nope'" in lines
    by_doc = {r["doc_id"]: json.loads(r["json"]) for r in diagnostics_json(found, docs).collect()}
    assert len(by_doc) == len(SOURCES) and by_doc[8] == {"file": "d8.md", "errors": []}
    (error,) = by_doc[10]["errors"]
    assert error["location"]["start"] == {"line": 0, "character": 5, "offset": 5, "byteOffset": 8} and error["error"]["id"] == "tag-undefined"
    assert exit_code(found) == 1 and exit_code(found.filter("level = 'warning'")) == 0


def test_formatting_checks_and_codes(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "#  x\n"), ("b.md", "# x\n"), ("c.md", "# x\r\n"), ("d.md", None)], "file string, source string")
    done = Engine(spark).format(df)
    diffs = {r["file"]: r["diff"] for r in format_check(done).collect()}
    assert diffs == {"a.md": unified_diff("a.md", "#  x\n", "# x\n"), "c.md": "c.md: CRLF line endings; fmt writes LF\n"}
    assert diffs["a.md"] == "--- a/a.md\n+++ b/a.md\n@@ -1 +1 @@\n-#  x\n+# x\n"
    assert format_code(done) == 1 and format_code(done, check=False) == 0
    write_formatted(done, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a.md", "# x\n"), ("c.md", "# x\n")]


def test_files_partials_and_configuration(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text('{% partial file="deep/b.md" /%}\n')
    (tmp_path / "docs/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "partials/deep").mkdir(parents=True)
    (tmp_path / "partials/deep/b.md").write_text("B {% $greeting %}\n")
    (tmp_path / "partials/x.bin").write_bytes(b"\xff")
    (tmp_path / "config.yaml").write_text("variables: {greeting: hello, n: 3}\n")
    found = read_documents(spark, [str(tmp_path / "docs"), str(tmp_path / "none.md")])
    kinds = {r["file"].rpartition("/")[2]: (r["source"] is not None, r["error"] is not None) for r in found.collect()}
    assert kinds == {"a.md": (True, False), "bad.md": (False, True), "none.md": (False, True)}
    assert read_partials(spark, str(tmp_path / "partials")) == {"deep/b.md": "B {% $greeting %}\n"}
    config = read_config(spark, str(tmp_path / "config.yaml"), str(tmp_path / "partials"), ["greeting=hi"])
    html = Engine(spark, config).render(found.filter("source is not null"))
    assert html.first()["html"] == "<article><p>B hi</p></article>"
    assert exit_code(Engine(spark, config).validate(found), found) == 2
    write_html(html, str(tmp_path / "html"), order="file")
    write_lines(Engine(spark).renderable_json(found.filter("source is not null")), str(tmp_path / "json"), "renderable")
    assert spark.read.text(str(tmp_path / "json")).count() == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from foliospark import __main__ as cli

    def run(*args, stdin=None):
        if stdin is not None:
            monkeypatch.setattr("sys.stdin", __import__("io").StringIO(stdin))
        code = cli.main(list(args))
        out = capsys.readouterr()
        return code, out.out, out.err

    a, b, config = tmp_path / "a.md", tmp_path / "b.md", tmp_path / "c.yaml"
    a.write_text("# a\n\n{% t n=1 /%}\n")
    b.write_text("#  b\n")
    config.write_text("tags: {t: {render: hr, attributes: {n: {type: String}}}}\n")
    assert run("render", str(b), str(a), "--config", str(config)) == (0, '<article><h1>b</h1></article><article><h1>a</h1><hr n="1"></article>', "")
    assert run("validate", str(a), str(b)) == (1, f"{a}:3:1: critical[tag-undefined]: Undefined tag: 't'\n", "")
    code, out, _ = run("validate", str(a), str(b), "--config", str(config), "--format", "json")
    first, second = map(json.loads, out.splitlines())
    assert code == 1 and first["errors"][0]["error"]["id"] == "attribute-type-invalid" and second == {"file": str(b), "errors": []}
    code, out, err = run("render", str(tmp_path / "none.md"), str(b))
    assert code == 2 and out == "<article><h1>b</h1></article>" and "none.md" in err
    assert run("render", "--var", "novalue", str(b))[0] == 2 and run("render", "--config", str(tmp_path / "no.yaml"), str(b))[0] == 2
    assert run("validate", "--file", "page.md", stdin="{% nope /%}\n")[1].startswith("page.md:1:1: critical[tag-undefined]")
    assert json.loads(run("transform", str(b))[1])[0]["name"] == "article" and json.loads(run("parse", str(b))[1])["type"] == "document"
    assert run("fmt", str(b))[:2] == (0, "# b\n") and run("fmt", "--check", str(b))[0] == 1 and run("fmt", "--check", str(a))[0] == 0
    assert run("fmt", "--write", str(b))[0] == 0 and b.read_text() == "# b\n" and run("fmt", "--write", stdin="x")[0] == 2


def test_declarations_are_refused_with_their_path():
    cases = {
        "tags: {a: {validate: x}}": "config.tags.a.validate",
        "tags: {a: {render: true}}": "config.tags.a.render",
        "tags: {a: {children: [nope]}}": "config.tags.a.children[0]",
        "tags: {a: {attributes: {b: {type: Text}}}}": "config.tags.a.attributes.b.type",
        "tags: {a: {attributes: {b: {matches: x}}}}": "config.tags.a.attributes.b.matches",
        "tags: {a: {attributes: {b: {errorLevel: loud}}}}": "config.tags.a.attributes.b.errorLevel",
        "tags: {a: {slots: {b: {need: 1}}}}": "config.tags.a.slots.b.need",
        "nodes: {tag: {render: x}}": "config.nodes.tag",
        "functions: {}": "config.functions",
        "[1]": "config",
    }
    for text, path in cases.items():
        with pytest.raises(DeclarationError) as e:
            declare(load_text(text))
        assert e.value.path == path
    with pytest.raises(DeclarationError):
        load_text("a: 1\n---\nb: 2\n")
    with pytest.raises(DeclarationError):
        parse_variable("novalue")
    assert parse_variable('n="3"') == ("n", "3") and parse_variable("n=3") == ("n", 3.0)
    config = configure("nodes: {heading: {render: h9}}\ntags: {a: {inline: true, attributes: {b: {type: [String, Number], default: [1], render: data-b}}}}", ["v=[1, {a: null}]"])
    assert config.nodes["heading"].transform is None and config.tags["a"].attributes["b"].type == ("String", "Number")
    assert config.variables == {"v": [1.0, {"a": None}]}
    assert declare(load_text("")).tags == {}


def test_sql_functions(spark):
    sql.register(spark, CONFIG)
    got = spark.sql("""SELECT md_html('# x {% $n %}', '{"n": 5}') AS a, md_html('{% $n %}', null) AS b, md_format('#  x') AS c, md_parse_tag('x a=1 /').name AS d, md_parse_tag('x a=').error AS e,
      md_value('{a: [1, $b]}') AS f, md_resolve('{"$$mdtype":"Variable","path":["n"]}', null) AS g, md_tag_end('ab {% x "%}" %}') AS h, md_link('/ä') AS i, md_number(1e21) AS j, md_number(10.0D) AS k, md_escape('<&">') AS l, md_truthy('0') AS m, md_html(cast(null AS string), null) AS n""").first()
    assert got["a"] == "<article><h1>x 5</h1></article>" and got["b"] == "<article><p>1</p></article>" and got["c"] == "# x\n"
    assert got["d"] == "x" and got["e"].startswith("Expected") and got["g"] == "1" and got["h"] == 13 and got["i"] == "/%C3%A4" and got["j"] == "1e+21" and got["k"] == "10"
    assert json.loads(got["f"]) == {"a": [1, {"$$mdtype": "Variable", "path": ["b"]}]} and got["l"] == "&lt;&amp;&quot;&gt;" and got["m"] is True and got["n"] is None
    assert spark.sql("SELECT type FROM md_nodes('# x') ORDER BY node_id").toPandas()["type"].tolist() == ["document", "heading", "inline", "text"]
    assert [tuple(r) for r in spark.sql("SELECT kind, body FROM md_segments('a\n\n{% b /%}\n') ORDER BY start").collect()] == [("paragraph", None), ("tag", " b /")]
    sql.register_function(spark, "shout", Function(lambda p, c: str(p["0"]).upper()))
    assert spark.sql("""SELECT shout('{"0":"a"}') AS x""").first()["x"] == '"A"'


def test_links_and_numbers_that_stay_in_the_jvm_agree_with_the_kernel(spark):
    rng = random.Random(4)
    parts = ["http://", "https://", "HTTP://", "ftp://", "mailto:", "//", "/", "a", "b.c", ":80", ":", "@", "?", "#", "é", "%41", "%", " ", "\\", ";", "=", "_", "x" * 64, ".", "\n", "[", "javascript:"]
    urls = ["", "/", "//", "#a", "?b", "/a//b", "http://a.b/c?d#e", "https://a_b", "http://a:80?x"] + ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "u string").select("u", normalize_link_column("u").alias("v"), F.col("u").rlike(SETTLED).alias("settled"))
    got = df.collect()
    assert all(r["v"] == (None if r["u"] is None else normalize_link(r["u"])) for r in got) and sum(bool(r["settled"]) for r in got) > 100
    numbers = [0.0, -0.0, 1.0, -17.0, 2.0**53 - 1, 2.0**53, 1e21, 1e300, 0.5, -1e-7, math.nan, math.inf, -math.inf, None]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", js_number_column("x").alias("v")).collect()
    assert [r["v"] for r in got] == [None if x is None else js_number(x) for x in numbers]


def test_native_functions_agree_with_the_language(spark):
    df = spark.createDataFrame([(None,), ("null",), ("false",), ("0",), ('""',), ("[]",), ('{"a":1,"b":[2]}',)], "v string")
    assert [r[0] for r in df.select(truthy(F.col("v"))).collect()] == [False, False, False, True, True, True, True]
    assert [r[0] for r in df.select(md_equals(F.col("v"), F.lit('{"b": [2], "a": 1}'))).collect()] == [False] * 6 + [True]
    assert [r[0] for r in df.select(md_equals(F.col("v"), F.lit(None).cast("string"))).collect()] == [True] + [False] * 6
    assert [r[0] for r in df.select(md_default(F.col("v"), F.lit("1"))).collect()] == ["1", "null", "false", "0", '""', "[]", '{"a":1,"b":[2]}']
    urls = ["javascript:x", "JAVA\tSCRIPT:x", " data:text/html,x", "data:image/png;base64,x", "https://a", "file:/x", "/javascript:x"]
    links = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in links.select(unsafe_link(F.col("u"))).collect()] == [unsafe_text(u) for u in urls]


def test_masks_keep_lengths_lines_and_quote_markers():
    assert masked("a *b*") == ("a *b*", []) and masked("") == ("", [])
    assert masked('{% a b="%} *x*" %}*') == ("{% x xxxxx xxxx %}*", [(0, 18)])
    assert masked("> {% a\n> é=1 %} {% b\n\n%} {% c") == ("> {% x\n> xxx %} {% b\n\n%} {% c", [(2, 15)])
    for text in filter(None, SOURCES):
        got, tags = masked(text)
        assert len(got) == len(text) and got.count("\n") == text.count("\n") and all(got[a : a + 2] == "{%" and got[b - 2 : b] == "%}" for a, b in tags)


class _Words:
    """Every word of a source is a paragraph."""

    def blocks(self, source, comments):
        root = Block("document", 0, 0, children=[Block("paragraph", 0, m.start(), text=[(m[0], m.start())], end=m.end()) for m in re.finditer(r"\S+", source)])
        return Tokens(root, 1)

    def inline(self, text, references, comments):
        return [["text", text, (0, len(text))]]


def test_a_hosts_tokenizer_reads_plain_prose_too(spark):
    df = spark.createDataFrame([("one *two*",), ("",), (None,)], "source string")
    engine = Engine(spark, options=ParseOptions(tokenizer=_Words()))
    assert [r["html"] for r in engine.render(df).collect()] == ["<article><p>one</p><p>*two*</p></article>", "<article></article>", None]
    assert engine.with_partials({"p": "a b"}).config.partials["p"].children[1].type == "paragraph"


def test_frontmatter_is_the_hosts_to_strip(spark):
    df = spark.createDataFrame([("---\ntitle: x\n---\n# a\n",), ("# a\n---\n",)], "source string")
    assert [r[0] for r in df.select(strip_frontmatter(F.col("source"))).collect()] == ["# a\n", "# a\n---\n"]


def test_comments_are_an_option(spark):
    df = spark.createDataFrame([(1, "<!-- x -->\n")], "doc_id long, source string")
    assert Engine(spark).render(df).first()["html"] == "<article><p>&lt;!-- x --&gt;</p></article>"
    assert Engine(spark, options=ParseOptions(allow_comments=True)).render(df).first()["html"] == "<article></article>"


def test_streams_need_no_state(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(k, s, f"2024-01-01 00:{k:02}:00") for k, s in enumerate(SOURCES)], "doc_id long, source string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(source))
    stream = spark.readStream.schema("doc_id long, source string, at timestamp").parquet(str(source))
    engine = Engine(spark, CONFIG)
    batch = spark.read.parquet(str(source))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert rows(run(render_stream(engine, stream), "htmls").select("doc_id", "html")) == rows(engine.render(batch).select("doc_id", "html"))
    assert rows(run(validate_stream(engine, stream), "problems").select("doc_id", "node_id", "pos", "message")) == rows(engine.validate(batch).select("doc_id", "node_id", "pos", "message"))
    assert run(first_documents(stream, "at"), "latest").count() == len(SOURCES)
    found = engine.validate(stream).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    counts = run(problem_counts(found, "at"), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == engine.validate(batch).count()
    seen = []
    write_batches(stream, lambda df, k: seen.append(engine.render_relational(df).count()), str(tmp_path / "batches")).awaitTermination(120)
    assert sum(seen) == len(SOURCES) - 1


def test_partials_from_a_table_are_those_of_the_configuration(spark):
    texts = {"a.md": 'A {% $x %}\n\n{% partial file="b.md" /%}\n', "b.md": 'B\n\n{% partial file=$next /%}\n', "c.md": 'C\n\n{% partial file="a b\\"c.md" /%}\n', 'a b"c.md': "D\n", "loop.md": 'L\n\n{% partial file="loop.md" /%}\n', "unused.md": "U\n"}
    sources = [
        ('{% partial file="a.md" variables={x: 1, next: "c.md"} /%}\n', None), ('say "hi\n\n{% partial file=$f /%}\n', '{"f": "c.md"}'), ("no include\n", None), ('{% partial file="lost.md" /%}\nx\n', None),
        ('{% partial file=default($no, "loop.md") /%}\n', None), (None, None), ("", None), ('{% partial file=$site.page /%}\n', '{"x": 2}'), ('{% partial file="a.md" variables={x: 1, next: "c.md"} /%}\n', None),
    ]
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(sources)], "doc_id int, source string, variables string").repartition(3)
    table = spark.createDataFrame([*texts.items(), ("a.md", "Z later\n"), (None, "n"), ("n.md", None)], "name string, body string")
    config = Config.of(variables={"site": {"page": "b.md"}})
    got = Engine(spark, config).render_with_partials(docs, table, variables="variables", file="name", text="body")
    assert got.columns == [*docs.columns, "html"]
    want = Engine(spark, config).with_partials(texts).render(docs, variables="variables").select("doc_id", "html")
    assert rows(got.select("doc_id", "html")) == rows(want)
    assert rows(Engine(spark, config).render_with_partials(docs.select("doc_id", "source"), table.limit(0), file="name", text="body").select("doc_id", "html").filter("doc_id = 2")) == rows(want.filter("doc_id = 2"))


def test_the_graph_of_includes_is_closed_over_cycles_and_long_chains(spark):
    chain = [(f"p{k}", f'{{% partial file="p{k + 1}" /%}}') for k in range(40)] + [("p40", "end"), ("q", '{% partial file="q" /%}'), ("r", '"q" "s"'), ("s", '"r"')]
    edges = includes(spark.createDataFrame(chain, "file string, source string"))
    reach = {(r["file"], r["other"]) for r in closure(edges).collect()}
    assert reach == {(f"p{i}", f"p{j}") for i in range(41) for j in range(i + 1, 41)} | {("q", "q")} | {(a, b) for a in "rs" for b in "qrs"}


def test_documents_meet_their_vocabulary_by_a_key(spark):
    given = [("a", "tags: {box: {render: aside}}"), ("b", '{"tags": {"box": {"render": "div", "attributes": {"n": {"type": "Number", "required": true}}}}}'), ("c", "tags: {box: {render: true}}"), ("d", None), ("e", "{"), (None, "tags: {}")]
    table = spark.createDataFrame(given, "site string, declaration string")
    docs = spark.createDataFrame([(k, site, "{% box %}\nx\n{% /box %}\n") for k, site in enumerate(["a", "b", "c", "d", "e", None, "lost", "a"])] + [(8, "a", None)], "doc_id int, site string, source string")
    got = validate_by_vocabulary(render_by_vocabulary(docs, table, "site"), table, "site").orderBy("doc_id").collect()
    box = {"a": "<article><aside><p>x</p></aside></article>", "b": "<article><div><p>x</p></div></article>", "d": "<article><p>x</p></article>"}
    assert [r["html"] for r in got] == [box["a"], box["b"], None, box["d"], None, None, None, box["a"], None]
    assert [None if r["problems"] is None else [p["error"]["id"] for p in r["problems"]] for r in got] == [[], ["attribute-missing-required"], None, ["tag-undefined"], None, None, None, [], None]
    found = {r["site"]: r for r in verdicts(table).collect()}
    assert [found[s]["path"] for s in "abcde"] == [None, None, "config.tags.box.render", None, "config"] and all((found[s]["path"] is None) == (found[s]["reason"] is None) for s in "abcde")
    assert found["a"]["tags"] == ["box"] and found["d"]["tags"] == []
