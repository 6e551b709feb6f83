"""Registered queries over whole tables: documents are written from columns and run through the engine.

Each has SQL that builds the expected output without the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.engine import Engine
from foliospark.functions.columns import escape_html, md_and, md_default, md_equals, md_not, md_or, truthy, utf16_length
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.schema import Attribute, Config, Schema, Slot
from foliospark.operators.nodes import NUMBER, parse_nodes
from foliospark.operators.values import debug_column, js_number_column, normalize_link_column, parse_tag_column, resolve_constant
from foliospark.plans.analytics import OUTLINE, error_rollup, links, node_counts, outline, problem_cube, tag_usage, top_by_group
from foliospark.plans.branches import BRANCHES
from foliospark.plans.changes import changes
from foliospark.plans.places import as_of_join, nodes_at
from foliospark.queries.registry import query, read, written
from foliospark.sources.declare import configure
from foliospark.sources.documents import dealt, stored
from foliospark.sources.sinks import diagnostics_json, format_check, human_lines

#: The vocabulary of the queries, as a user would declare it.
VOCABULARY = """
tags:
  callout:
    render: aside
    attributes:
      type: {type: String, required: true, matches: [note, tip, warning]}
      level: {type: Number, default: 1}
    children: [paragraph]
  badge:
    render: span
    inline: true
    selfClosing: true
    attributes:
      text: {type: [String, Number], errorLevel: warning}
variables:
  site: {name: Folio, langs: [en, de]}
"""


def _config() -> Config:
    return configure(VOCABULARY)


# ---- rendering

def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", written("# ", F.col("p_name"), " {% #p", F.col("p_partkey"), " %}\n").alias("source"))


_HEADING_SQL = """SELECT p_partkey, '<article><h1 id="p' || p_partkey || '">' || p_name || ' </h1></article>' AS html FROM part"""


@query(_HEADING_SQL)
def render_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with an annotation, by the kernel."""
    return Engine(spark).render(_headings(spark, sf_dir)).select("p_partkey", "html")


@query(_HEADING_SQL)
def render_heading_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same HTML as an ordered aggregate over the renderable table."""
    return Engine(spark).render_relational(_headings(spark, sf_dir), "p_partkey")


@query("""SELECT o_orderkey, '<article><p>' || CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Status P' END || '</p></article>' AS html FROM (SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'P' END AS o_orderstatus FROM orders)""")
def render_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches chosen by a variable of each row."""
    source = '{% if equals($s, "F") %}\nClosed\n{% else equals($s, "O") /%}\nOpen\n{% else /%}\nStatus {% $s %}\n{% /if %}\n'
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(source).alias("source"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("variables"))
    return Engine(spark).render(rows, variables="variables").select("o_orderkey", "html")


@query("""SELECT doc_id, '<article>' || CASE WHEN quality = 1 AND toxic = 1 THEN '<p>both</p>' ELSE '' END || CASE WHEN quality = 1 OR toxic = 1 THEN '<p>any</p>' ELSE '' END
  || CASE WHEN NOT toxic = 1 THEN '<p>clean</p>' ELSE '' END || quality || '</article>' AS html FROM labels""")
def render_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """and, or, not and default over booleans of each row; a call alone on its line is a block of its own."""
    source = "{% if and($q, $t) %}\nboth\n{% /if %}\n\n{% if or($q, $t) %}\nany\n{% /if %}\n\n{% if not($t) %}\nclean\n{% /if %}\n\n{% default($missing, $n) %}\n"
    given = F.to_json(F.struct((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"), F.col("quality").alias("n")))
    rows = read(spark, sf_dir, "labels").select("doc_id", F.lit(source).alias("source"), given.alias("variables"))
    return Engine(spark).render(rows, variables="variables").select("doc_id", "html")


@query("""SELECT o_custkey, '<article><ul>' || string_agg('<li>order ' || o_orderkey || ': <strong>' || o_orderpriority || '</strong></li>', '' ORDER BY o_orderkey) || '</ul></article>' AS html FROM orders GROUP BY o_custkey""")
def render_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tight list of each customer's orders."""
    line = written("- order ", F.col("o_orderkey"), ": **", F.col("o_orderpriority"), "**")
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("source"))
    return Engine(spark).render(dealt(rows)).select("o_custkey", "html")


def _tables(spark: SparkSession, sf_dir: str, line: Column, head: str, foot: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line"))))
    joined = F.array_join(F.transform(rows, lambda x: x["line"]), "")
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit(head), joined, F.lit(foot)).alias("source"))


_TABLE_SQL = """SELECT n_regionkey, '<article><table><thead><tr><th>Key</th><th>Name</th></tr></thead><tbody>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</tbody></table></article>' AS html FROM nation GROUP BY n_regionkey"""


@query(_TABLE_SQL)
def render_pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of each region's nations."""
    line = written("| ", F.col("n_nationkey"), " | ", F.replace(F.col("n_name"), F.lit("_"), F.lit("\\_")), " |\n")
    return Engine(spark).render(_tables(spark, sf_dir, line, "| Key | Name |\n|-----|------|\n", "")).select("n_regionkey", "html")


@query(_TABLE_SQL)
def render_table_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables written as lists inside a table tag."""
    line = written("---\n* ", F.col("n_nationkey"), "\n* ", F.replace(F.col("n_name"), F.lit("_"), F.lit("\\_")), "\n")
    return Engine(spark).render(_tables(spark, sf_dir, line, "{% table %}\n* Key\n* Name\n", "{% /table %}\n")).select("n_regionkey", "html")


@query("""SELECT event_id, '<article><pre data-language="json">' || replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || chr(10) || '</pre></article>' AS html FROM events""")
def render_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON of each event."""
    rows = read(spark, sf_dir, "events").select("event_id", written("```json\n", F.col("props"), "\n```\n").alias("source"))
    return Engine(spark).render(rows).select("event_id", "html")


_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    f"""SELECT doc_id, md5('<article>' || CASE WHEN t = '' THEN '' ELSE '<p>' || {_ESCAPED.format("t")} || '</p>' END || '</article>') AS html_md5, length(t)::BIGINT AS n_chars
  FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20\\x7f]+', ' ', 'g'), ' ') AS t FROM documents)"""
)
def render_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as one paragraph, all its punctuation written with backslashes."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20\x7f]+", " "))
    rows = read(spark, sf_dir, "documents").select("doc_id", plain.alias("plain"))
    rows = rows.select("doc_id", F.length("plain").cast("long").alias("n_chars"), F.regexp_replace("plain", r"([!-/:-@\[-`{-~])", r"\\$1").alias("source"))
    return Engine(spark).render(rows).select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5"), "n_chars")


@query(f"""SELECT page_id, md5({_ESCAPED.format("html")}) AS escaped_md5, md5('<article><pre>' || {_ESCAPED.format("html")} || chr(10) || '</pre></article>') AS fence_md5 FROM pages""")
def render_page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages, escaped natively and as literal fences."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.md5(escape_html(F.col("html")).cast("binary")).alias("escaped_md5"), written("~~~~~~~~~~~~\n", F.col("html"), "\n~~~~~~~~~~~~\n").alias("source"))
    return Engine(spark).render(rows).select("page_id", "escaped_md5", F.md5(F.col("html").cast("binary")).alias("fence_md5"))


@query("""SELECT event_id, '<article><p>Event ' || event_id || ' is a ' || event_type || '.</p><h2>' || event_type || '</h2></article>' AS html FROM events""")
def render_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial that reads the variables of each row and those it is passed."""
    engine = Engine(spark).with_partials({"notes/event.md": "Event {% $id %} is a {% $kind %}.\n\n## {% $kind %}\n"})
    source = '{% partial file="notes/event.md" variables={kind: $type} /%}\n'
    given = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    rows = read(spark, sf_dir, "events").select("event_id", F.lit(source).alias("source"), given.alias("variables"))
    return engine.render(rows, variables="variables").select("event_id", "html")


@query("""SELECT c_custkey, '<article><p>' || n_name || ' for c' || c_custkey || '</p><h2>' || r_name || '</h2></article>' AS html
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def render_partials_from_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials of two levels in a table: a nation's file includes its region's; a third of the documents name the file by a variable."""
    nation = read(spark, sf_dir, "nation").select(written("nation/", F.col("n_nationkey"), ".md").alias("file"), written(F.replace(F.col("n_name"), F.lit("_"), F.lit("\\_")), ' for {% $who %}\n\n{% partial file="region/', F.col("n_regionkey"), '.md" /%}\n').alias("text"))
    region = read(spark, sf_dir, "region").select(written("region/", F.col("r_regionkey"), ".md").alias("file"), written("## ", F.col("r_name"), "\n").alias("text"))
    who, name = written("c", F.col("c_custkey")), written("nation/", F.col("c_nationkey"), ".md")
    source = F.when(F.col("c_custkey") % 3 == 0, F.lit("{% partial file=$f variables={who: $me} /%}\n")).otherwise(written('{% partial variables={who: $me} file="', name, '" /%}\n'))
    docs = read(spark, sf_dir, "customer").select("c_custkey", source.alias("source"), F.to_json(F.struct(who.alias("me"), F.when(F.col("c_custkey") % 3 == 0, name).alias("f"))).alias("variables"))
    return Engine(spark).render_with_partials(docs, nation.unionByName(region), variables="variables", text="text").select("c_custkey", "html")


@query("""SELECT s_suppkey, '<article>' || repeat('<p>ping ' || s_suppkey || '</p><p>pong</p>', 254) || '<p></p><p></p></article>' AS html FROM supplier""")
def render_partials_in_a_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partials that include each other expand until the tree is 512 levels deep; what lies deeper is cut off."""
    key = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier")
    pages = rows.select(F.explode(F.array(*[F.struct(written(a, "/", key).alias("file"), written(a, " " if a == "ping" else "", *([key] if a == "ping" else []), '\n\n{% partial file="', b, "/", key, '" /%}\n').alias("text")) for a, b in (("ping", "pong"), ("pong", "ping"))])).alias("p")).select("p.*")
    docs = rows.select("s_suppkey", written('{% partial file="ping/', key, '" /%}\n').alias("source"))
    return Engine(spark).render_with_partials(docs, pages, text="text").select("s_suppkey", "html")


@query("""SELECT s_suppkey, '<article><section title="' || s_name || '"><p>Nation ' || s_nationkey || '</p></section></article>' AS html FROM supplier""")
def render_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot lifted out of its tag and rendered as an attribute."""
    config = Config.of({"panel": Schema("section", slots={"title": Slot()})})
    source = written('{% panel %}\n\n{% slot "title" %}\n', F.col("s_name"), "\n{% /slot %}\n\nNation ", F.col("s_nationkey"), "\n\n{% /panel %}\n")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", source.alias("source"))
    html = Engine(spark, config).with_options(slots=True).transform(rows, "s_suppkey")
    title = F.regexp_extract(F.get("attrs", F.lit(0))["value"], r'"children":\["([^"]*)"\]', 1)
    found = html.groupBy("s_suppkey").agg(F.max(F.when(F.col("name") == "section", title)).alias("title"), F.max(F.when(F.col("kind") == "scalar", F.substring_index(F.substring_index("value", '"', 2), '"', -1))).alias("body"))
    return found.select("s_suppkey", written('<article><section title="', F.col("title"), '"><p>', F.col("body"), "</p></section></article>").alias("html"))


@query("""SELECT c_custkey, '<article><aside type="note" level="' || (c_custkey % 7) || '"><p>' || c_name || ' <span text="' || c_mktsegment || '"></span></p></aside></article>' AS html FROM customer""")
def render_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a declared vocabulary: schema order of attributes, primitives, inline and block tags."""
    source = written("{% callout level=", F.col("c_custkey") % 7, ' type="note" %}\n', F.col("c_name"), ' {% badge text="', F.col("c_mktsegment"), '" /%}\n{% /callout %}\n')
    return Engine(spark, _config()).render(read(spark, sf_dir, "customer").select("c_custkey", source.alias("source"))).select("c_custkey", "html")


@query("""SELECT p_partkey, '{"$$mdtype":"Tag","name":"article","attributes":{},"children":[{"$$mdtype":"Tag","name":"p","attributes":{},"children":["' || p_name || '"]}]}' AS first, 1::BIGINT AS n FROM part""")
def transform_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderable tree of each document as JSON."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.trim("p_name").alias("source"))
    got = Engine(spark).renderable_json(rows)
    return got.select("p_partkey", F.regexp_replace("renderable", r"^\[|\]$", "").alias("first"), F.lit(1).cast("long").alias("n"))


# ---- parsing


@query("""SELECT type, tag, n_nodes FROM (
  SELECT 'document' AS type, '' AS tag, count(*) AS n_nodes FROM part UNION ALL SELECT 'heading', '', count(*) FROM part UNION ALL SELECT 'inline', '', 2 * count(*) FROM part
  UNION ALL SELECT 'text', '', 2 * count(*) FROM part UNION ALL SELECT 'tag', 'callout', count(*) FROM part UNION ALL SELECT 'paragraph', '', count(*) FROM part)""")
def parse_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node kinds of all documents."""
    source = written("# Part ", F.col("p_partkey"), "\n\n{% callout %}\n", F.trim("p_name"), "\n{% /callout %}\n")
    return node_counts(parse_nodes(read(spark, sf_dir, "part").select("p_partkey", source.alias("source")), "p_partkey"))


@query("""SELECT p_partkey, 'open' AS kind, 'item' AS name, 5::BIGINT AS n_attributes, '"' || p_brand || '"' AS brand, CAST(p_size AS VARCHAR) AS size, true AS self_closing FROM part""")
def parse_tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag bodies as fields: primary, attributes, id and class."""
    body = written('item "x" brand="', F.col("p_brand"), '" size=', F.col("p_size"), " #p", F.col("p_partkey"), " .wide /")
    rows = read(spark, sf_dir, "part").select("p_partkey", parse_tag_column(body).alias("t"))
    value = lambda name: F.get(F.filter("t.attributes", lambda a: a["name"] == name), F.lit(0))["value"]
    return rows.select("p_partkey", "t.kind", "t.name", F.size("t.attributes").cast("long").alias("n_attributes"), value("brand").alias("brand"), value("size").alias("size"), "t.self_closing")


@query("""SELECT p_partkey, 1::BIGINT AS n_errors, 'critical' AS level, 8 + length(CAST(p_size AS VARCHAR)) AS start FROM part""")
def parse_tag_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are no tag: one critical error each, at the character that does not fit."""
    rows = read(spark, sf_dir, "part").select("p_partkey", written("{% item ", F.col("p_size"), "! %}\n").alias("source"))
    found = Engine(spark).validate(rows, "p_partkey").filter("error_id = 'parse-error'")
    return found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_errors"), F.first("level").alias("level"), F.first(F.col("loc.start.offset")).cast("long").alias("start"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS ordinal, 2 AS level, 'Order ' || o_orderkey AS text FROM orders
  UNION ALL SELECT DISTINCT o_custkey, 1, 1, 'Customer ' || o_custkey FROM orders""")
def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each document with their ordinals."""
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", written("## Order ", F.col("o_orderkey"), "\n\n", F.col("o_orderpriority"), "\n\n").alias("line"))))
    source = F.concat(written("# Customer ", F.col("o_custkey"), "\n\n"), F.array_join(F.transform(items, lambda x: x["line"]), ""))
    docs = dealt(read(spark, sf_dir, "orders").groupBy("o_custkey").agg(source.alias("source")))
    found = outline(parse_nodes(docs, "o_custkey", **OUTLINE), "o_custkey")
    return found.select("o_custkey", F.col("ordinal").cast("long").alias("ordinal"), "level", "text")


@query("""SELECT o_orderkey, 'text' AS type, 'Order ' || o_orderkey AS heading FROM orders""")
def nodes_at_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places inside documents of many headings: the deepest node that holds each, by an interval join, and the heading in force, by an as-of join."""
    key = F.col("o_orderkey")
    head = written("## Order ", key, "\n\n")
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.struct(key, F.concat(head, "o_orderpriority", F.lit("\n\n")).alias("text"), F.octet_length(head).alias("lead")).alias("e"))
    docs = dealt(orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("e")).alias("x")))
    docs = docs.select("o_custkey", F.col("o_custkey").alias(NUMBER), F.array_join(F.transform("x", lambda e: e["text"]), "").alias("source"), "x")
    before = F.col("x").getField("text")
    size = lambda k: F.octet_length(F.array_join(F.slice(before, F.lit(1), k), ""))
    places = docs.select(NUMBER, "x", F.posexplode("x").alias("k", "e")).select(NUMBER, "e.o_orderkey", (size(F.col("k")) + F.col("e.lead") + 2).alias("at"))
    nodes = stored(parse_nodes(docs, "o_custkey", columns=("node_id", "depth", "type", "tag", "attrs", "loc")))
    text = F.get(F.filter("attrs", lambda a: a["name"] == "content"), F.lit(0))["value"]
    heads = nodes.filter("type = 'text'").select(NUMBER, F.col("loc.start.offset").alias("by"), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]").alias("heading")).filter("heading like 'Order %'")
    return as_of_join(nodes_at(places, nodes), heads, [NUMBER], "at", "by").select("o_orderkey", "type", "heading")


@query("""WITH p AS (
    SELECT c_custkey, 'attribute-missing-required' AS error_id, 'error' AS level, 'callout' AS name FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'attribute-undefined', 'error', 'callout' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'tag-undefined', 'critical', 'k' || c_custkey % 5 FROM customer CROSS JOIN range(2)
  ) SELECT error_id, level, name, grouping_id(error_id, level, name)::INTEGER AS grain, count(*) AS n, count(DISTINCT c_custkey) AS n_docs FROM p GROUP BY ROLLUP (error_id, level, name)""")
def problems_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by rule, level and tag, with all totals above them, and the documents that have one."""
    key = F.col("c_custkey")
    given, other = F.when(key % 2 == 0, "").otherwise(' type="tip"'), F.when(key % 3 == 0, " lost=1").otherwise("")
    tag = written("\n{% k", key % 5, " /%}\n")
    source = F.concat(F.lit("{% callout"), given, other, F.lit(" %}\nx\n{% /callout %}\n"), tag, tag)
    docs = read(spark, sf_dir, "customer").select("c_custkey", source.alias("source"))
    return problem_cube(Engine(spark, _config()).validate(docs, "c_custkey"))


@query("""SELECT 'k' || c_nationkey AS name, rank, c_custkey, 'Undefined tag: ' || chr(39) || 'k' || c_nationkey || chr(39) AS message FROM (
    SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3 DESC, c_custkey)::INTEGER AS rank FROM customer
  ) WHERE rank <= 4""")
def top_problems_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tag's problems the four that stand last in their documents, ties by the smaller id."""
    source = F.concat(F.repeat(F.lit("a\n\n"), (F.col("c_custkey") % 3).cast("int")), written("{% k", F.col("c_nationkey"), " /%}\n"))
    found = Engine(spark).validate(read(spark, sf_dir, "customer").select("c_custkey", source.alias("source")), "c_custkey")
    best = top_by_group(found, ["name"], [F.desc(F.get("lines", F.lit(0))), "c_custkey"], 4)
    return best.select("name", "rank", "c_custkey", "message")


@query("""SELECT c_custkey, w.change, w.n FROM customer JOIN (VALUES (0, 'kept', 1), (1, 'kept', 3), (1, 'changed', 1), (1, 'new', 1), (1, 'gone', 1), (2, 'changed', 1), (2, 'moved', 2), (2, 'kept', 2), (3, 'changed', 1), (3, 'kept', 4), (3, 'new', 1)) w(k, change, n) ON c_custkey % 4 = w.k""")
def changed_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of each document: left alone, with one paragraph rewritten, with two exchanged, with one added."""
    key = F.col("c_custkey")
    head, other = written("# Customer ", key, "\n\n"), F.when(key % 4 == 1, F.col("c_mktsegment")).otherwise("b")
    docs = read(spark, sf_dir, "customer")
    first, last = F.when(key % 4 == 2, "c").otherwise("a"), F.when(key % 4 == 2, "a").otherwise("c")
    end = F.when(key % 4 == 3, written("d ", F.col("c_name"), "\n")).otherwise("")
    before = docs.select("c_custkey", F.concat(head, F.lit("a\n\nb\n\nc\n")).alias("source"))
    after = docs.select("c_custkey", F.concat(head, first, F.lit("\n\n"), other, F.lit("\n\n"), last, F.lit("\n\n"), end).alias("source"))
    wanted = ("node_id", "last_desc", "type", "tag", "digest", "place")
    states = [parse_nodes(x, "c_custkey", options=ParseOptions(location=False), digests=True, columns=wanted) for x in (before, after)]
    return changes(*states, "c_custkey").groupBy("c_custkey", "change").agg(F.count(F.lit(1)).cast("int").alias("n"))


_REPEATED_SQL = """SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 7 END AS k, what, CASE what
    WHEN 'html' THEN '<article><h1>' || c_custkey || '</h1><p>' || CASE WHEN c_acctbal > 0 THEN 'yes ' ELSE 'no ' END || c_custkey || '</p><ul><li>one</li><li>' || c_mktsegment || '</li></ul></article>'
    WHEN 'outline' THEN '1 ' || c_custkey
    WHEN 'branches' THEN '2 ' || CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END
    ELSE json_object('file', 'c' || c_custkey, 'errors', [])::VARCHAR END AS found
  FROM customer, (VALUES ('html'), ('outline'), ('branches'), ('diagnostics')) w(what)"""


@query(_REPEATED_SQL)
def documents_of_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that many documents share, and a third that have none: every row keeps its own HTML, outline, branches and diagnostics."""
    key, flag = F.col("c_custkey"), F.when(F.col("c_acctbal") > 0, "true").otherwise("false")
    source = written("# ", key, "\n\n{% if ", flag, " %}\nyes ", key, "\n{% else /%}\nno ", key, "\n{% /if %}\n\n- one\n- ", F.col("c_mktsegment"), "\n")
    rows = read(spark, sf_dir, "customer").select(F.when(key % 3 != 0, key % 7).alias("k"), written("c", key).alias("file"), source.alias("source"))
    engine = Engine(spark)
    nodes = engine.parse(rows, "k", columns=BRANCHES)
    found = [
        ("html", engine.render_relational(rows, "k").select("k", F.col("html").alias("found"))),
        ("outline", outline(nodes, "k").select("k", F.concat_ws(" ", "ordinal", "text").alias("found"))),
    ]
    texts = F.get(F.filter("attrs", lambda a: a["name"] == "content"), F.lit(0))["value"]
    kept = engine.select_branches(nodes).filter("type = 'paragraph' or type = 'text'").groupBy("k", NUMBER)
    words = F.max(F.regexp_extract(texts, '"(yes|no)', 1))
    found.append(("branches", kept.agg((F.count_if(F.col("type") == "paragraph") + 1).alias("n"), words.alias("w")).select("k", F.concat_ws(" ", "n", "w").alias("found"))))
    docs = engine.numbered(rows)
    found.append(("diagnostics", diagnostics_json(engine.validate(docs, "k", file="file"), docs, "k").select("k", F.col("json").alias("found"))))
    out = [df.select("k", F.lit(what).alias("what"), "found") for what, df in found]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""SELECT p_partkey, 'link' AS type, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'https://shop.example/' || p_partkey END AS url FROM part WHERE p_size % 3 <> 0""")
def links_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations that run code never become links."""
    url = F.when(F.col("p_size") % 3 == 0, F.lit("JaVaScript:alert(1)")).otherwise(written("https://shop.example/", F.col("p_partkey")))
    nodes = parse_nodes(read(spark, sf_dir, "part").select("p_partkey", written("See [here](", url, ").\n").alias("source")), "p_partkey")
    return links(nodes, "p_partkey").select("p_partkey", "type", "url")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 3 END + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS n_kept FROM (SELECT c_custkey, c_acctbal FROM customer)""")
def select_conditional_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals decided by windows over the node table: paragraphs that stay."""
    flag = F.when(F.col("c_acctbal") > 0, "true").otherwise("false")
    third = F.when(F.col("c_custkey") % 3 == 0, "true").otherwise("false")
    parts = ["{% if ", third, " %}\na\n\nb\n{% else /%}\nc\n{% /if %}\n\n{% if ", flag, " %}\nd\n{% /if %}\n\n{% if false %}\ne\n{% else ", flag, " /%}\nf\n{% else /%}\ng\n{% /if %}\n\nh\n"]
    nodes = parse_nodes(read(spark, sf_dir, "customer").select("c_custkey", written(*parts).alias("source")), "c_custkey", columns=BRANCHES)
    kept = Engine(spark).select_branches(nodes).filter("type = 'paragraph'")
    return kept.groupBy("c_custkey").agg(F.count(F.lit(1)).cast("int").alias("n_kept"))


@query("""SELECT tag, attribute, n FROM (SELECT 'callout' AS tag, '' AS attribute, count(*) AS n FROM customer UNION ALL SELECT 'callout', 'type', count(*) FROM customer
  UNION ALL SELECT 'badge', '', count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'badge', 'text', count(*) FROM customer WHERE c_custkey % 2 = 0)""")
def tags_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often tags and their attributes are written."""
    badge = F.when(F.col("c_custkey") % 2 == 0, F.lit(' {% badge text="x" /%}')).otherwise("")
    source = written('{% callout type="tip" %}\nhello', badge, "\n{% /callout %}\n")
    return tag_usage(parse_nodes(read(spark, sf_dir, "customer").select("c_custkey", source.alias("source")), "c_custkey"))


# ---- validation


def _callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents with one fault by the remainder of their key."""
    k = F.col("c_custkey") % 8
    opening = (
        F.when(k == 0, '{% callout type="note" %}')
        .when(k == 1, "{% callout %}")
        .when(k == 2, '{% callout type="loud" %}')
        .when(k == 3, '{% callout type="tip" level="high" %}')
        .when(k == 4, '{% callout type="tip" colour="red" %}')
        .when(k == 5, '{% callout type="tip" level=$site.size %}')
        .when(k == 6, '{% shout type="tip" %}')
        .otherwise('{% callout type="tip" id="9x" %}')
    )
    closing = F.when(k == 6, "{% /shout %}").otherwise("{% /callout %}")
    body = F.when(k == 0, "# Heading").otherwise("text")
    return read(spark, sf_dir, "customer").select("c_custkey", written("customer-", F.col("c_custkey"), ".md").alias("file"), written(opening, "\n", body, "\n", closing, "\n").alias("source"))


_FAULTS = """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'child-invalid' WHEN 1 THEN 'attribute-missing-required' WHEN 2 THEN 'attribute-value-invalid' WHEN 3 THEN 'attribute-type-invalid'
  WHEN 4 THEN 'attribute-undefined' WHEN 5 THEN 'variable-undefined' WHEN 6 THEN 'tag-undefined' ELSE 'attribute-value-invalid' END AS error_id,
  CASE c_custkey % 8 WHEN 0 THEN 'warning' WHEN 6 THEN 'critical' ELSE 'error' END AS level,
  CASE c_custkey % 8 WHEN 0 THEN 'Can''t nest ''heading'' in ''callout''' WHEN 1 THEN 'Missing required attribute: ''type''' WHEN 2 THEN 'Attribute ''type'' must match one of ["note","tip","warning"]. Got ''loud'' instead.'
  WHEN 3 THEN 'Attribute ''level'' must be type of ''Number''' WHEN 4 THEN 'Invalid attribute: ''colour''' WHEN 5 THEN 'Undefined variable: ''site.size''' WHEN 6 THEN 'Undefined tag: ''shout''' ELSE 'The ''id'' attribute must start with a letter' END AS message FROM customer"""


@query(_FAULTS)
def validate_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems by the relational plan: one narrow stage."""
    return Engine(spark, _config()).validate(_callouts(spark, sf_dir), "c_custkey").select("c_custkey", "error_id", "level", "message")


@query(_FAULTS)
def validate_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same problems by the kernel that hooks need."""
    return Engine(spark, _config()).validate_by_kernel(_callouts(spark, sf_dir), "c_custkey").select("c_custkey", "error_id", "level", "message")


@query(f"SELECT error_id, level, count(*) AS n_errors, count(*) AS n_docs FROM ({_FAULTS}) GROUP BY error_id, level")
def validate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by id over the corpus."""
    return error_rollup(Engine(spark, _config()).validate(_callouts(spark, sf_dir), "c_custkey"), "c_custkey").select("error_id", "level", F.col("n_errors").cast("long").alias("n_errors"), "n_docs")


@query(f"""SELECT c_custkey, 'customer-' || c_custkey || '.md:1:1: ' || level || '[' || error_id || ']: ' || message AS line FROM ({_FAULTS})""")
def diagnostics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems as lines for people."""
    docs = _callouts(spark, sf_dir)
    found = Engine(spark, _config()).validate(docs, "c_custkey", file="file")
    return human_lines(found.hint("merge").join(docs, "c_custkey")).select("c_custkey", "line")


@query(f"""SELECT c_custkey, '{{"file":"customer-' || c_custkey || '.md"' AS head, 1::BIGINT AS n_errors, error_id FROM ({_FAULTS})""")
def diagnostics_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a document for programs."""
    docs = _callouts(spark, sf_dir)
    rows = diagnostics_json(Engine(spark, _config()).validate(docs, "c_custkey", file="file"), docs, "c_custkey")
    return rows.select("c_custkey", F.substring_index("json", ",", 1).alias("head"), F.json_array_length(F.get_json_object("json", "$.errors")).cast("long").alias("n_errors"), F.get_json_object("json", "$.errors[0].error.id").alias("error_id"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'even suppliers only' END AS message FROM supplier WHERE s_suppkey % 2 = 0""")
def validate_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema with a hook in Python, run by the kernel."""
    from foliospark.kernel.tree import Problem

    def hook(node, config):
        return [Problem("odd-number", "error", "even suppliers only")] if node.attributes["n"] % 2 == 0 else []

    config = Config.of({"row": Schema("div", attributes={"n": Attribute("Number", required=True)}, self_closing=True, validate=hook)})
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", written("{% row n=", F.col("s_suppkey"), " /%}\n").alias("source"))
    return Engine(spark, config).validate(rows, "s_suppkey").select("s_suppkey", "message")


# ---- values and functions


@query("""SELECT event_id, true AS t_props, event_type <> 'view' AND value > 5 AS t_and, event_type = 'view' OR value > 5 AS t_or, NOT value > 5 AS t_not,
  event_type = 'view' AS t_equals, CASE WHEN value > 5 THEN CAST(event_id AS VARCHAR) ELSE 'null' END AS t_default FROM events""")
def language_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document language's functions as native expressions over JSON text."""
    e = read(spark, sf_dir, "events")
    text = lambda c: F.when(c, "true").otherwise("false")
    large, view = text(F.col("value") > 5), text(F.col("event_type") == "view")
    kind = F.to_json(F.array("event_type"))
    defaulted = md_default(F.when(F.col("value") > 5, F.col("event_id").cast("string")), F.lit("null"))
    return e.select("event_id", truthy(F.col("props")).alias("t_props"), md_and(text(F.col("event_type") != "view"), large).alias("t_and"), md_or(view, large).alias("t_or"), md_not(large).alias("t_not"), md_equals(kind, F.lit('[ "view" ]')).alias("t_equals"), defaulted.alias("t_default"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END AS is_click FROM events""")
def resolve_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables and calls evaluated against each row's variables."""
    e = read(spark, sf_dir, "events")
    own = F.to_json(F.struct(F.from_json("props", "k bigint").alias("p"), F.col("event_type").alias("t")))
    k = resolve_constant(spark, '{"$$mdtype":"Variable","path":["p","k"]}', variables=own)
    click = resolve_constant(spark, '{"$$mdtype":"Function","name":"equals","parameters":{"0":{"$$mdtype":"Variable","path":["t"]},"1":"click"}}', variables=own)
    return e.select("event_id", k.alias("k"), click.alias("is_click"))


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || chr(10) || '}' AS debug FROM events""")
def debug_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented JSON as the debug function prints it."""
    return read(spark, sf_dir, "events").select("event_id", debug_column("props").alias("debug"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS price, regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS discount FROM lineitem""")
def number_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the host language's spelling."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", js_number_column("l_extendedprice").alias("price"), js_number_column("l_discount").alias("discount"))


@query("""SELECT page_id, 'https://xn--mller-kva.example/a%20b/' || page_id || '?q=%C3%BC#x' AS link, length(url) + 1 AS units FROM pages""")
def normalize_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations with a host outside ASCII, a blank and an umlaut; lengths in UTF-16 units."""
    link = normalize_link_column(written("https://müller.example/a b/", F.col("page_id"), "?q=ü#x"))
    return read(spark, sf_dir, "pages").select("page_id", link.alias("link"), (utf16_length(F.concat("url", F.lit("😀"))) - 1).cast("long").alias("units"))


# ---- formatting


@query("""SELECT p_partkey, '{% item size=' || p_size || ' /%}' || chr(10) || chr(10) || '# ' || trim(p_name) || chr(10) AS text, true AS changed, true AS settled FROM part""")
def format_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical source: spacing of tags, headings and blank lines."""
    rows = read(spark, sf_dir, "part").select("p_partkey", written("{%   item    size=", F.col("p_size"), "   /%}\n\n\n\n#    ", F.trim("p_name"), "\n").alias("source"))
    return Engine(spark).format(rows).select("p_partkey", "formatted.text", "formatted.changed", "formatted.settled")


@query("""SELECT p_partkey, '-#  ' || trim(p_name) || chr(10) || '+# ' || trim(p_name) AS diff FROM part WHERE p_partkey % 2 = 0""")
def format_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not canonical, with their diff."""
    gap = F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(" ")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("file"), written("#", gap, F.trim("p_name"), "\n").alias("source"))
    found = format_check(Engine(spark).format(rows))
    return found.select(F.col("file").cast("long").alias("p_partkey"), F.regexp_extract("diff", r"(?s)@@\n(.*)\n$", 1).alias("diff"))
