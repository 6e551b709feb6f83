"""Golden documents by family: source, configuration, and the tree, HTML or errors they give."""

import pytest

from foliospark.functions.sql import comment_ranges
from foliospark.kernel.build import ParseOptions, outline, parse
from foliospark.kernel.check import validate
from foliospark.kernel.render import render
from foliospark.kernel.schema import Attribute, Config, Schema, Slot
from foliospark.kernel.transform import to_plain, transform

OPTIONS = ParseOptions(allow_comments=True)


def html(source, config=None, options=OPTIONS):
    return render(transform(parse(source, options), config or Config()))


def errors(source, config=None, options=OPTIONS):
    return [(p.id, p.level, p.message) for _, p in validate(parse(source, options), config or Config())]


def variables(**given):
    return Config.of(variables=given)


HTML = {
    "paragraph": ("Hello\nworld", "<p>Hello world</p>"),
    "annotation id": ("# Title {% #top %}", '<h1 id="top">Title </h1>'),
    "annotation classes": ("Text {% .a .b %}", '<p class="a b">Text </p>'),
    "setext is no heading": ("Text\n===", "<p>Text ===</p>"),
    "rule below text": ("Text\n---", "<p>Text</p><hr>"),
    "raw html is text": ("<b>x</b>", "<p>&lt;b&gt;x&lt;/b&gt;</p>"),
    "emphasis": ("*a* **b** ~~c~~ `d`", "<p><em>a</em> <strong>b</strong> <s>c</s> <code>d</code></p>"),
    "nested emphasis": ("***a** b*", "<p><em><strong>a</strong> b</em></p>"),
    "hard break": ("a  \nb\\\nc", "<p>a<br>b<br>c</p>"),
    "entities": ("&copy; &#65; &x;", "<p>© A &amp;x;</p>"),
    "escapes": (r"\*a\* \{", "<p>*a* {</p>"),
    "tight list": ("- a\n- b\n", "<ul><li>a</li><li>b</li></ul>"),
    "loose list": ("- a\n\n- b\n", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"),
    "ordered list": ("3. a\n4. b\n", '<ol start="3"><li>a</li><li>b</li></ol>'),
    "nested list": ("- a\n  - b\n", "<ul><li>a<ul><li>b</li></ul></li></ul>"),
    "quote": ("> a\n> b\n", "<blockquote><p>a b</p></blockquote>"),
    "lazy quote": ("> a\nb\n", "<blockquote><p>a b</p></blockquote>"),
    "fence": ("```js\nlet a = 1;\n```\n", '<pre data-language="js">let a = 1;\n</pre>'),
    "fence keeps tags": ("```\n{% $x %}\n```\n", "<pre>{% $x %}\n</pre>"),
    "indented code": ("    code\n", "<pre>code\n</pre>"),
    "link": ('[a](/b "t")', '<p><a href="/b" title="t">a</a></p>'),
    "reference link": ("[a][r]\n\n[r]: /b\n", '<p><a href="/b">a</a></p>'),
    "autolink": ("<https://a.example/b>", '<p><a href="https://a.example/b">https://a.example/b</a></p>'),
    "unsafe link": ("[a](javascript:x)", "<p>[a](javascript:x)</p>"),
    "image": ("![a *b*](/c.png)", '<p><img src="/c.png" alt="a *b*"></p>'),
    "pipe table": ("| A | B |\n|:--|--:|\n| 1 | 2 |\n", '<table><thead><tr><th align="left">A</th><th align="right">B</th></tr></thead><tbody><tr><td align="left">1</td><td align="right">2</td></tr></tbody></table>'),
    "table tag": ("{% table %}\n* A\n* B\n---\n* 1\n* 2\n{% /table %}\n", "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
    "comment": ("a\n\n<!-- gone -->\n\nb\n", "<p>a</p><p>b</p>"),
    "if false": ("{% if false %}\na\n{% else /%}\nb\n{% /if %}\n", "<p>b</p>"),
    "a written zero is no condition": ("{% if 0 %}a{% /if %}b", "<p>b</p>"),
    "unknown tag splices": ("{% nope %}x{% /nope %}", "<p>x</p>"),
    "debug": ("{% debug({a: [1, null]}) %}", "{\n  &quot;a&quot;: [\n    1,\n    null\n  ]\n}"),
}


@pytest.mark.parametrize("name", HTML)
def test_html(name):
    source, expected = HTML[name]
    assert html(source) == f"<article>{expected}</article>"


def test_variables_and_paths():
    config = variables(user={"name": "Ann", "tags": ["x", "y"]}, n=3.0)
    assert html('{% $user.name %} {% $user.tags[1] %} {% $user["name"] %} {% $n %} {% $missing %}', config) == "<article><p>Ann y Ann 3 </p></article>"


def test_zero_and_empty_text_hold():
    assert html("{% if $z %}a{% /if %}{% if $e %}b{% /if %}{% if $n %}c{% /if %}", variables(z=0.0, e="", n=None)) == "<article><p>ab</p></article>"


def test_equality_is_deep_and_ignores_the_order_of_keys():
    config = variables(a={"x": 1.0, "y": [2.0]})
    assert html("{% if equals($a, {y: [2], x: 1}) %}\nsame\n{% /if %}", config) == "<article><p>same</p></article>"
    assert html("{% if equals($none, null) %}\nsame\n{% /if %}", config) == "<article></article>"


def test_default_keeps_null():
    assert html('{% if default($x, true) %}\nyes\n{% /if %}', variables(x=None)) == "<article></article>"


def test_attributes_come_in_schema_order_after_class_and_id():
    config = Config.of({"box": Schema("div", attributes={"b": Attribute("String"), "a": Attribute("String", "data-a"), "c": Attribute("Number", default=1.0), "d": Attribute("String", False)})})
    assert html('{% box a="1" b="2" d="3" e="4" #i .k /%}', config) == '<article><div class="k" id="i" b="2" data-a="1" c="1"></div></article>'


def test_partials_take_variables_and_know_their_name():
    config = Config.of(variables={"who": "A"}, partials={"p.md": parse("Hi {% $who %} {% $n %}")})
    assert html('{% partial file="p.md" variables={n: 2} /%}', config) == "<article><p>Hi A 2</p></article>"


def test_a_partial_that_includes_itself_expands_to_the_depth_limit():
    config = Config.of(partials={"p.md": parse('x\n\n{% partial file="p.md" /%}\n')})
    assert html('{% partial file="p.md" /%}', config) == "<article>" + "<p>x</p>" * 508 + "<p></p>" * 2 + "</article>"


def test_a_partial_that_includes_itself_twice_ends():
    config = Config.of(partials={"p.md": parse('{% partial file="p.md" /%}\n\n{% partial file="p.md" /%}\n')})
    assert html('{% partial file="p.md" /%}', config) == "<article></article>"


def comments_of(node):
    """Block and inline comments of a tree as (kind of the node above, content)."""
    found = [(node.tag or node.type, c.attributes["content"]) for c in node.children if c.type == "comment"]
    return found + [x for c in node.children for x in comments_of(c)]


#: Where a comment block is one, what it holds and what goes on behind it; sources by place.
COMMENTS = {
    "past the end of an item": ("2. <!-- one\ntwo\n--> lost\nnext\n", [("item", "one\ntwo")], '<ol start="2"><li></li></ol><p>next</p>'),
    "the list goes on": ("* <!-- one\ntwo -->\n* next\n", [("item", "one\ntwo")], "<ul><li></li><li>next</li></ul>"),
    "the quote goes on": ("> <!-- one\ntwo -->\n> next\n", [("blockquote", "one\ntwo")], "<blockquote><p>next</p></blockquote>"),
    "over a blank line": ("* <!-- one\n\ntwo -->\nnext\n", [("item", "one\n\ntwo")], "<ul><li></li></ul><p>next</p>"),
    "quote in quote": ("> > <!-- one\n> two -->\n> next\n", [("blockquote", "one\n> two")], "<blockquote><blockquote></blockquote><p>next</p></blockquote>"),
    "one in each item": ("+ <!-- one\n1 -->\n+ <!-- two\n2 -->\n", [("item", "one\n1"), ("item", "two\n2")], "<ul><li></li><li></li></ul>"),
    "a tag behind it": ("<!-- one\ntwo --> {% if $x %}\n", [("document", "one\ntwo")], ""),
    "a tag inside it": ("{% if true %}\n> <!-- one\n{% /if %}\n-->\n{% /if %}\nnext\n", [("blockquote", "one\n{% /if %}")], "<blockquote></blockquote><p>next</p>"),
    "a fence in a quote": ("> ~~~\n> <!-- one\n> two -->\n> ~~~\n", [], "<blockquote><pre>&lt;!-- one\ntwo --&gt;\n</pre></blockquote>"),
    "behind such a fence": ("> ~~~\n> <!-- one\n> <!-- two\n> ~~~\n> <!-- three\n{% if %}\n> -->\n", [("blockquote", "three\n{% if %}\n>")], "<blockquote><pre>&lt;!-- one\n&lt;!-- two\n</pre></blockquote>"),
    "indented code": ("    <!-- one\n    two -->\n", [], "<pre>&lt;!-- one\ntwo --&gt;\n</pre>"),
    "bars but no table": ("p | q\n<!-- one\ntwo -->\n", [("document", "one\ntwo")], "<p>p | q</p>"),
    "a row of a table": ("| p |\n|---|\n<!-- one\ntwo -->\n", [], "<table><thead><tr><th>p</th></tr></thead><tbody><tr><td>&lt;!-- one</td></tr><tr><td>two --&gt;</td></tr></tbody></table>"),
    "a cell's own": ("| p |\n|---|\n<!-- one --> two\n", [("inline", "one")], "<table><thead><tr><th>p</th></tr></thead><tbody><tr><td> two</td></tr></tbody></table>"),
    "behind a table": ("> | p |\n> |---|\n>\n> <!-- one\n> two -->\n", [("blockquote", "one\n> two")], "<blockquote><table><thead><tr><th>p</th></tr></thead></table></blockquote>"),
    "other line ends": ("<!-- one\r\ntwo\rthree -->\r\n", [("document", "one\ntwo\nthree")], ""),
    "no end": ("<!-- one\n\n# two", [], "<p>&lt;!-- one</p><h1>two</h1>"),
    "the shortest": ("<!-->\n<!-- two -->", [("document", ""), ("document", "two")], ""),
    "inline, a quote's lines": ("> p <!-- one\n>     two --> q\n", [("inline", "one\n    two")], "<blockquote><p>p  q</p></blockquote>"),
    "inline, an item's lines": ("* p <!-- one\n    two\n three --> q\n", [("inline", "one\n  two\n three")], "<ul><li>p  q</li></ul>"),
    "inline, a tab in a quote": ("> p <!-- one\n>\ttwo --> q\n", [("inline", "one\n\ttwo")], "<blockquote><p>p  q</p></blockquote>"),
    "inline, a tab in an item": ("* p <!-- one\n\ttwo --> q\n", [("inline", "one\n  two")], "<ul><li>p  q</li></ul>"),
    "inline, parted": ("p <!-- one\n\ntwo --> q\n", [], "<p>p &lt;!-- one</p><p>two --&gt; q</p>"),
}


@pytest.mark.parametrize("case", COMMENTS)
def test_comments_by_place(case):
    source, found, want = COMMENTS[case]
    assert comments_of(parse(source, OPTIONS)) == found
    assert html(source) == f"<article>{want}</article>"


def test_ranges_of_comments_are_sorted_disjoint_and_in_no_code():
    for source, found, _ in COMMENTS.values():
        ranges = list(comment_ranges(source))
        assert all(a < b for pair in zip(ranges, ranges[1:], strict=False) for (_, a), (b, _) in [pair])
        blocks = [text for kind, text in found if kind != "inline" and ("\n" in text)]
        assert [source[a:b][4:-3].strip().replace("\r\n", "\n").replace("\r", "\n") for a, b in ranges] == blocks


def test_slots_become_attributes():
    config = Config.of({"panel": Schema("section", slots={"head": Slot()})})
    tree = transform(parse('{% panel %}\n\n{% slot "head" %}\nTitle\n{% /slot %}\n\nBody\n\n{% /panel %}\n', ParseOptions(slots=True)), config)
    section = to_plain(tree)["children"][0]
    assert section["children"] == [{"$$mdtype": "Tag", "name": "p", "attributes": {}, "children": ["Body"]}]
    assert "Title" in str(section["attributes"]["head"])


def test_process_splits_tags_inside_a_fence():
    assert html("```js {% process=true %}\na {% $x %} b\n```\n", variables(x="1")) == '<article><pre data-language="js">a 1 b\n</pre></article>'


def test_links_are_encoded_when_rendered_only():
    tree = parse("[a](</ä b>)")
    assert 'href="/ä b"' in outline(tree)
    assert html("[a](</ä b>)") == '<article><p><a href="/%C3%A4%20b">a</a></p></article>'


CALLOUT = Config.of({"callout": Schema("aside", ("paragraph",), {"type": Attribute("String", required=True, matches=["note", "tip"]), "n": Attribute(("Number", "Boolean"), error_level="warning")}), "icon": Schema("i", inline=True, self_closing=True)})

ERRORS = {
    "undefined tag": ("{% nope /%}", [("tag-undefined", "critical", "Undefined tag: 'nope'")]),
    "missing required": ("{% callout /%}", [("attribute-missing-required", "error", "Missing required attribute: 'type'")]),
    "matches": ('{% callout type="loud" /%}', [("attribute-value-invalid", "error", "Attribute 'type' must match one of [\"note\",\"tip\"]. Got 'loud' instead.")]),
    "type": ('{% callout type="tip" n="x" /%}', [("attribute-type-invalid", "warning", "Attribute 'n' must be type of 'Number | Boolean'")]),
    "undefined attribute": ('{% callout type="tip" z=1 /%}', [("attribute-undefined", "error", "Invalid attribute: 'z'")]),
    "child": ('{% callout type="tip" %}\n# a\n{% /callout %}', [("child-invalid", "warning", "Can't nest 'heading' in 'callout'")]),
    "placement": ('{% icon /%}', [("tag-placement-invalid", "critical", "'icon' tag should be inline")]),
    "self closing": ("a {% icon %}x{% /icon %}", [("tag-selfclosing-has-children", "critical", "'icon' tag should be self-closing")]),
    "unopened": ("{% /callout %}", [("missing-opening", "critical", "Node 'callout' is missing opening"), ("attribute-missing-required", "error", "Missing required attribute: 'type'")]),
    "unclosed": ('{% callout type="tip" %}', [("missing-closing", "critical", "Node 'callout' is missing closing")]),
    "duplicate": ('{% callout type="tip" type="note" /%}', [("duplicate-attribute", "warning", "Attribute 'type' already set")]),
    "id": ('# a {% id="1" %}', [("attribute-value-invalid", "error", "The 'id' attribute must start with a letter")]),
    "class": ("# a {% class=1 %}", [("attribute-type-invalid", "error", "Attribute 'class' must be type 'string | object'")]),
    "partial": ('{% partial file="x" /%}', [("attribute-value-invalid", "error", "Partial `x` not found. The 'file' attribute must be set in `config.partials`")]),
    "clean": ('{% callout type="tip" n=true %}\ntext\n{% /callout %}', []),
}


@pytest.mark.parametrize("name", ERRORS)
def test_errors(name):
    source, expected = ERRORS[name]
    assert errors(source, CALLOUT) == expected


def test_undefined_variables_only_where_variables_are_configured():
    assert errors('{% callout type=$a.b /%}', CALLOUT) == []
    config = Config.of(CALLOUT.tags, variables={"a": {"c": 1.0}})
    assert errors('{% callout type=$a.b /%}', config)[0] == ("variable-undefined", "error", "Undefined variable: 'a.b'")


def test_syntax_errors_name_what_was_expected():
    (found,) = [e for e in errors("{% callout type= /%}") if e[0] == "parse-error"]
    assert found[1] == "critical" and found[2].startswith("Expected ") and found[2].endswith(" found.")


def test_deep_documents_neither_fail_nor_render_without_end():
    assert html("> " * 600 + "x").count("<blockquote>") <= 512
    assert parse("[" * 5000 + "x").children
    assert parse("*a " * 5000).children


def test_remembered_tags_are_not_changed():
    source = "# x {% class={a: true} .b %}\n"
    assert html(source) == html(source) == '<article><h1 class="a b">x </h1></article>'
