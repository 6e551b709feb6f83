"""Trees and messages by family, with sources of our own: tables, slots, partials, fences, hashes, multi-line tags."""

import pytest

from foliospark.kernel.build import ParseOptions, parse
from foliospark.kernel.check import validate
from foliospark.kernel.schema import Attribute, Config, Schema, Slot
from foliospark.kernel.transform import to_plain, transform

WORDS = Config.of(
    {
        "box": Schema("div", attributes={"v": Attribute(), "o": Attribute("Object"), "l": Attribute("Array"), "t": Attribute("String")}, slots={"head": Slot(), "foot": Slot(required=False), "quiet": Slot(render=False)}),
        "wrap": Schema("div"),
        "mark": Schema("mark"),
        "needs": Schema("div", slots={"head": Slot(required=True)}),
        "both": Schema("div", attributes={"head": Attribute("String")}, slots={"head": Slot()}),
    },
    variables={"yes": True, "no": False, "zero": 0.0, "empty": "", "nil": None, "word": "kiwi", "deep": {"a key": "lime"}},
    partials={"one.md": parse("From one"), "two.md": parse("{% box v=$n %}\nFrom two\n{% /box %}\n")},
)


def E(name, *children, **attributes):  # noqa: N802
    return {"$$mdtype": "Tag", "name": name, "attributes": {k.replace("_", "-"): v for k, v in attributes.items()}, "children": list(children)}


def p(*children):
    return E("p", *children)


def tree(source, slots=False):
    options = ParseOptions(slots=slots, allow_comments=True)
    return to_plain(transform(parse(source, options), WORDS))["children"]


def messages(source, slots=False):
    return [found.message for _, found in validate(parse(source, ParseOptions(slots=slots, allow_comments=True)), WORDS)]


def row(kind, *cells):
    return E("tr", *(E(kind, *(c if isinstance(c, list) else [c])) for c in cells))


def table(head, *body):
    return E("table", E("thead", *head), E("tbody", *body))


HEAD = [row("th", "H1", "H2")]

TREES = {
    "attributes of cells": (
        '{% table %}\n* H1 {% width="9%" %}\n* H2\n---\n* a\n* b {% colspan=2 %}\n{% /table %}\n',
        [table([E("tr", E("th", "H1 ", width="9%"), E("th", "H2"))], E("tr", E("td", "a"), E("td", "b ", colSpan=2)))],
    ),
    "no header": ("{% table %}\n---\n* a\n* b\n{% /table %}\n", [table([], row("td", "a", "b"))]),
    "conditional rows": (
        "{% table %}\n* H1\n* H2\n---\n{% if $no %}\n* a\n* b\n{% /if %}\n---\n{% if $yes %}\n* c\n* d\n---\n* e\n* f\n{% /if %}\n{% /table %}\n",
        [table(HEAD, row("td", "c", "d"), row("td", "e", "f"))],
    ),
    "either row": ("{% table %}\n* H1\n* H2\n---\n{% if $no %}\n* a\n* b\n{% else /%}\n* c\n* d\n{% /if %}\n{% /table %}\n", [table(HEAD, row("td", "c", "d"))]),
    "blocks inside cells": (
        "{% table %}\n---\n* a\n* \n    ```sh\n    ls \"x\"\n    ```\n* b\n---\n* c\n*\n    d\n* e\n{% /table %}\n",
        [table([], row("td", "a", E("pre", 'ls "x"\n', data_language="sh"), "b"), row("td", "c", "d", "e"))],
    ),
    "pipes inside the tag": ("{% table %}\nH1 | H2\n--|--\na | b\n{% /table %}\n", [table(HEAD, row("td", "a", "b"))]),
    "conditions inside cells": (
        "{% table %}\n* H1\n* H2\n---\n* a\n* {% if $yes %}b{% /if %}\n---\n* c\n* d\n\n  {% if $no %}\n  e\n  {% else /%}\n  f\n  {% /if %}\n{% /table %}\n",
        [table(HEAD, row("td", "a", "b"), row("td", p("c"), [p("d"), p("f")]))],
    ),
    "hash, nested array and newlines": ("{% box o={a: [1, {b: null}], \"two words\": true,} l=[\n [1, 2],\n [3],\n] /%}\n", [E("div", o={"a": [1, {"b": None}], "two words": True}, l=[[1, 2], [3]])]),
    "reserved key goes": ('{% box o={"x": 1, "$$mdtype": 2} /%}\n', [E("div", o={"x": 1})]),
    "empty collections": ("{% box o={} l=[] %}\nx\n{% /box %}\n", [E("div", p("x"), o={}, l=[])]),
    "escapes in strings": ('{% box t="a \\"b\\"\\nc\\\\" /%}\n', [E("div", t='a "b"\nc\\')]),
    "call as attribute": ("{% box v=and($yes, not($no)) /%}\n", [E("div", v=True)]),
    "tag over lines": ("{% \nbox\n#i .k\nt=\"x\"\n%}\ny\n{% /box %}\n", [E("div", p("y"), **{"class": "k", "id": "i", "t": "x"})]),
    "closing on a content line": ("{% box\n#i %}\ny\n{% /box %}\n", [E("div", p("y"), id="i")]),
    "odd indentation": ("{% wrap %}\n    {% wrap %}\n   text\n    {% /wrap %}\n{% /wrap %}\n", [E("div", E("div", p("text")))]),
    "quoted path": ('a {% $deep["a key"] %}', [p("a ", "lime")]),
    "inline value kinds": ("a {% $zero %}{% $nil %}{% $yes %} {% or($no, $zero) %}", [p("a ", 0, None, True, " ", True)]),
    "truth": ("{% if $zero %}\na\n{% /if %}\n\n{% if $empty %}\nb\n{% /if %}\n\n{% if $nil %}\nc\n{% /if %}\n\n{% if and($zero, $empty) %}\nd\n{% /if %}\n", [p("a"), p("b"), p("d")]),
    "comments go": ("# A <!-- x -->\n\nb <!-- y\nz -->\n\n<!--\nw\n-->\n", [E("h1", "A "), p("b ")]),
    "partials": ('x\n\n{% partial file="one.md" /%}\n\n{% partial file="two.md" variables={n: 1} /%}\n', [p("x"), p("From one"), E("div", p("From two"), v=1)]),
    "unknown partial": ('{% partial file="none" %}\nx\n{% /partial %}\n', [None]),
    "condition inside a fence": (
        "```js {% process=true %}\nrun\n{% if $yes %}\nlog('{% $word %}');\n{% /if %}\nend\n```\n",
        [E("pre", "run", "\nlog('", "kiwi", "');", "\nend\n", data_language="js")],
    ),
    "condition that fails inside a fence": ("```js {% process=true %}\nrun\n{% if $no %}\nlog();\n{% /if %}\nend\n```\n", [E("pre", "run", "\nend\n", data_language="js")]),
    "tags on one fence line": ("``` {% process=true %}\na {% $word %} b{% if $yes %}c{% /if %} d\n```\n", [E("pre", "a ", "kiwi", " b", "c", " d\n")]),
    "tag inside a fence": ("``` {% process=true %}\na\n{% box t=\"b\" %}\nc\n{% /box %}\n```\n", [E("pre", "a", E("div", "\nc", t="b"), "\n")]),
    "fences stay literal": ("```\na\n{% mark /%}\n```\n", [E("pre", "a\n{% mark /%}\n")]),
    "annotated fence": ("~~~ruby {% #f .k %}\nx\n~~~\n", [E("pre", "x\n", **{"class": "k", "id": "f", "data-language": "ruby"})]),
    "list items with annotations": ("- a {% .k %}\n- b\n", [E("ul", E("li", "a ", **{"class": "k"}), E("li", "b"))]),
    "mixed nesting": ("* a\n  * b\n  * ```js\n    c\n    ```\n  * d\n", [E("ul", E("li", "a", E("ul", E("li", "b"), E("li", E("pre", "c\n", data_language="js")), E("li", "d"))))]),
}


@pytest.mark.parametrize("name", TREES)
def test_trees(name):
    source, expected = TREES[name]
    assert tree(source) == expected


SLOTS = {
    "one": ('{% box %}\n  {% slot "head" %}\n  a\n  {% /slot %}\n{% /box %}\n', [E("div", head=[p("a")])]),
    "two and content": (
        '{% box t="x" %}\n  {% slot "head" %}\n  a **b**\n  {% /slot %}\n\n  {% slot "foot" %}\n  {% $word %}\n  {% /slot %}\n\n  rest\n{% /box %}\n',
        [E("div", p("rest"), t="x", head=[p("a ", E("strong", "b"))], foot=[p("kiwi")])],
    ),
    "not rendered": ('{% box %}\nx\n\n{% slot "quiet" %}\ny\n{% /slot %}\n{% /box %}\n', [E("div", p("x"))]),
    "over an attribute": ('{% both head="a" %}\n{% slot "head" %}\nb\n{% /slot %}\n{% /both %}\n\n{% both head="a" /%}\n', [E("div", head=[p("b")]), E("div", head="a")]),
}


@pytest.mark.parametrize("name", SLOTS)
def test_slots(name):
    source, expected = SLOTS[name]
    assert tree(source, slots=True) == expected


MESSAGES = {
    "comma in a hash": ("{% box o={,} /%}", ['Expected "}", identifier, string, or whitespace but "," found.']),
    "comma in an array": ("{% box l=[,] /%}", ['Expected "[", "]", "{", boolean, identifier, null, number, string, variable, or whitespace but "," found.']),
    "no commas": ("{% box l=[1 2] /%}", ['Expected ",", "]", or whitespace but "2" found.']),
    "paragraph in a table": ("{% table %}\n* a\n---\nb\n{% /table %}\n", ["Found paragraph where a list was expected. Make sure all content inside table cells is indented."]),
    "paragraph in a table's condition": ("{% table %}\n* a\n---\n* b\n{% if $yes %}\nc\n{% /if %}\n{% /table %}\n", ["Found paragraph where a list was expected. Make sure all content inside table cells is indented."]),
}


@pytest.mark.parametrize("name", MESSAGES)
def test_messages(name):
    source, expected = MESSAGES[name]
    assert messages(source) == expected


def test_slot_messages():
    assert messages("{% box %}\n{% slot %}\nx\n{% /slot %}\n{% /box %}\n", slots=True) == ["Missing required attribute: 'primary'"]
    assert messages("{% box %}\n{% slot 1 %}\nx\n{% /slot %}\n{% /box %}\n", slots=True) == ["Attribute 'primary' must be type of 'String'"]
    assert messages("{% needs %}\n{% /needs %}\n", slots=True) == ["Missing required slot: 'head'"]
    assert messages('{% mark %}\n{% slot "x" %}\ny\n{% /slot %}\n{% /mark %}\n', slots=True) == ["Invalid slot: 'x'"]
