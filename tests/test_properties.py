"""Properties over random documents: nothing fails, places are right, formatting settles."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foliospark.kernel.build import ParseOptions, outline, parse
from foliospark.kernel.check import validate
from foliospark.kernel.format import settle
from foliospark.kernel.render import render
from foliospark.kernel.schema import Config
from foliospark.kernel.transform import transform
from foliospark.kernel.tree import Positions
from foliospark.kernel.values import decode, deep_equal, encode
from foliospark.operators.nodes import deep, flatten

deep()
PIECES = ["{% ", " %}", "{% a %}", "{% /a %}", "{% b /%}", "{% $x %}", "{% if true %}", "{% /if %}", "*", "**", "_", "~~", "`", "[", "](", ")", "!", "> ", "- ", "1. ", "\n", "\n\n", "    ", "# ", "```\n", "| a |", "|---|\n", "<!-- ", " -->", "text", "é", "&amp;", "\\", '"', "#id", ".c", "javascript:", "---\n", "\t"]
soup = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)
quick = settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
values = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000).map(float) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3).filter(lambda k: k != "$$mdtype"), x, max_size=3), max_leaves=8)


@quick
@given(soup, st.booleans())
def test_nothing_fails(source, comments):
    tree = parse(source, ParseOptions(allow_comments=comments))
    html = render(transform(tree, Config()))
    validate(tree, Config())
    assert 'href="javascript:' not in html
    assert all(row["last_desc"] >= row["node_id"] for row in flatten(tree, source))


@quick
@given(soup)
def test_parsing_is_deterministic_and_places_stay_inside_the_source(source):
    tree = parse(source)
    assert outline(tree) == outline(parse(source))
    size = len(source.encode())
    for row in flatten(tree, source):
        if row["loc"]:
            a, b = row["loc"]["start"], row["loc"]["end"]
            assert 0 <= a["offset"] <= b["offset"] <= size and a["column"] <= a["offset"]


@quick
@given(st.text(max_size=60))
def test_positions_count_bytes(source):
    positions = Positions(source)
    for at in range(len(source) + 1):
        line, column, offset = positions.place(at)
        assert offset == len(source[:at].encode()) and line == source[:at].count("\n")
        assert column == len(source[:at].rpartition("\n")[2].encode())


@quick
@given(values)
def test_values_round_trip(value):
    assert deep_equal(decode(encode(value)), value)
    json.loads(encode(value))


@quick
@given(st.lists(st.sampled_from(["# h\n\n", "para *em* text\n\n", "- a\n- b\n\n", "1. a\n\n", "> q\n\n", "```js\nx\n```\n\n", "{% b a=1 /%}\n\n", "{% a %}\ntext\n{% /a %}\n\n", "---\n\n", "[l](/u)\n\n"]), max_size=8).map("".join))
def test_formatting_settles_and_keeps_the_tree(source):
    text, settled = settle(source)
    assert settled and settle(text) == (text, True)
    assert outline(parse(text)) == outline(parse(source))
