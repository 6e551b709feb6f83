"""Tags that are read by one pattern against the reader, which knows every form."""

import random

import pytest

from foliospark.kernel import grammar
from foliospark.kernel.format import FormatOptions, settle
from foliospark.kernel.grammar import TagError, parse_tag, plain_tag, read_tag

PIECES = ["card", "a", "name=", "=", "null", "true", "nullx", "1", "-1", "1.5", "1.", '"x"', '"a\\"b"', '"\\q"', "#i", ".k", " ", "\n", "/", "$v", "f(", "-x", "é", "null=1", "a=1", "b=true", "c=null", 'd="z"', 'e="x', "[1]", "007=1", "t=-3.25"]


def test_plain_tags_are_what_the_reader_gives():
    draw, plain = random.Random(3), 0
    for _ in range(30_000):
        body = "".join(draw.choice(PIECES) + " " * (draw.random() < 0.35) for _ in range(draw.randrange(1, 7))).strip()
        got = plain_tag(body)
        if got is not None:
            plain += 1
            assert got == read_tag(body) and [type(a.value) for a in got.attributes] == [type(a.value) for a in read_tag(body).attributes], body
    assert plain > 1_000


@pytest.mark.parametrize("body", ["a null=1", "a 1=2", "a -x=1", 'a b="x', "a#i", "a $v", "#i", "a b=[1]", "/a", "a b=1x", ""])
def test_other_tags_go_to_the_reader(body):
    assert plain_tag(body) is None
    try:
        want = read_tag(body)
    except TagError as e:
        with pytest.raises(TagError, match=r".") as got:
            parse_tag(body)
        assert got.value.message == e.message
    else:
        assert parse_tag(body) == want


def test_a_long_tag_is_formatted_without_the_reader(monkeypatch):
    monkeypatch.setattr(grammar, "read_tag", None)
    text, settled = settle('{% card name="Ann 77"   segment="none" balance=1 note="a rather long text that does not fit" /%}\n', FormatOptions())
    assert settled and text.startswith('{% card\n   name="Ann 77"\n   segment="none"')
