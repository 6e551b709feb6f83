"""Variables and function calls of values, evaluated in the JVM.

A value is ordered JSON text (SQL NULL is undefined); references in it are objects that begin with
`$$mdtype`.  Its tokens are folded over a stack of open collections.  When a collection closes, its
text, or what its reference stands for, goes to the collection around it: undefined elements of an
array become null, undefined entries of a hash go, undefined parameters of a call stay undefined.  A
path is followed step by step through the text of the variables, so hashes keep their order (a
VARIANT would sort them).  Expressions only; nothing here calls Python.

A value that is known when the plan is built is not folded in each row: its references become
expressions of their own (`resolve_known`), by the same rules.

Strings come out with the escapes they came in with.  Variables that are no JSON object are undefined.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.columns import md_equals, truthy

#: Levels of collections and calls that a value may have; what lies deeper is undefined.
MAX_DEPTH = 64
#: The functions that have an expression here.
NATIVE = frozenset({"and", "or", "not", "equals", "default", "debug"})

_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'
_TEXTS = "array<string>"
_FRAME = f"struct<open:string,depth:int,key:string,keys:{_TEXTS},values:{_TEXTS},inner_keys:{_TEXTS},inner_values:{_TEXTS}>"
#: Whole numbers below this are exact as doubles and as longs.
_WHOLE = float(1 << 53)


def tokens(text: Column) -> Column:
    """Strings, punctuation, numbers and words of a JSON text, without white space."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), 0)


def quoted_text(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _scalar(token: Column) -> Column:
    """A number without a needless point or exponent; other tokens as they are."""
    x = token.try_cast("double")
    whole = token.rlike("^-?[0-9]") & (F.abs(x) < _WHOLE) & (F.floor(x) == x)
    return F.when(F.coalesce(whole, F.lit(False)), x.cast("long").cast("string")).otherwise(token)


def compact(text: Column) -> Column:
    """The same JSON without white space, whole numbers as such."""
    return F.array_join(F.transform(tokens(text), _scalar), "")


def _segment(token: Column) -> Column:
    """A path segment as text; numbers in the spelling of hash keys."""
    written = F.substring(token, F.lit(2), F.length(token) - 2)
    plain = F.when(F.contains(token, F.lit("\\")), F.try_parse_json(token).try_cast("string")).otherwise(written)
    return F.when(token.startswith('"'), plain).otherwise(_scalar(token))


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _child(kind: str, text: Column, key: Column, known) -> Column:
    """The element of a collection as JSON text.  Texts of elements lose the quotes of strings; a VARIANT tells those that could be something else."""

    def written(value: Column) -> Column:
        typed = F.schema_of_variant(F.try_element_at(F.try_parse_json(text).try_cast(kind.format("variant")), key))
        other = value.rlike(r'^(?:[{\["0-9-]|true$|false$|null$|NaN$|Infinity$)')
        return F.when(value.isNull(), "null").when(~other | F.coalesce(typed == "STRING", F.lit(False)), quoted_text(value)).otherwise(value)

    entries = F.from_json(text, kind.format("string"))
    return _let(entries, lambda texts: F.when(F.coalesce(known(texts), F.lit(False)), _let(F.try_element_at(texts, key), written)))


def element(text: Column, segment: Column) -> Column:
    """One step of a path: a hash by key, an array by a whole number (or its digits)."""
    index = F.when(segment.rlike("^[0-9]{1,9}$"), segment.try_cast("int") + 1)
    entry = _child("map<string,{}>", text, segment, lambda m: F.map_contains_key(m, segment))
    item = _child("array<{}>", text, index, lambda a: index <= F.size(a))
    return F.when(text.startswith("{"), entry).when(text.startswith("["), item)


def look_up(path: Column, scopes: list[Column]) -> Column:
    """What a path (JSON tokens) names in the first scope that holds its first segment; scopes are compact texts of objects."""

    def followed(segments: Column) -> Column:
        first = F.coalesce(*(element(s, F.get(segments, F.lit(0))) for s in scopes), F.lit(None).cast("string"))
        return F.aggregate(F.slice(segments, 2, MAX_DEPTH * MAX_DEPTH), first, element)

    return _let(F.transform(path, _segment), followed)


def debug_column_text(value: Column) -> Column:
    """Indented JSON, two spaces a level, as a document's `debug` prints it."""
    opens, closes = ["{", "["], ["}", "]"]
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] - F.when(t.isin(closes), 1).otherwise(0)
        empty = s["before"].isin(opens)
        breaks = F.when(t.isin(closes), ~empty).when(t.isin(",", ":"), F.lit(False)).otherwise(empty | (s["before"] == ","))
        text = F.concat(s["text"], F.when(breaks, line(depth)).otherwise(""), _plain(t), F.when(t == ":", " ").otherwise(""))
        return F.struct(text.alias("text"), (depth + F.when(t.isin(opens), 1).otherwise(0)).alias("depth"), t.alias("before"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit("").alias("before"))
    return F.aggregate(tokens(value), start, step, lambda s: s["text"])


def _plain(token: Column) -> Column:
    """A number without an exponent (38 digits, 15 of them behind the point); what is not finite is null."""
    exact = F.regexp_replace(token.try_cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    number = F.when(token.rlike("[eE]"), F.coalesce(exact, token)).otherwise(_scalar(token))
    return F.when(token.rlike("^-?[0-9]"), number).when(token.isin("NaN", "Infinity", "-Infinity"), "null").otherwise(token)


def results(keys: Column, values: Column) -> dict[str, Column]:
    """What each function gives over parameters (JSON texts; null is undefined)."""
    spelled = lambda c: F.when(c, "true").otherwise("false")
    nth = lambda k: F.get(values, (F.array_position(keys, F.lit(f'"{k}"')) - 1).cast("int"))
    first = F.get(values, F.lit(0))
    return {
        "and": spelled(F.forall(values, truthy)),
        "or": spelled(F.exists(values, truthy)),
        "not": spelled(~truthy(nth(0))),
        "equals": spelled(F.forall(values, lambda v: v.eqNullSafe(first) | md_equals(first, v))),
        "default": F.coalesce(nth(0), nth(1)),
        "debug": F.when(nth(0).isNotNull(), quoted_text(debug_column_text(nth(0)))),
    }


def call(name: Column, keys: Column, values: Column) -> Column:
    """A function (the JSON text of its name) over parameters."""
    out = F.lit(None).cast("string")
    for known, result in results(keys, values).items():
        out = F.when(name == f'"{known}"', result).otherwise(out)
    return out


def _frame(open_: Column, depth: Column) -> Column:
    none = F.array().cast(_TEXTS)
    return F.struct(open_.alias("open"), depth.alias("depth"), F.lit(None).cast("string").alias("key"), none.alias("keys"), none.alias("values"), none.alias("inner_keys"), none.alias("inner_values")).cast(_FRAME)


def _added(frame: Column, value: Column) -> Column:
    own = (frame["key"] == '"$$mdtype"') | _reference(frame).isNotNull()  # what a reference is made of has no level
    kept = F.when((frame["depth"] < MAX_DEPTH) | F.coalesce(own, F.lit(False)), value)
    frame = frame.withField("keys", F.array_append(frame["keys"], frame["key"])).withField("values", F.array_append(frame["values"], kept))
    return frame.withField("key", F.lit(None).cast("string"))


def _reference(frame: Column) -> Column:
    """The kind of reference that an open hash is, as JSON text; null for other collections."""
    kind = F.get(frame["values"], F.lit(0))
    return F.when((F.get(frame["keys"], F.lit(0)) == '"$$mdtype"') & kind.isin('"Variable"', '"Function"'), kind)


def _closed(frame: Column, scopes: list[Column]) -> Column:
    pairs = F.zip_with(frame["keys"], frame["values"], lambda k, v: F.when(v.isNotNull(), F.concat(k, F.lit(":"), v)))
    whole = (
        F.when(frame["open"] == "[", F.concat(F.lit("["), F.array_join(frame["values"], ",", "null"), F.lit("]")))
        .otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(pairs), ","), F.lit("}")))
    )
    kind = _reference(frame)
    called = call(F.get(frame["values"], F.lit(1)), frame["inner_keys"], frame["inner_values"])
    return F.when(kind == '"Variable"', look_up(frame["inner_values"], scopes)).when(kind == '"Function"', called).otherwise(whole)


def resolve_text(value: Column, scopes: list[Column]) -> Column:
    """A value's JSON text with all references evaluated; `scopes` are variables (texts of JSON objects), the first that has a name wins."""
    bound = F.array(F.struct(*(compact(s).alias(f"scope{k}") for k, s in enumerate(scopes)), tokens(value).alias("tokens")))  # made once a row
    return F.get(F.transform(bound, lambda b: _folded(b["tokens"], [b[f"scope{k}"] for k in range(len(scopes))])), F.lit(0))


class _Known:
    """Expressions of a value whose text is at hand, for scopes that are bound; `_Odd` for references of another shape than the grammar makes."""

    def __init__(self, text: str, scopes: list[Column]):
        self.tokens, self.at, self.scopes = re.findall(_TOKEN, text), 0, scopes

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self, depth: int) -> Column:
        """The value that stands here, in a collection of this depth."""
        token = self.take()
        if token == "[":
            out = self.array(depth + 1)
        elif token == "{":
            out = self.reference(depth + 1) if self.tokens[self.at] == '"$$mdtype"' and self.tokens[self.at + 2] in ('"Variable"', '"Function"') else self.hash(depth + 1)
        else:
            out = _scalar(F.lit(token))
        return out if depth < MAX_DEPTH else F.lit(None).cast("string")

    def listed(self, close: str, item) -> list:
        out = []
        while self.tokens[self.at] != close:
            out.append(item())
            if self.tokens[self.at] == ",":
                self.at += 1
        self.at += 1
        return out

    def pair(self, depth: int) -> tuple[str, Column]:
        key = self.take()
        self.at += 1
        return key, self.value(depth)

    def array(self, depth: int) -> Column:
        items = self.listed("]", lambda: self.value(depth))
        return F.concat(F.lit("["), F.array_join(F.array(*items).cast(_TEXTS), ",", "null"), F.lit("]"))

    def hash(self, depth: int) -> Column:
        pairs = [F.when(bound.isNotNull(), F.concat(F.lit(f"{key}:"), bound)) for key, bound in self.listed("}", lambda: self.pair(depth))]
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs).cast(_TEXTS)), ","), F.lit("}"))

    def expect(self, *tokens: str) -> None:
        if tuple(self.tokens[self.at : self.at + len(tokens)]) != tokens:
            raise _Odd
        self.at += len(tokens)

    def reference(self, depth: int) -> Column:
        kind = self.tokens[self.at + 2]
        self.expect('"$$mdtype"', ":", kind, ",")
        if kind == '"Variable"':
            self.expect('"path"', ":", "[")
            path = self.listed("]", self.take)
            if not path or {"[", "{"} & set(path):
                raise _Odd
            self.expect("}")
            return look_up_known(path, self.scopes)
        self.expect('"name"', ":")
        name = self.take()
        self.expect(",", '"parameters"', ":", "{")
        pairs = self.listed("}", lambda: self.pair(depth))
        self.expect("}")
        if name.strip('"') not in NATIVE:
            return F.lit(None).cast("string")
        keys, values = F.array(*[F.lit(k) for k, _ in pairs]).cast(_TEXTS), F.array(*[v for _, v in pairs]).cast(_TEXTS)
        return _let(values, lambda bound: results(keys, bound)[name.strip('"')])


class _Odd(ValueError):
    """A reference that is not written as the grammar writes it."""


def look_up_known(path: list[str], scopes: list[Column]) -> Column:
    """`look_up` of a path that is known: a step an expression."""
    first, *rest = [_segment(_scalar(F.lit(token))) for token in path]
    step = lambda value, segment: _let(value, lambda text: element(text, segment))
    return functools.reduce(step, rest, F.coalesce(*(element(s, first) for s in scopes), F.lit(None).cast("string")))


def resolve_known(text: str, scopes: list[Column]) -> Column:
    """`resolve_text` of one value for all rows, whose text is known: what it refers to, without a fold over its tokens."""

    def resolved(bound: list[Column]) -> Column:
        try:
            return _Known(text, bound).value(-1)
        except _Odd:
            return _folded(tokens(F.lit(text)), bound)

    if not scopes:
        return resolved([])
    made = F.struct(*(compact(s).alias(f"scope{k}") for k, s in enumerate(scopes)))
    return _let(made, lambda b: resolved([b[f"scope{k}"] for k in range(len(scopes))]))


def _folded(value: Column, scopes: list[Column]) -> Column:
    def step(stack: Column, token: Column) -> Column:
        top, under = F.element_at(stack, -1), F.try_element_at(stack, F.lit(-2))
        below = lambda n: F.slice(stack, 1, F.size(stack) - n)
        replaced = lambda n, frame: F.array_append(below(n), frame)
        in_reference = lambda frame: F.coalesce(_reference(frame).isNotNull() & frame["key"].isin('"path"', '"parameters"'), F.lit(False))
        level = F.when(~in_reference(top), top["depth"] + 1).when(top["key"] == '"parameters"', top["depth"]).otherwise(0)
        opened = F.array_append(stack, _frame(token, level))
        inner = under.withField("inner_keys", top["keys"]).withField("inner_values", top["values"]).withField("key", F.lit(None).cast("string"))
        closed = F.when(in_reference(under), replaced(2, inner)).otherwise(replaced(2, _added(under, _closed(top, scopes))))
        is_key = (top["open"] == "{") & top["key"].isNull()
        scalar = F.when(is_key, replaced(1, top.withField("key", token))).otherwise(replaced(1, _added(top, _scalar(token))))
        return F.when(token.isin("{", "["), opened).when(token.isin("}", "]"), closed).when(token.isin(",", ":"), stack).otherwise(scalar)

    start = F.array(_frame(F.lit(""), F.lit(-1))).cast(f"array<{_FRAME}>")
    return F.aggregate(value, start, step, lambda stack: F.get(F.element_at(stack, 1)["values"], F.lit(0)))
