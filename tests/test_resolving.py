"""Values resolved in the JVM against the kernel, for every kind of reference and for generated values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions.document import BUILTIN, Function
from foliospark.kernel.resolve import resolve
from foliospark.kernel.schema import Config
from foliospark.kernel.values import decode, encode
from foliospark.operators.kernels import scope
from foliospark.operators.values import is_native, resolve_column, resolve_constant

SCOPE = '{"a": {"z":[1, 2.0 ,{"q":"x\\"y\\\\"}],"b":null,"n":1.50,"":"none","é":[]},"t":"view","s":"1","list":[[0,[true]],"null",{}], "false": false, "big":1e21}'
CONFIG = Config(variables={"c": 7.0, "t": "hidden", "deep": [{"k": [1.0, None]}]})


def variable(*path):
    return {"$$mdtype": "Variable", "path": list(path)}


def function(name, *values):
    return {"$$mdtype": "Function", "name": name, "parameters": {str(i): v for i, v in enumerate(values)}}


def nested(value, levels):
    for _ in range(levels):
        value = [value]
    return value


CASES = [
    variable("a"), variable("a", "z", 2, "q"), variable("a", "z", "1"), variable("a", "z", "01"), variable("a", "z", -1), variable("a", "z", 3), variable("a", "z", 0.5), variable("a", ""), variable("a", "é"),
    variable("t"), variable("c"), variable("deep", 0, "k", 1), variable("none"), variable("t", "x"), variable("list", 0, 1, 0), variable("list", 1), variable("false"), variable("a", "b", "c"),
    [variable("none"), {"k": variable("none"), "j": variable("t")}, []], {"x": {}, "y": [variable("list")]}, "{\"$$mdtype\":", {"$$mdtype": "Other", "a": variable("c")},
    function("and"), function("or"), function("not"), function("equals"), function("default"), function("debug"), function("own", 1),
    function("and", variable("t"), 0, ""), function("and", variable("none"), True), function("or", False, None, variable("none")), function("or", False, []), function("not", variable("a", "b")),
    function("equals", variable("t"), "view"), function("equals", 1, True), function("equals", variable("none"), variable("gone")), function("equals", variable("none"), None), function("equals", {"a": 1, "b": [2]}, {"b": [2.0], "a": 1}),
    function("default", variable("none"), {"d": [variable("t")]}), function("default", None, 1), function("debug", variable("a")), function("debug", []), function("debug", {"k": {}, "t": "a{b,[:\"]"}), function("debug", None),
    function("not", function("and", function("equals", variable("c"), 7), function("not", variable("false")))),
    function("default", function("default", variable("x"), variable("y")), function("debug", [function("or", 1)])),
    nested(variable("t"), 63), nested(variable("t"), 64), nested(variable("t"), 65), nested(function("not", False), 64),
]


def resolved(spark, values, own, config):
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False, separators=(",", ":")), own) for k, v in enumerate(values)], "k int, value string, own string").repartition(2)
    done = rows.select("k", resolve_column(spark, F.col("value"), config, F.col("own")).alias("got"))
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
    return [r["got"] for r in done.orderBy("k").collect()]


@pytest.mark.parametrize("own", [SCOPE, None, "{}"])
def test_every_kind_of_reference_as_in_the_kernel(spark, own):
    want = [encode(resolve(decode(json.dumps(v)), scope(CONFIG, own))) for v in CASES]
    assert resolved(spark, CASES, own, CONFIG) == want


def test_generated_values_as_in_the_kernel(spark):
    draw = random.Random(7)

    def value(depth):
        kind = draw.randrange(9 if depth else 5)
        if kind < 3:
            return draw.choice([None, True, False, 0, 1.5, -3, "", "a \"b\" {[", "ü,:"])
        if kind < 5:
            return variable(*draw.choice([("a",), ("a", "z", 0), ("list", 2), ("none",), ("c",), ("s",), ("false",)]))
        if kind == 5:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        if kind == 6:
            return {k: value(depth - 1) for k in draw.sample(["x", "y", "0", "ä\\n"], draw.randrange(4))}
        return function(draw.choice([*BUILTIN, "gone"]), *(value(depth - 1) for _ in range(draw.randrange(1, 4))))

    values = [value(4) for _ in range(300)]
    want = [encode(resolve(decode(json.dumps(v)), scope(CONFIG, SCOPE))) for v in values]
    assert resolved(spark, values, SCOPE, CONFIG) == want


def test_configurations_with_code_use_the_kernel(spark):
    assert is_native(Config()) and is_native(CONFIG)
    assert not is_native(Config(functions=BUILTIN | {"twice": Function(lambda p, _: p["0"] * 2)}))
    assert not is_native(Config(functions={})) and not is_native(Config(variables=decode('{"a":{"$$mdtype":"Variable","path":["b"]}}')))
    twice = Config.of(functions={"twice": Function(lambda p, _: p["0"] * 2)})
    row = spark.range(1).select(resolve_column(spark, F.lit(json.dumps(function("twice", 4))), twice).alias("got")).first()
    assert row["got"] == "8"


#: Shapes that the grammar does not write go by the fold.
ODD = [{"$$mdtype": "Variable"}, [{"$$mdtype": "Function", "parameters": {}, "name": "and"}]]


@pytest.mark.parametrize("k", [1, 11, 18, 20, 35, 39, 46, 49, 50, 51, -1, -2])
def test_known_values_as_columns_of_values(spark, k):
    value = [*CASES, *ODD][k]
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    rows = spark.createDataFrame([(own,) for own in (SCOPE, None, "{}", "no json")], "own string").repartition(1)
    known = rows.select("own", resolve_constant(spark, text, CONFIG, F.col("own")).alias("known"))
    folded = rows.select("own", resolve_column(spark, F.lit(text), CONFIG, F.col("own")).alias("known"))
    assert sorted(map(str, known.collect())) == sorted(map(str, folded.collect()))


def test_known_values_are_not_folded_in_each_row(spark):
    rows = spark.range(1).select(F.lit(SCOPE).alias("own"))
    text = json.dumps(function("not", variable("a")))
    known = rows.select(resolve_constant(spark, text, CONFIG, F.col("own")))
    assert "aggregate(" not in known._jdf.queryExecution().analyzed().toString()
