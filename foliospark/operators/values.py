"""Values and tag bodies as vectorised columns: parse, resolve, debug, spell, encode.

Every function maps null to null (undefined in, undefined out).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.document import BUILTIN, debug_text
from foliospark.functions.links import SETTLED, normalize_link
from foliospark.functions.numbers import js_number, plain_number
from foliospark.functions.resolving import NATIVE, resolve_known, resolve_text
from foliospark.kernel.format import scalar_text
from foliospark.kernel.grammar import TagError, find_tag_end, parse_tag, parse_value
from foliospark.kernel.resolve import has_reference, resolve
from foliospark.kernel.schema import Config
from foliospark.kernel.values import UNDEFINED, decode, encode
from foliospark.operators.kernels import Shared, scope

TAG = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("attributes", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "value")]))),
        T.StructField("self_closing", T.BooleanType()),
        T.StructField("value", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)


def _vectorised(kind: T.DataType, fn):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else fn(v) for v in values], dtype=object)

    return run


def tag_fields(body: str) -> dict:
    """One tag body: its item, or the message and place of the failure."""
    empty = dict.fromkeys(("kind", "name", "attributes", "self_closing", "value", "error", "start", "end"))
    try:
        item = parse_tag(body.strip())
    except TagError as e:
        return empty | {"error": e.message, "start": e.start, "end": e.end}
    return empty | {
        "kind": item.kind,
        "name": item.name or None,
        "attributes": [{"kind": a.kind, "name": a.name, "value": encode(a.value)} for a in item.attributes],
        "self_closing": item.self_closing,
        "value": None if item.value is None else encode(item.value),
    }


@F.pandas_udf(TAG)
def parse_tag_column(bodies: pd.Series) -> pd.DataFrame:
    """kind, name, attributes, self_closing, value, or error, start and end of each body."""
    rows = [dict.fromkeys(TAG.names) if b is None else tag_fields(b) for b in bodies]
    return pd.DataFrame(rows, columns=TAG.names)


def _value_text(text: str) -> str | None:
    try:
        return encode(parse_value(text))
    except TagError:
        return None


def _tag_end(text: str) -> int | None:
    at = text.find("{%")
    return None if at < 0 else find_tag_end(text, at)


#: JSON text of a written value; null where it does not parse.
parse_value_column = _vectorised(T.StringType(), _value_text)
#: Offset of the `%}` that closes the first tag of a text.
tag_end_column = _vectorised(T.IntegerType(), _tag_end)
#: A destination as it is rendered.
normalize_link_udf = _vectorised(T.StringType(), normalize_link)
#: A number in the host language's spelling, and without an exponent.
js_number_udf = _vectorised(T.StringType(), lambda x: js_number(float(x)))
plain_number_column = _vectorised(T.StringType(), lambda x: plain_number(float(x)))
#: Indented JSON of a value, references as null.
debug_column = _vectorised(T.StringType(), lambda t: debug_text(decode(t)))
#: A value as source.
format_value_column = _vectorised(T.StringType(), lambda t: scalar_text(decode(t)))


def is_native(config: Config) -> bool:
    """Whether values resolve without Python: the built-in functions as they are, no others that have code, plain variables."""
    own = [f for n, f in config.functions.items() if f is not BUILTIN.get(n)]
    built_in = all(config.functions.get(n) is BUILTIN[n] for n in NATIVE)
    return built_in and all(f.transform is None for f in own) and not has_reference(config.variables)


def _scopes(config: Config, variables: Column | None) -> list[Column]:
    """The texts of objects in which paths are looked up, a row's own first."""
    own = [] if variables is None else [variables]
    return own if config.variables is None else [*own, F.lit(encode(config.variables))]


def resolve_constant(spark: SparkSession, value: str, config: Config | None = None, variables: Column | None = None) -> Column:
    """`resolve_column` of one value, given as JSON text, for all rows: in the JVM it is read when the plan is built and not in each row."""
    config = config or Config()
    if '"$$mdtype"' in value and is_native(config):
        return resolve_known(value, _scopes(config, variables))
    return resolve_column(spark, F.lit(value), config, variables)


def resolve_column(spark: SparkSession, value: Column, config: Config | None = None, variables: Column | None = None) -> Column:
    """JSON text of a value with its variables and functions evaluated; plain values are not touched.

    All stays in the JVM where every function of the configuration has an expression there (`resolving.NATIVE`) and
    its variables hold no references; other configurations use the kernel.  A row's variables are data: what looks
    like a reference in them stays as it is on the first way.
    """
    config = config or Config()
    refers = F.contains(value, F.lit('"$$mdtype"'))
    if is_native(config):
        return F.when(refers, resolve_text(F.when(refers, value), _scopes(config, variables))).otherwise(value)
    shared = Shared(spark, config)

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series, own: pd.Series) -> pd.Series:
        config = shared.get()
        out = []
        for text, variables in zip(values, own, strict=True):
            got = UNDEFINED if text is None else resolve(decode(text), scope(config, variables))
            out.append(encode(got))
        return pd.Series(out, dtype=object)

    own = F.lit(None).cast("string") if variables is None else variables
    return F.when(refers, run(F.when(refers, value), own)).otherwise(value)


#: Whole numbers below this are exact as doubles and as longs.
_WHOLE = float(1 << 53)


def normalize_link_column(url: Column | str) -> Column:
    """Destinations as browsers receive them; those that stay as they are never leave the JVM."""
    url = F.col(url) if isinstance(url, str) else url
    settled = url.rlike(SETTLED)
    return F.when(settled, url).otherwise(normalize_link_udf(F.when(~settled, url)))


def js_number_column(number: Column | str) -> Column:
    """ECMAScript's spelling of numbers; whole ones never leave the JVM."""
    value = (F.col(number) if isinstance(number, str) else number).cast("double")
    whole = (F.abs(value) < _WHOLE) & (F.floor(value) == value)
    return F.when(F.isnan(value), "NaN").when(whole, value.cast("long").cast("string")).otherwise(js_number_udf(F.when(~whole, value)))
