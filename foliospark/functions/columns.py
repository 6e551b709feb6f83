"""The document language's scalar functions as Catalyst expressions over JSON text.

SQL NULL is undefined and the text `null` is null, so `default` is a coalesce and truth is a
comparison.  All of them stay inside code generation; nothing here calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers below this print as they are stored.
_EXACT = 1e15


def truthy(value: Column) -> Column:
    """False for undefined, null and false only."""
    return value.isNotNull() & ~F.coalesce(value.isin("null", "false"), F.lit(False))


def md_and(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & truthy(v)
    return out


def md_or(*values: Column) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | truthy(v)
    return out


def md_not(value: Column) -> Column:
    return ~truthy(value)


def canonical(value: Column) -> Column:
    """JSON text with sorted keys and one spelling a number: equal text is equal value."""
    return F.to_json(F.try_parse_json(value))


def md_equals(first: Column, *others: Column) -> Column:
    """Deep equality with the first value; undefined equals only undefined, null only null."""
    out = F.lit(True)
    for v in others:
        same = F.when(first.isNull() | v.isNull(), first.isNull() & v.isNull()).when((first == "null") | (v == "null"), first == v)
        out = out & same.otherwise(F.coalesce(canonical(first).eqNullSafe(canonical(v)), F.lit(False)))
    return out


def md_default(value: Column, fallback: Column) -> Column:
    return F.coalesce(value, fallback)


def escape_html(text: Column) -> Column:
    """Ampersand first, then the two brackets and the double quote; nothing else."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def whole_number_text(x: Column) -> Column:
    """The host spelling of a number where it is whole and below 1e15; null elsewhere (a kernel's case)."""
    return F.when((x == F.floor(x)) & (F.abs(x) < _EXACT), x.cast("bigint").cast("string"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def unsafe_link(url: Column) -> Column:
    """Whether a destination runs code or reads files, whatever its case and hidden characters."""
    plain = F.lower(F.regexp_replace(url, r"[\x00-\x20\x7f-\x9f]", ""))
    return plain.rlike("^(javascript|vbscript|file|data):") & ~plain.rlike("^data:image/(gif|png|jpeg|webp);")


def html_attribute(attr: Column) -> Column:
    """` name="text"` of one attribute row of the renderable table; names in lower case."""
    return F.concat(F.lit(" "), F.lower(attr["name"]), F.lit('="'), escape_html(attr["text"]), F.lit('"'))


#: What a document may not hold to be plain prose: marks of inline Markdown, tags and entities, white space that is not a
#: space or line end, blanks at the edges of a line, and first characters that can open a block.
_NOT_PLAIN = r"[*_`\[\]<~{\\&|\x00-\x09\x0B-\x1F\x7F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]|(?:^|\n)[ #>+\-0-9]| (?:\n|\z)"


def is_plain(source: Column) -> Column:
    """Whether a document is paragraphs of plain prose, which need no parser."""
    return ~source.rlike(_NOT_PLAIN)


def plain_html(source: Column) -> Column:
    """The HTML of a document of plain prose: paragraphs at blank lines, line ends as spaces."""
    paragraphs = F.filter(F.split(F.btrim(source, F.lit("\n")), "\n\n+"), lambda p: p != "")
    body = F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), escape_html(F.replace(p, F.lit("\n"), F.lit(" "))), F.lit("</p>")))
    return F.concat(F.lit("<article>"), F.array_join(body, ""), F.lit("</article>"))
