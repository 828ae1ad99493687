"""Query notation as column expressions.

``terms`` is ``ARRAY<ARRAY<STRUCT<kind, val>>>``: one inner array per term with
one entry per attribute.  ``kind`` is ``val`` (fixed value), ``var`` (variable,
``val`` is its name without ``$x``) or ``any`` (open place, ``val`` NULL).

Text form: terms are separated by a blank, every attribute ends with ``;``.
Blank, semicolon and percent sign inside a value, and a dollar sign, are
written as percent codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS_TYPE = "array<array<struct<kind:string,val:string>>>"

# Characters of a value that the text form reserves.
RESERVED = [("%", "%25"), (" ", "%20"), (";", "%3B"), ("$", "%24")]


def encode_value(col: Column) -> Column:
    for raw, code in RESERVED:
        col = F.replace(col, F.lit(raw), F.lit(code))
    return col


def decode_value(col: Column) -> Column:
    for raw, code in reversed(RESERVED):
        col = F.replace(col, F.lit(code), F.lit(raw))
    return col


def symbol(kind: str, val: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), val.cast("string").alias("val"))


def any_symbol() -> Column:
    return symbol("any", F.lit(None))


def _parse_symbol(text: Column) -> Column:
    return (
        F.when(text == "", any_symbol())
        .when(F.startswith(text, F.lit("$x")), symbol("var", F.substring(text, 3, 1_000_000)))
        .otherwise(symbol("val", decode_value(text)))
    )


def _parse_term(text: Column) -> Column:
    parts = F.split(text, ";", -1)
    ended = F.endswith(text, F.lit(";"))
    parts = F.when(ended, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, _parse_symbol)


def parse_terms(qstr: Column) -> Column:
    """Text form to ``terms``."""
    pieces = F.filter(F.split(F.trim(qstr), " +"), lambda t: t != "")
    return F.transform(pieces, _parse_term).cast(TERMS_TYPE)


def _format_symbol(s: Column) -> Column:
    return (
        F.when(s["kind"] == "any", F.lit(";"))
        .when(s["kind"] == "var", F.concat(F.lit("$x"), s["val"], F.lit(";")))
        .otherwise(F.concat(encode_value(s["val"]), F.lit(";")))
    )


def format_terms(terms: Column) -> Column:
    """``terms`` to text form."""
    return F.array_join(
        F.transform(terms, lambda t: F.array_join(F.transform(t, _format_symbol), "")), " "
    )


def variables(terms: Column) -> Column:
    """All variable names in order of occurrence, with repetitions."""
    symbols = F.filter(F.flatten(terms), lambda s: s["kind"] == "var")
    return F.transform(symbols, lambda s: s["val"])


def values(terms: Column) -> Column:
    """All fixed values in order of occurrence, with repetitions."""
    symbols = F.filter(F.flatten(terms), lambda s: s["kind"] == "val")
    return F.transform(symbols, lambda s: s["val"])


def query_kind(terms: Column) -> Column:
    """``type``, ``pattern``, ``mixed`` or ``empty``."""
    n_val, n_var = F.size(values(terms)), F.size(variables(terms))
    return (
        F.when((n_val > 0) & (n_var > 0), "mixed")
        .when(n_val > 0, "type")
        .when(n_var > 0, "pattern")
        .otherwise("empty")
    )
