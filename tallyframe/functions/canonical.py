"""Canonical text of values: equal text on both sides exactly where the values count as equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the canonical form.
NULL, EMPTY, SEPARATOR = "<NULL>", "<EMPTY>", "|"
SECOND = "yyyy-MM-dd'T'HH:mm:ss"
LOB_PREFIX = 100
UNSCALED = T.DecimalType(38, 10)


def unscaled_number(c: Column) -> Column:
    """A number without a declared scale: up to 10 decimals, no zeros at the end, no exponent."""
    text = c.cast(UNSCALED).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def floating(c: Column) -> Column:
    """As unscaled_number; what no decimal holds keeps its own text."""
    exact = c.try_cast(UNSCALED)
    endless = F.when(c > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))
    odd = F.when(F.isnan(c), F.lit("NaN")).when(F.abs(c) == F.lit(float("inf")), endless)
    return odd.when(exact.isNull(), c.cast("string")).otherwise(unscaled_number(exact))


def lob_text(c: Column, prefix: int = LOB_PREFIX) -> Column:
    return F.concat(F.lit("LEN:"), F.length(c).cast("string"), F.lit(":"), F.substring(c, 1, prefix))


def lob_bytes(c: Column, prefix: int = LOB_PREFIX) -> Column:
    return F.concat(F.lit("LEN:"), F.octet_length(c).cast("string"), F.lit(":"), F.substring(F.lower(F.hex(c)), 1, prefix))


def value_text(kind: T.DataType, c: Column, lob: bool = False, prefix: int = LOB_PREFIX) -> Column:
    """Text of a value that is not null; null stays null."""
    if isinstance(kind, T.BinaryType):
        return lob_bytes(c, prefix)
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return lob_text(c, prefix) if lob else F.trim(c)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, SECOND)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return floating(c)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(value_text(kind.elementType, x), F.lit(NULL))), ","), F.lit("]"))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(c)
    return F.trim(c.cast("string"))


def with_policy(text: Column, policy: str) -> Column:
    """Nulls and empty text as the policy has them: apart, or both as one or the other."""
    marked = F.when(text == "", F.lit(NULL if policy == "empty_as_null" else EMPTY)).otherwise(text)
    return F.coalesce(marked, F.lit(EMPTY if policy == "null_as_empty" else NULL))


def canonical(field: T.StructField, c: Column, policy: str = "distinct", lob: bool | None = None, prefix: int = LOB_PREFIX) -> Column:
    lob = bool(field.metadata.get("lob")) if lob is None else lob
    if lob and isinstance(field.dataType, T.StringType):  # an empty text is marked before its length is
        return with_policy(F.when(c == "", F.lit("")).otherwise(lob_text(c, prefix)), policy)
    return with_policy(value_text(field.dataType, c, lob, prefix), policy)


def fixed_width(c: Column, width: int, fill: str = " ") -> Column:
    """A canonical text at a fixed width, filled at the end and cut if it is longer."""
    return F.rpad(c, width, fill)


def row_text(schema: T.StructType, columns: list[str], policy: str = "distinct", lobs=(), strict: bool = False, prefix: int = LOB_PREFIX) -> Column:
    """Canonical texts of the columns in a row; strict puts each text's length before it, so no two rows share a text."""
    by_name = {f.name.lower(): f for f in schema.fields}
    parts = [canonical(by_name[c.lower()], F.col(c), policy, c.lower() in lobs or None, prefix) for c in columns]
    if strict:
        parts = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.concat_ws(SEPARATOR, *parts)


def canonical_columns(schema: T.StructType, columns: list[str] | None = None, policy: str = "distinct") -> list[Column]:
    """The canonical text of each column under its own name: a select list made from a schema."""
    wanted = {c.lower() for c in columns} if columns else None
    return [canonical(f, F.col(f.name), policy).alias(f.name) for f in schema.fields if wanted is None or f.name.lower() in wanted]
