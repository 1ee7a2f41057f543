"""The type map from the source dialect to the target's and to Spark's."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types that keep a length, and types with one counterpart.
TEXT = ("CLOB", "NCLOB", "LONG")
BYTES = ("BLOB", "RAW", "LONG RAW")
VARYING = ("VARCHAR2", "NVARCHAR2")
FIXED = ("CHAR", "NCHAR")
SINGLE = {
    "XMLTYPE": "XML",
    "BINARY_FLOAT": "REAL",
    "BINARY_DOUBLE": "DOUBLE PRECISION",
    "DATE": "TIMESTAMP",
    "ROWID": "CHAR(18)",
    "UROWID": "VARCHAR(4000)",
    "SDO_GEOMETRY": "GEOMETRY(GEOMETRY,4326)",
}
#: The largest precision of a whole number that each type holds.
WHOLE = (("SMALLINT", 4), ("INTEGER", 9), ("BIGINT", 18))
#: The range of each whole type.
RANGES = {
    "SMALLINT": (-32768, 32767),
    "INTEGER": (-2147483648, 2147483647),
    "BIGINT": (-9223372036854775808, 9223372036854775807),
}


def number_type(precision: int | None, scale: int | None, has_decimal: bool = False) -> str:
    """The target type of a NUMBER; fractions in the data rule out a whole type."""
    if precision is None:
        return "NUMERIC"
    scale = scale or 0
    if scale > 0:
        return f"NUMERIC({precision},{scale})"
    if scale < 0:
        return "NUMERIC"
    if has_decimal:
        return f"NUMERIC({precision})"
    return next((name for name, most in WHOLE if precision <= most), f"NUMERIC({precision})")


def target_type(kind: str, length: int | None = None, precision: int | None = None, scale: int | None = None) -> str:
    """The target type of a source type."""
    kind = " ".join(kind.upper().split())
    base = kind.partition("(")[0].strip()
    if base in TEXT:
        return "TEXT"
    if base in BYTES:
        return "BYTEA"
    if base in VARYING or base in FIXED:
        name = "VARCHAR" if base in VARYING else "CHAR"
        return f"{name}({length})" if length else name
    if base == "NUMBER":
        return number_type(precision, scale)
    if base.startswith("TIMESTAMP"):
        return "TIMESTAMP WITH TIME ZONE" if "TIME ZONE" in kind else "TIMESTAMP"
    if base.startswith("FLOAT"):
        return "DOUBLE PRECISION"
    if base.startswith("INTERVAL"):
        return "INTERVAL"
    return SINGLE.get(base, "TEXT")


def spark_type(target: str) -> T.DataType:
    """The Spark type that holds a target type."""
    import re

    name, _, rest = target.upper().partition("(")
    numbers = [int(x) for x in re.findall(r"-?\d+", rest)]
    name = name.strip()
    if name == "NUMERIC":
        return T.DecimalType(*(numbers + [0])[:2]) if numbers and numbers[0] <= 38 else T.DecimalType(38, 10)
    plain = {
        "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "REAL": T.FloatType(), "DOUBLE PRECISION": T.DoubleType(),
        "BYTEA": T.BinaryType(), "GEOMETRY": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "INTERVAL": T.DayTimeIntervalType(),
    }
    return plain.get(name, T.StringType())


def dictionary_type(kind: T.DataType) -> tuple[str, int | None, int | None, int | None]:
    """Source type, length, precision and scale as a dictionary would list a Spark type."""
    if isinstance(kind, T.DecimalType):
        return "NUMBER", None, kind.precision, kind.scale
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    if type(kind) in whole:
        return "NUMBER", None, whole[type(kind)], 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "NUMBER", None, None, None
    if isinstance(kind, T.DateType):
        return "DATE", None, None, None
    if isinstance(kind, T.TimestampNTZType):
        return "TIMESTAMP(6)", None, None, None
    if isinstance(kind, T.TimestampType):
        return "TIMESTAMP(6) WITH TIME ZONE", None, None, None
    if isinstance(kind, (T.VarcharType, T.CharType)):
        return ("VARCHAR2" if isinstance(kind, T.VarcharType) else "CHAR"), kind.length, None, None
    if isinstance(kind, T.BinaryType):
        return "BLOB", None, None, None
    return "CLOB", None, None, None


def current_type(kind: T.DataType) -> str:
    """How a target that was filled from such a column declares it."""
    if isinstance(kind, T.DecimalType):
        return f"NUMERIC({kind.precision},{kind.scale})"
    names = {T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "NUMERIC", T.DoubleType: "NUMERIC", T.DateType: "DATE", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BYTEA", T.BooleanType: "BOOLEAN"}
    return names.get(type(kind), "TEXT")
