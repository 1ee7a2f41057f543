import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.canonical import canonical, row_text


def one(spark, kind, value, **options):
    schema = T.StructType([T.StructField("c", kind)])
    return spark.createDataFrame([(value,)], schema).select(canonical(schema["c"], F.col("c"), **options)).first()[0]


@pytest.mark.parametrize(
    "kind, value, text",
    [
        (T.StringType(), None, "<NULL>"),
        (T.StringType(), "", "<EMPTY>"),
        (T.StringType(), "  a\t", "a\t"),
        (T.StringType(), "   ", "<EMPTY>"),
        (T.DecimalType(15, 5), Decimal("50.5"), "50.50000"),
        (T.DecimalType(15, 5), Decimal("0.5"), "0.50000"),
        (T.DecimalType(10, 0), Decimal("7"), "7"),
        (T.LongType(), -3, "-3"),
        (T.DoubleType(), 500.0, "500"),
        (T.DoubleType(), 0.0, "0"),
        (T.DoubleType(), -0.5, "-0.5"),
        (T.DoubleType(), 10.25, "10.25"),
        (T.DoubleType(), 1e7, "10000000"),
        (T.DoubleType(), float("nan"), "NaN"),
        (T.DoubleType(), float("-inf"), "-Infinity"),
        (T.DoubleType(), 1e300, "1.0E300"),
        (T.TimestampNTZType(), datetime.datetime(2026, 1, 11, 1, 43, 14, 250), "2026-01-11T01:43:14"),
        (T.DateType(), datetime.date(2026, 1, 11), "2026-01-11T00:00:00"),
        (T.BinaryType(), bytearray(b"\x01\xff"), "LEN:2:01ff"),
        (T.ArrayType(T.IntegerType()), [1, None], "[1,<NULL>]"),
        (T.BooleanType(), True, "true"),
    ],
)
def test_text_of_each_type(spark, kind, value, text):
    assert one(spark, kind, value) == text


@pytest.mark.parametrize("policy, null, empty", [("distinct", "<NULL>", "<EMPTY>"), ("null_as_empty", "<EMPTY>", "<EMPTY>"), ("empty_as_null", "<NULL>", "<NULL>")])
def test_policies(spark, policy, null, empty):
    assert one(spark, T.StringType(), None, policy=policy) == null
    assert one(spark, T.StringType(), "", policy=policy) == empty


def test_large_text_has_length_and_prefix(spark):
    assert one(spark, T.StringType(), "x" * 300, lob=True) == "LEN:300:" + "x" * 100
    assert one(spark, T.StringType(), "", lob=True) == "<EMPTY>"


def test_strict_rows_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    plain = {r[0] for r in df.select(row_text(df.schema, ["x", "y"])).collect()}
    strict = {r[0] for r in df.select(row_text(df.schema, ["x", "y"], strict=True)).collect()}
    assert len(plain) == 1 and len(strict) == 2
