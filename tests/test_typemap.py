import pytest
from pyspark.sql import types as T

from tallyframe.functions.typemap import dictionary_type, number_type, spark_type, target_type
from tallyframe.plans.registry import _NUMBER_TYPES, _TYPES


@pytest.mark.parametrize("row", _TYPES)
def test_target_type(row):
    assert target_type(*row[:4]) == row[4]


@pytest.mark.parametrize("p, s, d, t", _NUMBER_TYPES)
def test_number_type(p, s, d, t):
    assert number_type(p, s, d) == t


@pytest.mark.parametrize("name, kind", [("NUMERIC(15,5)", T.DecimalType(15, 5)), ("NUMERIC", T.DecimalType(38, 10)), ("BIGINT", T.LongType()), ("TIMESTAMP WITH TIME ZONE", T.TimestampType()), ("VARCHAR(3)", T.StringType()), ("BYTEA", T.BinaryType())])
def test_spark_type(name, kind):
    assert spark_type(name) == kind


def test_dictionary_type_round_trip():
    for kind, name in ((T.LongType(), "NUMERIC(19)"), (T.DecimalType(9, 2), "NUMERIC(9,2)"), (T.DateType(), "TIMESTAMP"), (T.BinaryType(), "BYTEA"), (T.StringType(), "TEXT")):
        assert target_type(*dictionary_type(kind)) == name
