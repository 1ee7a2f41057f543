from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ddl, profile, recommend
from tallyframe.operators.pair import TablePair


def pair(spark, kind, values, target=None):
    make = lambda v: spark.createDataFrame([(k, x) for k, x in enumerate(v)], f"k long, c {kind}")
    return TablePair(make(values), make(values if target is None else target), ("k",))


def kind_of(spark, kind, values, **options):
    return recommend.recommend(pair(spark, kind, values), ["c"], **options).first().recommended_type


@pytest.mark.parametrize(
    "values, kind",
    [([0, 32767], "SMALLINT"), ([0, 32768], "INTEGER"), ([-32769, 0], "INTEGER"), ([2147483648], "BIGINT"), ([0], "SMALLINT"), ([20240228, 19000101], "DATE"), ([20240230], "INTEGER"), ([99991232], "INTEGER"), ([None], "NUMERIC")],
)
def test_whole_numbers(spark, values, kind):
    assert kind_of(spark, "long", values) == kind


def test_beyond_bigint_and_fractions(spark):
    assert kind_of(spark, "decimal(38,0)", [Decimal("9223372036854775808")]) == "NUMERIC"
    assert kind_of(spark, "decimal(38,0)", [Decimal("9223372036854775807")]) == "BIGINT"
    assert kind_of(spark, "decimal(10,2)", [Decimal("1.50")]) == "NUMERIC"
    assert kind_of(spark, "decimal(10,2)", [Decimal("1.00")]) == "SMALLINT"


def test_dates(spark):
    d = spark.createDataFrame([("2026-01-11 00:00:00",), ("2026-01-12 00:00:00",)], "t string").select(F.to_timestamp_ntz("t").alias("c"))
    assert recommend.recommend(TablePair(d, d), ["c"]).first().recommended_type == "DATE"
    d = d.unionByName(spark.createDataFrame([("2026-01-11 01:43:14",)], "t string").select(F.to_timestamp_ntz("t").alias("c")))
    assert recommend.recommend(TablePair(d, d), ["c"]).first().recommended_type == "TIMESTAMP"


def test_candidates_have_reasons(spark):
    fine = recommend.candidates(pair(spark, "decimal(18,0)", [Decimal(1), Decimal(2)]), "s", "t", None, ["c"]).first()
    assert fine.can_downcast and fine.target_type == "SMALLINT" and fine.ddl == 'ALTER TABLE "s"."t" ALTER COLUMN "c" TYPE SMALLINT USING "c"::smallint;'
    assert fine.reasons == list(recommend.EVIDENCE)
    key = recommend.candidates(pair(spark, "decimal(18,0)", [Decimal(1)]), "s", "t", None, ["c"], recommend.Keys(fk=("C",))).first()
    assert key.can_downcast and key.target_type == "BIGINT" and recommend.KEY_STAYS in key.reasons
    broken = recommend.candidates(pair(spark, "decimal(18,2)", [Decimal("1.5")], [Decimal("2.5")]), "s", "t", None, ["c"]).first()
    assert not broken.can_downcast and broken.ddl is None
    assert broken.reasons == [recommend.HAS_FRACTION, recommend.TOLERANCE, recommend.SUM, recommend.CAST_LOSS]


def test_cast_loss_and_range(spark):
    d = spark.createDataFrame([("3.5",), ("32767.6",), ("70000",), ("12",), (None,)], "c string").select(F.col("c").cast("decimal(18,2)").alias("c"))
    assert profile.count_cast_loss(d, ["c"], "SMALLINT").first().cast_loss_rows == 3
    assert profile.count_out_of_range(TablePair(d, d), ["c"], "SMALLINT").first().out_of_range_rows == 4
    assert profile.count_out_of_range(TablePair(d, d), ["c"], "BIGINT").first().out_of_range_rows == 0


def test_spark_table_keeps_its_key(spark):
    d = spark.createDataFrame([(1, "a")], "k long, v string")
    columns = ddl.dictionary(d, "s", "t")
    schema = ddl.spark_schema(columns, ("k",))
    ddl.create_spark_table(spark, "made_here", schema, ("k",), drop=True)
    properties = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES made_here").collect()}
    assert properties["primary_key"] == "k"
    spark.sql("DROP TABLE made_here")
    with pytest.raises(ValueError):
        recommend.alter_ddl(TablePair(d, d), "s", "t", dialect="none")
