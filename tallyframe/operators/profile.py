"""Profiles of columns: what values they hold and what a narrower type would lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.typemap import RANGES
from tallyframe.operators.aggregates import exact_sum, metric_text, numeric, scale_of, total_text, two_passes
from tallyframe.operators.pair import TablePair

WIDE = "decimal(38,10)"
#: The least and the largest eight-digit date.
DAY_WINDOW = (19000101, 99991231)


def _exact(c: Column, kind: T.DataType | None) -> Column:
    """A number as it is compared exactly: as it is, if its type is exact, else as a wide decimal."""
    return c if isinstance(kind, (T.IntegralType, T.DecimalType)) else c.try_cast(WIDE)


def fraction(c: Column, kind: T.DataType | None = None) -> Column:
    """Whether a number has a fraction."""
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale <= 0:
        return F.lit(False)
    exact = _exact(c, kind)
    return exact.isNotNull() & (exact % 1 != 0)


def out_of_range(c: Column, target: str, kind: T.DataType | None = None) -> Column:
    """Whether a number is beyond the range of a whole type (null: no)."""
    lo, hi = RANGES[target]
    return F.coalesce(~_exact(c, kind).between(F.lit(lo).cast("decimal(20,0)"), F.lit(hi).cast("decimal(20,0)")), F.lit(False))


def cast_loss(c: Column, target: str, kind: T.DataType | None = None) -> Column:
    """Whether a cast to a whole type, which rounds, changes the number or fails."""
    lo, hi = RANGES[target]
    exact = _exact(c, kind)
    within = exact.between(F.lit(lo).cast("decimal(20,0)"), F.lit(hi).cast("decimal(20,0)"))
    return c.isNotNull() & (fraction(c, kind) | ~F.coalesce(within, F.lit(False)))


def timed(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(c, "HH:mm:ss") != "00:00:00", F.lit(False))
    return F.lit(None).cast("boolean")


def eight_digit_day(kind: T.DataType, c: Column, strict: bool = True) -> Column:
    """Whether a whole number reads as a date yyyyMMdd; strict asks for a date that exists."""
    if not numeric(kind):
        return F.lit(False)
    whole = _exact(c, kind)
    inside = whole.between(*[F.lit(x).cast("bigint") for x in DAY_WINDOW]) & ~fraction(c, kind)
    if strict:
        inside = inside & F.try_to_date(whole.try_cast("bigint").cast("string"), "yyyyMMdd").isNotNull()
    return F.coalesce(inside, F.lit(False))


def profile(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), float_scale: int = 6, strict_days: bool = True, narrower: bool = False, distinct: bool = True) -> DataFrame:
    """by..., column_name, row_count, null_count, distinct_count, min_value, max_value, fraction_row_count, sum_value, non_zero_time_count,
    day_count (values that read as dates), null_ratio, distinct_ratio; a row for each column. narrower adds out_<type> and loss_<type>: how many numbers are
    beyond each whole type and how many a cast to it would change, in the same pass. Without distinct, which takes a shuffle of all values, its count and ratio are null."""
    out, distincts, structs = [F.count(F.lit(1)).alias("__rows")], [], []
    for k, name in enumerate(columns):
        kind, c = df.schema[name].dataType, F.col(name)
        scale = scale_of(kind, float_scale)
        out += [F.count_if(c.isNull()).alias(f"__null{k}"), F.min(c).alias(f"__min{k}"), F.max(c).alias(f"__max{k}"), F.count_if(timed(kind, c)).alias(f"__timed{k}"), F.count_if(eight_digit_day(kind, c, strict_days)).alias(f"__day{k}")]
        if distinct:
            distincts.append(F.countDistinct(c).alias(f"__distinct{k}"))
        else:
            out.append(F.lit(None).cast("long").alias(f"__distinct{k}"))
        nothing = F.lit(None)
        if numeric(kind):
            sums = exact_sum(kind, c, scale)
            out += [F.count_if(fraction(c, kind)).alias(f"__fraction{k}"), *[a.alias(f"__{n}{k}") for n, a in sums]]
        more = []
        if narrower:
            for t in RANGES:
                tests = (("out", F.lit(False) if t == "BIGINT" else out_of_range(c, t, kind)), ("loss", cast_loss(c, t, kind))) if numeric(kind) else ()
                out += [F.count_if(test).alias(f"__{n}{t}{k}") for n, test in tests]
                more += [(F.col(f"__{n}{t}{k}") if numeric(kind) else nothing.cast("long")).alias(f"{n}_{t}") for n in ("out", "loss")]
        temporal = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
        rows = F.greatest(F.col("__rows"), F.lit(1))
        structs.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.col("__rows").alias("row_count"),
                F.col(f"__null{k}").alias("null_count"),
                F.col(f"__distinct{k}").alias("distinct_count"),
                metric_text(kind, F.col(f"__min{k}"), scale).alias("min_value"),
                metric_text(kind, F.col(f"__max{k}"), scale).alias("max_value"),
                (F.col(f"__fraction{k}") if numeric(kind) else nothing.cast("long")).alias("fraction_row_count"),
                (total_text([n for n, _ in sums], k, scale) if numeric(kind) else nothing.cast("string")).alias("sum_value"),
                (F.col(f"__timed{k}") if temporal else nothing.cast("long")).alias("non_zero_time_count"),
                F.col(f"__day{k}").alias("day_count"),
                (F.col(f"__null{k}") / rows).alias("null_ratio"),
                (F.col(f"__distinct{k}") / rows).alias("distinct_ratio"),
                *more,
            )
        )
    wide = two_passes(df, out, distincts, by) if distinct else (df.groupBy(*by) if by else df.groupBy()).agg(*out)
    return wide.select(*by, F.explode(F.array(*structs)).alias("p")).select(*by, "p.*")


def profile_pair(pair: TablePair, columns: list[str] | None = None, **options) -> DataFrame:
    """The profiles of both sides, with a column side."""
    columns = columns or [*pair.keys, *pair.values]
    s, t = (profile(d, columns, **options).withColumn("side", F.lit(side)) for d, side in ((pair.source, "source"), (pair.target, "target")))
    return s.unionByName(t)


def count_out_of_range(pair: TablePair, columns: list[str], target: str) -> DataFrame:
    """column_name, out_of_range_rows on both sides together; nothing is beyond a BIGINT."""
    return _counted(pair, columns, lambda c, kind: F.lit(False) if target == "BIGINT" else out_of_range(c, target, kind), "out_of_range_rows")


def count_cast_loss(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column_name, cast_loss_rows of one side."""
    return _counted(TablePair(df, df.limit(0)), columns, lambda c, kind: cast_loss(c, target, kind), "cast_loss_rows")


def _counted(pair: TablePair, columns: list[str], test, name: str) -> DataFrame:
    def side(d):
        wide = d.agg(*[F.count_if(test(F.col(c), d.schema[c].dataType)).alias(f"__{k}") for k, c in enumerate(columns)])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{k}").alias(name)) for k, c in enumerate(columns)])).alias("x")).select("x.*")

    return side(pair.source).unionByName(side(pair.target)).groupBy("column_name").agg(F.sum(name).alias(name))
