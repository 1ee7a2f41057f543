"""Aggregates of every column of both sides, in exact decimal arithmetic, one pass a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.canonical import SECOND
from tallyframe.operators.pair import TablePair, side_by_side

METRICS = ("count", "min", "max", "distinct_count", "sum", "avg")


def scale_of(kind: T.DataType, float_scale: int = 6) -> int:
    """Decimals that values of a type are compared at."""
    if isinstance(kind, T.DecimalType):
        return kind.scale
    return float_scale if isinstance(kind, (T.FloatType, T.DoubleType)) else 0


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def metric_text(kind: T.DataType, c: Column, scale: int) -> Column:
    """A value as text at the column's scale; times to the microsecond, so nothing that differs looks equal. NaN, infinities and numbers that
    38 digits don't hold keep their own text."""
    if numeric(kind):
        exact = F.round(c.try_cast(f"decimal(38,{scale})"), scale).cast("string")
        return F.coalesce(exact, c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, f"{SECOND}.SSSSSS")
    return c.cast("string")


def exact_sum(kind: T.DataType, c: Column, scale: int) -> list[tuple[str, Column]]:
    """Aggregates from which total_text makes the sum: exact of what 38 digits hold, the float sum of infinities and NaNs, and how many values are neither."""
    exact = c.try_cast(f"decimal(38,{scale})") if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else c.cast("decimal(20,0)")
    out = [("sum", F.try_sum(exact))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        endless = F.isnan(c) | (F.abs(c) == float("inf"))
        out += [("odd", F.sum(F.when(endless, c.cast("double")))), ("wide", F.count_if(c.isNotNull() & exact.isNull() & ~endless))]
    elif isinstance(kind, T.DecimalType):
        out += [("wide", F.count_if(c.isNotNull() & exact.isNull()))]
    return out


def total_text(names: list[str], k: int, scale: int) -> Column:
    """The sum as text: at the column's scale, NaN or an infinity if there are any, null where 38 digits don't hold it."""
    total = F.col(f"__sum{k}").try_cast(f"decimal(38,{scale})").cast("string")
    if "wide" in names:
        total = F.when(F.col(f"__wide{k}") == 0, total)
    return F.coalesce(F.col(f"__odd{k}").cast("string"), total) if "odd" in names else total


def average_text(names: list[str], k: int, scale: int) -> Column:
    """The sum over the count, with more digits than are kept while they fit, then rounded as the column is."""
    total, n = F.col(f"__sum{k}"), F.col(f"__n{k}")
    ratio = F.try_divide(total.try_cast(f"decimal(38,{scale})"), n.cast("decimal(20,0)"))
    average = F.round(ratio, scale).try_cast(f"decimal(38,{scale})").cast("string")
    if scale <= 26:
        fine = F.try_divide(total.try_cast(f"decimal(26,{scale})"), n.try_cast("decimal(12,0)"))
        average = F.coalesce(F.round(fine, scale).try_cast(f"decimal(38,{scale})").cast("string"), average)
    if "wide" in names:
        average = F.when(F.col(f"__wide{k}") == 0, average)
    return F.coalesce(F.col(f"__odd{k}").cast("string"), average) if "odd" in names else average


def two_passes(df: DataFrame, plain: list[Column], distinct: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates and counts of distinct values side by side. Together in one aggregation, every row would be copied for every distinct
    count with all other aggregates' state; apart, the copies hold one value each."""
    one, two = ((df.groupBy(*by) if by else df.groupBy()).agg(*a) for a in (plain, distinct))
    if not by:
        return one.withColumn("__one", F.lit(1)).join(two.withColumn("__one", F.lit(1)), "__one").drop("__one")
    two = two.withColumnsRenamed({b: f"__by_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    return one.join(two, on).drop(*[f"__by_{b}" for b in by])


def column_aggregates(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), float_scale: int = 6, approximate: bool = False, scales: dict[str, int] | None = None) -> DataFrame:
    """by..., column_name and the METRICS as text, a row for each column; scales are of columns that are compared at another scale than their own.

    Counts of distinct values are exact unless approximate is asked for. Sums and averages of any NaN or infinity are one; those that
    38 digits don't hold, or of numbers that they don't hold, are null.
    """
    aggregates, distincts, structs = [F.count(F.lit(1)).alias("__count")], [], []
    for k, name in enumerate(columns):
        kind, c = df.schema[name].dataType, F.col(name)
        scale = (scales or {}).get(name, scale_of(kind, float_scale))
        distinct = F.approx_count_distinct(c) if approximate else F.countDistinct(c)
        aggregates += [F.min(c).alias(f"__min{k}"), F.max(c).alias(f"__max{k}")]
        distincts.append(distinct.alias(f"__distinct{k}"))
        total = average = F.lit(None).cast("string")
        if numeric(kind):
            sums = exact_sum(kind, c, scale)
            aggregates += [*[a.alias(f"__{n}{k}") for n, a in sums], F.count(c).alias(f"__n{k}")]
            names = [n for n, _ in sums]
            total, average = total_text(names, k, scale), average_text(names, k, scale)
        structs.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.col("__count").cast("string").alias("count"),
                metric_text(kind, F.col(f"__min{k}"), scale).alias("min"),
                metric_text(kind, F.col(f"__max{k}"), scale).alias("max"),
                F.col(f"__distinct{k}").cast("string").alias("distinct_count"),
                total.alias("sum"),
                average.alias("avg"),
            )
        )
    wide = two_passes(df, aggregates, distincts, by)
    return wide.select(*by, F.explode(F.array(*structs)).alias("s")).select(*by, "s.*")


def long_form(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., column_name, metric, value."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return stats.select(*by, "column_name", F.explode(pairs).alias("m")).select(*by, "column_name", "m.metric", "m.value")


def compare_aggregates(pair: TablePair, columns: list[str] | None = None, by: tuple[str, ...] = (), float_scale: int = 6, tolerance: dict[str, str] | None = None) -> DataFrame:
    """by..., column_name, metric, source_value, target_value, match.

    A metric matches if both sides have the same value at the column's scale (both null: the same). With a
    tolerance for a column, its sum and average match if they differ by no more.
    """
    columns = columns or [*pair.keys, *pair.values]
    keys = [*by, "column_name", "metric"]
    # numbers are compared at the source's scale
    kinds = {c: (pair.source.schema[c].dataType, pair.target.schema[c].dataType) for c in columns}
    scales = {c: scale_of(ks, float_scale) for c, (ks, kt) in kinds.items() if numeric(ks) and numeric(kt) and ks != kt}
    s, t = (long_form(column_aggregates(d, columns, by, float_scale, scales=scales), by) for d in (pair.source, pair.target))
    both = side_by_side(s, t, keys, ["value"])
    same = F.col("source_value").eqNullSafe(F.col("target_value"))
    for name, most in (tolerance or {}).items():
        number = lambda side: F.col(f"{side}_value").try_cast("decimal(38,10)")
        close = F.abs(F.try_subtract(number("source"), number("target"))) <= F.lit(most).cast("decimal(38,10)")
        same = same | ((F.lower("column_name") == name.lower()) & F.col("metric").isin("sum", "avg") & F.coalesce(close, F.lit(False)))
    return both.withColumn("match", same)


def verdict(compared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., total_columns, matched_columns, match."""
    columns = compared.groupBy(*by, "column_name").agg(F.bool_and("match").alias("ok"))
    out = [F.count(F.lit(1)).alias("total_columns"), F.count_if("ok").alias("matched_columns"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("match")]
    return columns.groupBy(*by).agg(*out) if by else columns.agg(*out)


def row_counts(pair: TablePair) -> DataFrame:
    """source_rows, target_rows, match."""
    s, t = (d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((pair.source, "source_rows"), (pair.target, "target_rows")))
    one = F.lit(1)
    both = s.withColumn("one", one).join(t.withColumn("one", one), "one")
    return both.select("source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("match"))
