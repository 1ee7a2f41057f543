"""Narrower types for columns, with the evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.typemap import RANGES, current_type, dictionary_type, target_type
from tallyframe.operators import profile as P
from tallyframe.operators.aggregates import numeric
from tallyframe.operators.pair import TablePair

#: Reason codes, in the order in which they are given.
HAS_FRACTION, OUT_OF_RANGE, KEY_STAYS, VERIFIED_OUT = "HAS_FRACTION", "OUT_OF_RANGE", "PK_FK_BIGINT_MAINTAIN", "OUT_OF_RANGE_VERIFIED"
TOLERANCE, SUM, HASH, CAST_LOSS = "TOLERANCE_EXCEEDED", "SUM_MISMATCH", "HASH_MISMATCH", "CAST_LOSS"
#: What speaks for a narrower type.
EVIDENCE = ("no_fraction_values", "within_bigint_range", "hash_match", "sum_match")
#: Ratios of the hints.
FEW_DISTINCT, MANY_NULLS = 0.01, 0.9
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"
WIDE = "decimal(38,10)"


@dataclass(frozen=True)
class Keys:
    pk: tuple[str, ...] = ()
    fk: tuple[str, ...] = ()
    indexed: tuple[str, ...] = ()

    @property
    def held(self) -> list[str]:
        return sorted({c.lower() for c in (*self.pk, *self.fk)})


def _fits(lo: Column, hi: Column, name: str) -> Column:
    least, most = RANGES[name]
    return (lo >= F.lit(least).cast(WIDE)) & (hi <= F.lit(most).cast(WIDE))


def both_sides(profiles: DataFrame) -> DataFrame:
    """Profiles of two sides (with column side) as one row for each column."""
    own = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    kept = ("row_count", "null_count", "distinct_count", "min_value", "max_value", "fraction_row_count", "sum_value", "non_zero_time_count", "day_count", *(c for c in profiles.columns if c.startswith(("out_", "loss_"))))
    return profiles.groupBy("column_name").agg(*[own(side, c).alias(f"{side[0]}_{c}") for side in ("source", "target") for c in kept])


def recommended_type(joined: DataFrame) -> DataFrame:
    """joined (both_sides) with lo, hi, fractions and recommended_type: the first that holds of

    all values of a side read as eight-digit dates: DATE; a side's least or largest value is a date or time: TIMESTAMP if
    any time of day is not midnight, else DATE; fractions: NUMERIC; then the narrowest whole type that holds both
    sides; without a number NUMERIC.
    """
    number = lambda c: F.col(c).try_cast(WIDE)
    d = joined.withColumn("lo", F.least(number("s_min_value"), number("t_min_value"))).withColumn("hi", F.greatest(number("s_max_value"), number("t_max_value")))
    d = d.withColumn("fractions", F.coalesce("s_fraction_row_count", F.lit(0)) + F.coalesce("t_fraction_row_count", F.lit(0)))
    days = lambda s: (F.col(f"{s}_day_count") > 0) & (F.col(f"{s}_day_count") == F.col(f"{s}_row_count") - F.col(f"{s}_null_count"))
    dated = lambda s: F.coalesce(F.col(f"{s}_min_value").rlike(DATE_TEXT) | F.col(f"{s}_max_value").rlike(DATE_TEXT), F.lit(False))
    midnight = (F.coalesce("s_non_zero_time_count", F.lit(0)) + F.coalesce("t_non_zero_time_count", F.lit(0))) == 0
    known = F.coalesce("s_non_zero_time_count", "t_non_zero_time_count").isNotNull()
    kind = (
        F.when(F.coalesce(days("s"), F.lit(False)) | F.coalesce(days("t"), F.lit(False)), F.lit("DATE"))
        .when((dated("s") | dated("t")) & known & midnight, F.lit("DATE"))
        .when(dated("s") | dated("t"), F.lit("TIMESTAMP"))
        .when(F.col("fractions") > 0, F.lit("NUMERIC"))
    )
    for name in ("SMALLINT", "INTEGER", "BIGINT"):
        kind = kind.when(_fits(F.col("lo"), F.col("hi"), name), F.lit(name))
    return d.withColumn("recommended_type", kind.otherwise(F.lit("NUMERIC")))


def _typed(pair: TablePair, columns: list[str]) -> DataFrame:
    """column_name, current_type (of the target), metadata_type and source_type of columns; rows are literals."""
    spark = pair.source.sparkSession
    rows = []
    for c in columns:
        kind, length, precision, scale = dictionary_type(pair.source.schema[c].dataType)
        rows.append((c, current_type(pair.target.schema[c].dataType), target_type(kind, length, precision, scale), kind, scale))
    return spark.createDataFrame(rows, "column_name string, current_type string, metadata_type string, source_type string, source_scale int")


def recommend(pair: TablePair, columns: list[str] | None = None, keys: Keys = Keys(), strict_days: bool = True, narrower: bool = False, distinct: bool = False) -> DataFrame:
    """column_name, current_type, metadata_type, recommended_type, final_type, with both sides' statistics (counts of distinct values only if asked for).

    final_type is that of the data, or the dictionary's where the data says no more than NUMERIC; a key is at least a BIGINT.
    """
    columns = columns or [*pair.keys, *pair.values]
    found = recommended_type(both_sides(P.profile_pair(pair, columns, strict_days=strict_days, narrower=narrower, distinct=distinct)))
    found = found.join(F.broadcast(_typed(pair, columns)), "column_name")
    final = F.when(F.col("recommended_type") != "NUMERIC", F.col("recommended_type")).otherwise(F.col("metadata_type"))
    held = F.lower("column_name").isin(keys.held) if keys.held else F.lit(False)
    return found.withColumn("is_key", held).withColumn("final_type", F.when(held & final.isin("SMALLINT", "INTEGER"), F.lit("BIGINT")).otherwise(final))


def alter_text(schema: str, table: str, column: Column, kind: Column, current: Column, dialect: str = "postgres") -> Column:
    """The statement that changes a column's type."""
    name = F.lower(column)
    if dialect == "oracle":
        return F.concat(F.lit(f'ALTER TABLE "{schema.upper()}"."{table.upper()}" MODIFY ("'), F.upper(column), F.lit('" '), kind, F.lit(");"))
    using = F.when(current.startswith("NUMERIC") & kind.isin("SMALLINT", "INTEGER", "BIGINT"), F.concat(F.lit(' USING "'), name, F.lit('"::'), F.lower(kind))).otherwise(F.lit(""))
    return F.concat(F.lit(f'ALTER TABLE "{schema.lower()}"."{table.lower()}" ALTER COLUMN "'), name, F.lit('" TYPE '), kind, using, F.lit(";"))


def alter_ddl(pair: TablePair, schema: str, table: str, columns: list[str] | None = None, keys: Keys = Keys(), dialect: str = "postgres") -> DataFrame:
    """column_name, current_type, final_type, ddl of the columns that are NUMERIC now and need not be."""
    if dialect not in ("postgres", "oracle"):
        raise ValueError("dialect is postgres or oracle")
    found = recommend(pair, columns, keys).where(F.col("current_type").startswith("NUMERIC") & (F.col("final_type") != F.col("current_type")) & ~F.col("final_type").startswith("NUMERIC"))
    return found.select("column_name", "current_type", "final_type", alter_text(schema, table, F.col("column_name"), F.col("final_type"), F.col("current_type"), dialect).alias("ddl"))


def candidates(pair: TablePair, schema: str, table: str, chunks: DataFrame | None = None, columns: list[str] | None = None, keys: Keys = Keys(), tolerance: str = "0.0001", by_column: dict[str, str] | None = None) -> DataFrame:
    """Numeric columns as candidates for a whole type, with reasons.

    column_name, current_type, recommended_type, target_type, can_downcast, reasons (against, or what speaks for it), out_of_range_rows,
    dry_run_loss_count, sum_difference, message, ddl. chunks is the result of compare_chunks: a mismatch speaks against every column.
    """
    columns = [c for c in (columns or [*pair.keys, *pair.values]) if numeric(pair.source.schema[c].dataType)]
    found = recommend(pair, columns, keys, narrower=True)  # one pass a side, with the counts for every target type
    target = F.when(F.col("lo").isNull() | _fits(F.col("lo"), F.col("hi"), "BIGINT") & ~_fits(F.col("lo"), F.col("hi"), "INTEGER"), F.lit("BIGINT"))
    target = target.when(_fits(F.col("lo"), F.col("hi"), "SMALLINT"), F.lit("SMALLINT")).when(_fits(F.col("lo"), F.col("hi"), "INTEGER"), F.lit("INTEGER")).otherwise(F.lit("BIGINT"))
    held = F.col("is_key") & target.isin("SMALLINT", "INTEGER")
    d = found.withColumn("key_stays", held).withColumn("target_type", F.when(held, F.lit("BIGINT")).otherwise(target))
    for name in RANGES:
        d = d.withColumn(f"out_{name}", F.col(f"s_out_{name}") + F.col(f"t_out_{name}")).withColumn(f"loss_{name}", F.col(f"t_loss_{name}"))
    by_target = lambda x: F.when(F.col("target_type") == "SMALLINT", F.col(f"{x}_SMALLINT")).when(F.col("target_type") == "INTEGER", F.col(f"{x}_INTEGER")).otherwise(F.col(f"{x}_BIGINT"))
    most = F.lit(tolerance).cast(WIDE)
    for c, v in (by_column or {}).items():
        most = F.when(F.lower("column_name") == c.lower(), F.lit(v).cast(WIDE)).otherwise(most)
    gap = F.abs(F.try_subtract(F.col("s_sum_value").try_cast(WIDE), F.col("t_sum_value").try_cast(WIDE)))
    d = d.withColumn("out_of_range_rows", by_target("out")).withColumn("dry_run_loss_count", by_target("loss")).withColumn("sum_difference", gap)
    if chunks is not None:
        bad = chunks.agg(F.count_if(~F.col("match")).alias("bad")).withColumn("one", F.lit(1))
        d = d.withColumn("one", F.lit(1)).join(F.broadcast(bad), "one")
    else:
        d = d.withColumn("bad", F.lit(0).cast("long"))
    unequal = ~F.col("s_sum_value").eqNullSafe(F.col("t_sum_value"))
    tests = (
        (HAS_FRACTION, (F.col("fractions") > 0) | F.coalesce(F.col("source_scale") > 0, F.lit(False))),
        (OUT_OF_RANGE, F.col("lo").isNotNull() & ~_fits(F.col("lo"), F.col("hi"), "BIGINT")),
        (KEY_STAYS, F.col("key_stays")),
        (VERIFIED_OUT, F.col("out_of_range_rows") > 0),
        (TOLERANCE, F.coalesce(gap > most, F.lit(False))),
        (SUM, unequal),
        (HASH, F.col("bad") > 0),
        (CAST_LOSS, F.col("dry_run_loss_count") > 0),
    )
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    # a key that stays a BIGINT may still become one
    against = F.filter(reasons, lambda r: r != KEY_STAYS)
    d = d.withColumn("against", reasons).withColumn("can_downcast", F.size(against) == 0)
    message = (
        F.when(~F.col("can_downcast"), F.lit("keep the type"))
        .when(F.col("is_key"), F.lit("key columns stay at BIGINT so that joins keep one type"))
        .when(F.col("target_type") == "SMALLINT", F.lit("SMALLINT holds all values in 2 bytes"))
        .when(F.col("target_type") == "INTEGER", F.lit("INTEGER holds all values in 4 bytes"))
        .otherwise(F.lit("BIGINT holds all values in 8 bytes"))
    )
    for_it = F.array_union("against", F.array(*[F.lit(x) for x in EVIDENCE]))
    ddl = F.when(F.col("can_downcast"), alter_text(schema, table, F.col("column_name"), F.col("target_type"), F.col("current_type")))
    return d.select("column_name", "current_type", "recommended_type", "target_type", "can_downcast", F.when(F.col("can_downcast"), for_it).otherwise(F.col("against")).alias("reasons"), "out_of_range_rows", "dry_run_loss_count", "sum_difference", message.alias("message"), ddl.alias("ddl"))


def changeable(pair: TablePair, columns: list[str] | None = None, keys: Keys = Keys()) -> DataFrame:
    """Columns whose data or dictionary says more than NUMERIC: column_name, current_type, recommended_type, source_type, in_index, null_ratio, distinct_ratio, hint, time_profile, fractions (rows of both sides with one)."""
    d = recommend(pair, columns, keys, distinct=True).where((F.col("recommended_type") != "NUMERIC") | (F.col("metadata_type") != "NUMERIC"))
    rows = F.greatest("s_row_count", F.lit(1))
    nulls, distinct = F.col("s_null_count") / rows, F.col("s_distinct_count") / rows
    indexed = F.lower("column_name").isin([c.lower() for c in keys.indexed]) if keys.indexed else F.lit(False)
    hint = F.when(nulls > MANY_NULLS, F.lit("mostly null: a narrower type saves little")).when(distinct < FEW_DISTINCT, F.lit("few distinct values: a code or flag")).otherwise(F.lit(""))
    timed = F.coalesce("s_non_zero_time_count", F.lit(0)) + F.coalesce("t_non_zero_time_count", F.lit(0))
    times = F.when(F.col("recommended_type") == "DATE", F.lit("no time of day in use")).when(F.col("recommended_type") == "TIMESTAMP", F.concat(timed.cast("string"), F.lit(" rows have a time of day")))
    return d.select("column_name", "current_type", "recommended_type", "source_type", indexed.alias("in_index"), nulls.alias("null_ratio"), distinct.alias("distinct_ratio"), hint.alias("hint"), times.alias("time_profile"), "fractions")
