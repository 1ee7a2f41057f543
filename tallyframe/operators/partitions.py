"""Partitions of a table as half-open ranges: their bounds, matching of both sides, strategy and assignment of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms of dates in bounds.
FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")
FULL, LIGHT = "full", "light"
#: What a partition's summary says.
OK, FAILED, MATCH, MISMATCH, SKIPPED, LIMITED = "OK", "FAILED", "match", "mismatch", "skipped", "limited"
#: Partitions up to so many are broadcast to the rows; more are joined by a shuffle.
BROADCAST = 10_000


def parse_time(c: Column) -> Column:
    """The first of FORMS that reads the text; else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in FORMS])


def high_value(c: Column) -> Column:
    """The value in an upper bound: that of TO_DATE('...'), of a quoted text or of a number; MAXVALUE is null."""
    text = F.trim(c)
    quoted = F.trim(F.regexp_extract(text, "'([^']*)'", 1))
    number = F.regexp_extract(text, r"^(-?\d+(?:\.\d+)?)$", 1)
    return F.when(quoted != "", quoted).when(number != "", number)


def bound(c: Column) -> tuple[Column, Column]:
    """Start and end in FOR VALUES FROM ('a') TO ('b') or FOR VALUES IN (a, ..., z): a and b, or a and z. MINVALUE and MAXVALUE are null."""
    def clean(x):
        x = F.trim(F.regexp_replace(F.trim(x), "^'|'$", ""))
        return F.when((x == "") | F.upper(x).isin("MINVALUE", "MAXVALUE"), F.lit(None)).otherwise(x)

    start, end = (F.regexp_extract(c, r"(?i)FROM\s*\(([^)]*)\)\s*TO\s*\(([^)]*)\)", k) for k in (1, 2))
    listed = F.split(F.regexp_extract(c, r"(?i)IN\s*\(([^)]*)\)", 1), r"\s*,\s*")
    return F.coalesce(clean(start), clean(listed[0])), F.coalesce(clean(end), clean(F.element_at(listed, -1)))


def listed(c: Column) -> Column:
    """All values in FOR VALUES IN (a, ..., z), without quotes; null of any other bound."""
    inside = F.regexp_extract(c, r"(?i)IN\s*\(([^)]*)\)", 1)
    values = F.transform(F.split(inside, r"\s*,\s*"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^'|'$", "")))
    return F.when(inside != "", values)


def source_ranges(partitions: DataFrame) -> DataFrame:
    """partition_name, position, range_start, range_end from (partition_name, high_value, partition_position): each begins where the one before ends."""
    value = high_value(F.col("high_value"))
    order = Window.orderBy("partition_position")  # a row for each partition
    return partitions.select("partition_name", F.col("partition_position").alias("position"), F.lag(value).over(order).alias("range_start"), value.alias("range_end"))


def target_ranges(partitions: DataFrame) -> DataFrame:
    """partition_name, range_start, range_end from (partition_name, partition_bound)."""
    start, end = bound(F.col("partition_bound"))
    return partitions.select("partition_name", start.alias("range_start"), end.alias("range_end"))


def matched(source: DataFrame, target: DataFrame | None) -> DataFrame:
    """partition_name (lower case), range_start, range_end of partitions that both sides have; of the source's alone if the target has none at all."""
    s = source.select(F.lower("partition_name").alias("partition_name"), "range_start", "range_end")
    if target is None:
        return s
    t = target.select(F.lower("partition_name").alias("partition_name"), F.col("range_start").alias("t_start"), F.col("range_end").alias("t_end"))
    return s.join(t, "partition_name").select("partition_name", F.coalesce("range_start", "t_start").alias("range_start"), F.coalesce("range_end", "t_end").alias("range_end"))


def with_strategy(ranges: DataFrame, immutable_before: str | None) -> DataFrame:
    """strategy: light for a partition that ends before immutable_before, full for all others and where either can't be read."""
    limit = parse_time(F.lit(immutable_before).cast("string"))
    old = F.coalesce(parse_time(F.col("range_end").cast("string")) < limit, F.lit(False))
    return ranges.withColumn("strategy", F.when(old, F.lit(LIGHT)).otherwise(F.lit(FULL)))


def predicate(key: str, start: str | None, end: str | None, base: str | None = None) -> str:
    """The condition of a range as SQL text, with a base condition."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    parts = [f"({base})"] if base else []
    parts += [f"`{key}` >= {quoted(start)}"] if start is not None else []
    parts += [f"`{key}` < {quoted(end)}"] if end is not None else []
    return " AND ".join(parts) or "TRUE"


def tasks(ranges: DataFrame, key: str, immutable_before: str | None, base: str | None = None) -> DataFrame:
    """partition_name, range_start, range_end, strategy, predicate."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(c.cast("string"), "'", "''"), F.lit("'"))
    parts = F.array(F.lit(f"({base})") if base else F.lit(None).cast("string"), F.concat(F.lit(f"`{key}` >= "), quoted(F.col("range_start"))), F.concat(F.lit(f"`{key}` < "), quoted(F.col("range_end"))))
    return with_strategy(ranges, immutable_before).withColumn("predicate", F.coalesce(F.nullif(F.array_join(F.array_compact(parts), " AND "), F.lit("")), F.lit("TRUE")))


def _position(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A key as it is compared with bounds, and as a double in the same order."""
    if isinstance(kind, T.NumericType):
        exact = c.try_cast("decimal(38,10)")
        return exact, exact.cast("double")
    time = c.cast("timestamp_ntz")
    return time, F.unix_micros(time.cast("timestamp")).cast("double")


def _bound_value(c: Column, kind: T.DataType) -> Column:
    return F.trim(c.cast("string")).try_cast("decimal(38,10)") if isinstance(kind, T.NumericType) else parse_time(c.cast("string")).cast("timestamp_ntz")


def assigned(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """df with the partition_name of the range that its key is in (null: none).

    Number and time keys go by range_start and range_end: both ranges and rows are put in equal buckets between the least and the largest bound, a few for each
    partition, and meet by an equi-join on the bucket. Keys of other types, and partitions with listed values (a column
    values of texts), meet by an equi-join on the value. Partitions are counted first and broadcast up to BROADCAST.
    """
    kind = df.schema[key].dataType
    n = ranges.count()
    small = lambda d: F.broadcast(d) if n <= BROADCAST else d
    if "values" in ranges.columns and ranges.where(F.col("values").isNotNull()).limit(1).count() or not isinstance(kind, (T.NumericType, T.DatetimeType)):
        each = F.explode(F.coalesce("values", F.array("range_start"))) if "values" in ranges.columns else F.col("range_start")
        names = ranges.select("partition_name", each.alias("__value")).where("__value is not null")
        if isinstance(kind, (T.NumericType, T.DatetimeType)):
            names = names.withColumn("__value", _bound_value(F.col("__value"), kind))
            own = _position(F.col(key), kind)[0]
        else:
            own = F.col(key).cast("string")
        return df.withColumn("__own", own).join(small(names), F.col("__own") == F.col("__value"), "left").drop("__own", "__value")
    bounds = ranges.select("partition_name", _bound_value(F.col("range_start"), kind).alias("__start"), _bound_value(F.col("range_end"), kind).alias("__end"))
    place = lambda c: _position(F.col(c), kind)[1]
    lo, hi = bounds.agg(F.least(F.min(place("__start")), F.min(place("__end"))), F.greatest(F.max(place("__start")), F.max(place("__end")))).first()
    buckets = 4 * max(1, n)
    if lo is None or hi <= lo:
        lo, hi = lo or 0.0, (lo or 0.0) + 1.0

    def bucket(x):
        inside = F.floor((x - lo) / ((hi - lo) / buckets)).cast("int")
        return F.when(x < lo, F.lit(-1)).when(x >= hi, F.lit(buckets)).when(x.isNotNull(), F.least(inside, F.lit(buckets)))

    spread = bounds.withColumn("__bucket", F.explode(F.sequence(F.coalesce(bucket(place("__start")), F.lit(-1)), F.coalesce(bucket(place("__end")), F.lit(buckets)))))
    own, at = _position(F.col(key), kind)
    rows = df.withColumn("__own", own).withColumn("__at", bucket(at))
    on = (F.col("__at") == F.col("__bucket")) & (F.col("__start").isNull() | (F.col("__own") >= F.col("__start"))) & (F.col("__end").isNull() | (F.col("__own") < F.col("__end")))
    return rows.join(small(spread), on, "left").drop("__own", "__at", "__start", "__end", "__bucket")


def daily(df: DataFrame, key: str) -> DataFrame:
    """df with partition_name pYYYYMMDD of its key's day."""
    return df.withColumn("partition_name", F.concat(F.lit("p"), F.date_format(key, "yyyyMMdd")))


def scan(df: DataFrame, key: str, ranges: DataFrame, name: str) -> DataFrame:
    """The rows of one partition by its range, a plain condition that reaches the reader."""
    r = ranges.where(F.lower("partition_name") == name.lower()).first()
    if r is None:
        raise ValueError(f"there is no partition {name}")
    kind = df.schema[key].dataType
    whole = isinstance(kind, T.IntegralType)  # of a bound with a fraction the next whole number says the same
    value = lambda x: (F.ceil(_bound_value(F.lit(x), kind)) if whole else _bound_value(F.lit(x), kind)).cast(kind)
    out = df if r.range_start is None else df.where(F.col(key) >= value(r.range_start))
    return out if r.range_end is None else out.where(F.col(key) < value(r.range_end))


def drilled() -> Column:
    """Whether a drill-down looks into a chunk: it failed, and not in a light partition."""
    return ~F.col("match") & (F.coalesce("strategy", F.lit(FULL)) != LIGHT)


def summary(results: DataFrame, looked: Column | None = None) -> DataFrame:
    """partition_name, strategy, chunks, rows, hash_ok, status, hash_status, drilldown_status, checks from chunk results with partition_name, strategy,
    source_rows, match. looked is a condition on them, as drilled, that holds where a drill-down looked."""
    flag = F.lit(False) if looked is None else F.bool_or(looked)
    out = results.groupBy("partition_name", "strategy").agg(F.count(F.lit(1)).alias("chunks"), F.sum("source_rows").alias("rows"), F.bool_and("match").alias("hash_ok"), flag.alias("__looked"))
    looked = F.coalesce("__looked", F.lit(False))
    named = lambda yes, a, b: F.when(yes, F.lit(a)).otherwise(F.lit(b))
    checks = F.array_join(F.array_compact(F.array(F.when(F.col("hash_ok"), F.lit("hash")), F.when(looked, F.lit("drilldown")))), ",")
    return out.select("partition_name", "strategy", "chunks", "rows", "hash_ok", named(F.col("hash_ok"), OK, FAILED).alias("status"), named(F.col("hash_ok"), MATCH, MISMATCH).alias("hash_status"), named(looked, LIMITED, SKIPPED).alias("drilldown_status"), checks.alias("checks"))


def totals(summaries: DataFrame) -> DataFrame:
    """total_partitions, fully_verified, light_verified, failed."""
    ok = lambda s: F.count_if(F.col("hash_ok") & (F.col("strategy") == s))
    return summaries.agg(F.count(F.lit(1)).alias("total_partitions"), ok(FULL).alias("fully_verified"), ok(LIGHT).alias("light_verified"), F.count_if(~F.col("hash_ok")).alias("failed"))
