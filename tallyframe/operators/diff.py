"""Differences of rows and columns: by key where there is one, as multisets where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.canonical import value_text
from tallyframe.operators.aggregates import numeric
from tallyframe.operators.pair import TablePair

#: The reasons of a difference.
NULL_MISMATCH, OUT_OF_TOLERANCE, VALUE_MISMATCH = "null_mismatch", "decimal_tolerance_exceeded", "value_mismatch"
MISSING, EXTRA, ROW_COUNT = "missing_in_target", "extra_in_target", "row_count_mismatch"

_DIFFERENCE = "decimal(38,6)"


def _joined(pair: TablePair, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides by key (nulls in keys are equal), as structs s and t of the values."""
    s = pair.source.select(*[F.col(k).alias(f"s_{k}") for k in pair.keys], F.struct(*pair.values, *extra).alias("s"))
    t = pair.target.select(*[F.col(k).alias(f"t_{k}") for k in pair.keys], F.struct(*pair.values, *extra).alias("t"))
    on = F.lit(True)
    for k in pair.keys:
        on = on & F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}"))
    both = s.join(t, on, "full_outer")
    return both.select(*[F.coalesce(f"s_{k}", f"t_{k}").alias(k) for k in pair.keys], "s", "t")


def _text(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    return value_text(kind, c)


def _blank(c: Column, kind: T.DataType, policy: str) -> Column:
    """An empty text as null where the policy counts both as one."""
    if policy != "distinct" and isinstance(kind, T.StringType):
        return F.when(c == "", F.lit(None)).otherwise(c)
    return c


def _column(pair: TablePair, name: str, tolerance: str, policy: str) -> Column:
    """A struct of a column's difference, null where there is none."""
    ks, kt = pair.source.schema[name].dataType, pair.target.schema[name].dataType
    a, b = _blank(F.col(f"s.{name}"), ks, policy), _blank(F.col(f"t.{name}"), kt, policy)
    none = F.lit(None)
    if numeric(ks) or numeric(kt):
        x, y = a.try_cast("decimal(38,10)"), b.try_cast("decimal(38,10)")
        gap = F.abs(x - y)
        unread = (x.isNull() | y.isNull()) & ~a.cast("string").eqNullSafe(b.cast("string"))
        reason = F.when(unread, F.lit(VALUE_MISMATCH)).when(gap > F.lit(tolerance).cast("decimal(38,10)"), F.lit(OUT_OF_TOLERANCE))
        difference = gap.cast(_DIFFERENCE)
    else:
        reason = F.when(a != b, F.lit(VALUE_MISMATCH)) if ks == kt else F.when(_text(ks, a) != _text(kt, b), F.lit(VALUE_MISMATCH))
        difference = none.cast(_DIFFERENCE)
    reason = F.when(a.isNull() & b.isNull(), none).when(a.isNull() | b.isNull(), F.lit(NULL_MISMATCH)).otherwise(reason)
    full = F.struct(F.lit(name).alias("column_name"), _text(ks, F.col(f"s.{name}")).alias("source_value"), _text(kt, F.col(f"t.{name}")).alias("target_value"), difference.alias("difference"), reason.alias("reason"))
    return F.when(reason.isNotNull(), full)


def row_diff(pair: TablePair, tolerance: str = "0.0001", by_column: dict[str, str] | None = None, policy: str = "distinct", extra: tuple[str, ...] = ()) -> DataFrame:
    """key..., column_name, source_value, target_value, difference, reason; and extra columns of either side.

    One row for each column that differs, or for a row that only one side has (then column_name is null). Numbers
    differ if they are further apart than the tolerance; a null differs from any value and equals a null.
    """
    by_column = {k.lower(): v for k, v in (by_column or {}).items()}
    both = _joined(pair, extra)
    kind = "struct<column_name:string,source_value:string,target_value:string,difference:decimal(38,6),reason:string>"
    whole = lambda reason: F.array(F.struct(*[F.lit(None).alias(x) for x in ("column_name", "source_value", "target_value", "difference")], F.lit(reason).alias("reason")).cast(kind))
    columns = [_column(pair, c, by_column.get(c.lower(), tolerance), policy) for c in pair.values]
    found = F.array_compact(F.array(*columns)).cast(f"array<{kind}>") if columns else F.array().cast(f"array<{kind}>")
    all_ = F.when(F.col("t").isNull(), whole(MISSING)).when(F.col("s").isNull(), whole(EXTRA)).otherwise(found)
    more = [F.coalesce(f"s.{x}", f"t.{x}").alias(x) for x in extra]
    return both.select(*pair.keys, *more, F.explode(all_).alias("d")).select(*pair.keys, *extra, "d.*")


def sides(pair: TablePair) -> DataFrame:
    """key..., reason of the rows that one side lacks: an anti-join each way, which reads the keys only."""
    s, t = pair.source.select(*pair.keys), pair.target.select(*pair.keys)
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in pair.keys]
    missing = s.join(t, on(s, t), "left_anti").withColumn("reason", F.lit(MISSING))
    return missing.unionByName(t.join(s, on(t, s), "left_anti").withColumn("reason", F.lit(EXTRA)))


def multiset_diff(pair: TablePair) -> DataFrame:
    """The columns, reason and copies: of each distinct row by how many copies one side has more. For tables without a key."""
    columns = [*pair.keys, *pair.values]
    side = lambda d, n: d.select(*columns).withColumn("__n", F.lit(n))
    counts = side(pair.source, 1).unionByName(side(pair.target, -1)).groupBy(*columns).agg(F.sum("__n").alias("__n"))
    return counts.where("__n <> 0").select(*columns, F.when(F.col("__n") > 0, F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("reason"), F.abs("__n").alias("copies"))


def repeated_keys(pair: TablePair) -> DataFrame:
    """key... of the keys that more rows than one of a side have."""
    counts = [d.groupBy(*pair.keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*pair.keys) for d in (pair.source, pair.target)]
    return counts[0].unionByName(counts[1]).distinct()


def keyed_diff(pair: TablePair, tolerance: str = "0.0001", by_column: dict[str, str] | None = None, policy: str = "distinct") -> DataFrame:
    """As row_diff; rows whose key repeats on a side are compared as a multiset, a row of the result (missing or extra) for each copy that one side has more."""
    repeated = repeated_keys(pair).persist()
    on = lambda d: [d[k].eqNullSafe(repeated[k]) for k in pair.keys]
    split = lambda how: TablePair(*(d.join(repeated, on(d), how) for d in (pair.source, pair.target)), pair.keys, pair.columns)
    once = row_diff(split("left_anti"), tolerance, by_column, policy)
    copies = multiset_diff(split("left_semi")).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    none = {c: F.lit(None).cast(once.schema[c].dataType) for c in ("column_name", "source_value", "target_value", "difference")}
    return once.unionByName(copies.withColumns(none).select(*once.columns))


def drill_down(pair: TablePair, failed: DataFrame, tolerance: str = "0.0001", sample: int = 10, most: int = 10, by_column: dict[str, str] | None = None, policy: str = "distinct", by: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """Differences within failed chunks (by..., chunk_id): of each the first sample keys of both sides, and of those at most most differences.

    by..., chunk_id, key..., column_name, source_value, target_value, difference, reason, early_exit (the chunk reached most).
    pair has the columns of by and chunk_id on both sides; a null in them is a chunk like any other. A key that repeats is compared as a multiset of its rows, unless
    keys are known to be unique.
    """
    names = [*by, "chunk_id"]
    chunks = failed.select(*names).distinct()
    equal = lambda a, b, columns: [a[k].eqNullSafe(b[k]) for k in columns]
    source, target = (d.join(chunks, equal(d, chunks, names), "left_semi") for d in (pair.source, pair.target))
    keys = list(dict.fromkeys([*names, *pair.keys]))
    first = Window.partitionBy(*names).orderBy(*pair.keys)
    wanted = source.select(*keys).unionByName(target.select(*keys)).distinct().withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= sample).drop("__k")
    source, target = (d.join(wanted, equal(d, wanted, keys), "left_semi") for d in (source, target))
    columns = tuple(c for c in pair.values if c not in names)
    found = (row_diff if unique else keyed_diff)(TablePair(source, target, tuple(keys), columns), tolerance, by_column, policy)
    order = Window.partitionBy(*names).orderBy(*pair.keys, "column_name")
    found = found.withColumn("__k", F.row_number().over(order)).withColumn("early_exit", F.count(F.lit(1)).over(Window.partitionBy(*names)) >= most)
    return found.where(F.col("__k") <= most).drop("__k")
