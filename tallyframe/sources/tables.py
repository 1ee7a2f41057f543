"""Readers and writers: files, catalog tables and JDBC, all as DataFrames."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import Connection
from tallyframe.operators.chunks import keyset_bounds

FORMATS = ("parquet", "orc", "json", "csv")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _literal(value) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, (int, float, Decimal)):
        return format(value, "f") if isinstance(value, Decimal) else repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _ordered(keys: tuple[str, ...], values: tuple, last: str) -> str:
    """The condition that a key stands before (<) or at or after (>=) values, column by column."""
    parts, equal = [], []
    for k, v in zip(keys, values, strict=True):
        sign = last if k == keys[-1] else last[0]
        parts.append(" AND ".join([*equal, f'"{k}" {sign} {_literal(v)}']))
        equal.append(f'"{k}" = {_literal(v)}')
    return "(" + " OR ".join(f"({p})" for p in parts) + ")"


def key_predicates(key_rows: DataFrame, keys: tuple[str, ...], partitions: int) -> list[str]:
    """Conditions that cut a table into about equal parts by keys of any type and number; each row is in one. key_rows holds the key columns alone."""
    size = max(1, -(-key_rows.count() // partitions))
    known = key_rows.na.drop(subset=list(keys))
    starts = [tuple(r) for r in keyset_bounds(known, keys, size).orderBy("chunk_id").select(*[f"start_{k}" for k in keys]).collect()][1:]  # one row a partition
    if not starts:
        return ["1 = 1"]
    null = " OR ".join(f'"{k}" IS NULL' for k in keys)
    first, last = f"{_ordered(keys, starts[0], '<')} OR {null}", _ordered(keys, starts[-1], ">=")
    known_keys = " AND ".join(f'"{k}" IS NOT NULL' for k in keys)
    return [first, *[f"{_ordered(keys, a, '>=')} AND {_ordered(keys, b, '<')} AND {known_keys}" for a, b in zip(starts, starts[1:], strict=False)], f"{last} AND {known_keys}"]


def read_jdbc(spark: SparkSession, connection: Connection, table: str | None = None, query: str | None = None, key: str | tuple[str, ...] | None = None, partitions: int = 8, predicates: list[str] | None = None) -> DataFrame:
    """A table or query over JDBC. With a numeric, date or timestamp key it is read in partitions between the key's least and largest value, with any other
    key or one of several columns in partitions of equal numbers of rows (the keys are read first); with predicates in one for each."""
    options = connection.options()
    if predicates:
        properties = {k: v for k, v in options.items() if k != "url"}
        return spark.read.jdbc(connection.url, table, predicates=predicates, properties=properties)
    reader = spark.read.format("jdbc").options(**options)
    if query is not None:
        return reader.option("query", query).load()
    plain = reader.option("dbtable", table).load()
    if key is None:
        return plain
    keys = (key,) if isinstance(key, str) else tuple(key)
    if len(keys) > 1 or not isinstance(plain.schema[keys[0]].dataType, (T.NumericType, T.DatetimeType)):
        return read_jdbc(spark, connection, table, predicates=key_predicates(plain.select(*keys), keys, partitions))
    key = keys[0]
    lo, hi = spark.read.format("jdbc").options(**options).option("dbtable", f'(SELECT MIN("{key}") AS LO, MAX("{key}") AS HI FROM {table}) b').load().first()
    if lo is None:
        return plain
    return spark.read.format("jdbc").options(**options).option("dbtable", table).options(partitionColumn=f'"{key}"', lowerBound=str(lo), upperBound=str(hi), numPartitions=str(partitions)).load()


def write_jdbc(df: DataFrame, connection: Connection, table: str, mode: str = "append", truncate: bool = False, cascade: bool = False) -> None:
    """Rows into a JDBC table; overwrite with truncate keeps the table and its keys."""
    writer = df.write.format("jdbc").options(**connection.options()).option("dbtable", table)
    if truncate:
        mode, writer = "overwrite", writer.option("truncate", True)
        if cascade:
            writer = writer.option("cascadeTruncate", True)
    writer.mode(mode).save()


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_table(df: DataFrame, name: str, mode: str = "append", bucket_by: tuple[int, tuple[str, ...]] | None = None) -> None:
    """Rows into a catalog table; bucketed by its key, later comparisons of it need no shuffle."""
    writer = df.write.mode(mode)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    writer.saveAsTable(name)


def self_test(spark: SparkSession) -> DataFrame:
    """The session's time, version, user and database."""
    return spark.range(1).select(F.current_timestamp().alias("now"), F.version().alias("version"), F.current_user().alias("user"), F.current_database().alias("database"))


def jdbc_self_test(spark: SparkSession, connection: Connection, statement: str) -> bool:
    """Whether a statement runs over the connection."""
    return read_jdbc(spark, connection, query=statement).limit(1).count() == 1
