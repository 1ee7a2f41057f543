"""CREATE TABLE and key statements from a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.typemap import dictionary_type, spark_type, target_type


def dictionary(df: DataFrame, schema: str, table: str) -> DataFrame:
    """Rows of a column dictionary for df: schema_name, table_name, column_name, column_id, data_type, data_length, data_precision, data_scale, nullable."""
    rows = []
    for k, f in enumerate(df.schema.fields, 1):
        kind, length, precision, scale = dictionary_type(f.dataType)
        rows.append((schema, table, f.name.lower(), k, kind, length, precision, scale, "Y" if f.nullable else "N"))
    return df.sparkSession.createDataFrame(rows, "schema_name string, table_name string, column_name string, column_id int, data_type string, data_length int, data_precision int, data_scale int, nullable string")


def column_types(columns: DataFrame, pk: tuple[str, ...] = ()) -> DataFrame:
    """The dictionary rows with target_type; a NUMBER in the key is a BIGINT. The map is applied to the distinct types, which are few."""
    names = ["data_type", "data_length", "data_precision", "data_scale"]
    kinds = [tuple(r) for r in columns.select(*names).distinct().collect()]
    spark = columns.sparkSession
    mapped = spark.createDataFrame([(*k, target_type(*k)) for k in kinds], "k string, l int, p int, s int, target_type string")
    on = F.col("k").eqNullSafe(F.col(names[0])) & F.col("l").eqNullSafe(F.col(names[1])) & F.col("p").eqNullSafe(F.col(names[2])) & F.col("s").eqNullSafe(F.col(names[3]))
    held = F.lower("column_name").isin([c.lower() for c in pk]) & (F.upper("data_type") == "NUMBER")
    return columns.join(F.broadcast(mapped), on).drop("k", "l", "p", "s").withColumn("target_type", F.when(held, F.lit("BIGINT")).otherwise(F.col("target_type")))


def create_table(columns: DataFrame, pk: tuple[str, ...] = (), if_not_exists: bool = True) -> DataFrame:
    """schema_name, table_name, ddl of every table in the dictionary rows."""
    typed = column_types(columns, pk)
    line = F.concat(F.lit('    "'), F.lower("column_name"), F.lit('" '), F.col("target_type"), F.when(F.col("nullable") == "N", F.lit(" NOT NULL")).otherwise(F.lit("")))
    lines = typed.select("schema_name", "table_name", "column_id", line.alias("line")).groupBy("schema_name", "table_name").agg(F.array_sort(F.collect_list(F.struct("column_id", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), ",\n")
    head = F.concat(F.lit("CREATE TABLE " + "IF NOT EXISTS " * if_not_exists + '"'), F.lower("schema_name"), F.lit('"."'), F.lower("table_name"), F.lit('" (\n'))
    return lines.select("schema_name", "table_name", F.concat(head, body, F.lit("\n);")).alias("ddl"))


def primary_key(constraints: DataFrame) -> DataFrame:
    """schema_name, table_name, ddl from rows (schema_name, table_name, constraint_name, column_name, position)."""
    keys = constraints.groupBy("schema_name", "table_name", "constraint_name").agg(F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("columns"))
    names = F.array_join(F.transform("columns", lambda x: F.concat(F.lit('"'), F.lower(x["column_name"]), F.lit('"'))), ", ")
    text = F.concat(F.lit('ALTER TABLE "'), F.lower("schema_name"), F.lit('"."'), F.lower("table_name"), F.lit('" ADD CONSTRAINT "'), F.lower("constraint_name"), F.lit('" PRIMARY KEY ('), names, F.lit(");"))
    return keys.select("schema_name", "table_name", text.alias("ddl"))


def spark_schema(columns: DataFrame, pk: tuple[str, ...] = ()) -> T.StructType:
    rows = sorted(column_types(columns, pk).collect(), key=lambda r: r.column_id)  # a dictionary, not data
    return T.StructType([T.StructField(r.column_name, spark_type(r.target_type), r.nullable != "N") for r in rows])


def create_spark_table(spark: SparkSession, name: str, schema: T.StructType, pk: tuple[str, ...] = (), drop: bool = False, provider: str = "parquet") -> None:
    """Make a table; the key is kept as a table property."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rpartition('.')[0]}")
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema.fields)
    properties = f" TBLPROPERTIES ('primary_key' = '{','.join(pk)}')" if pk else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING {provider}{properties}")
