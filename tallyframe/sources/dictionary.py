"""The dictionary of a database behind JDBC, from the driver's own metadata, and statements run on it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import Connection
from tallyframe.operators import ddl
from tallyframe.sources.catalog import KeyRegistry

#: Columns of the dictionary rows, as ddl.dictionary has them.
KIND = "schema_name string, table_name string, column_name string, column_id int, data_type string, data_length int, data_precision int, data_scale int, nullable string"


@contextmanager
def session(spark: SparkSession, connection: Connection) -> Iterator:
    """An open connection on the driver, closed at the end."""
    jvm = spark.sparkContext._jvm
    if connection.driver:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(connection.driver)
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if getattr(connection, k):
            properties.setProperty(k, getattr(connection, k))
    opened = jvm.java.sql.DriverManager.getConnection(connection.url, properties)
    try:
        yield opened
    finally:
        opened.close()


def _rows(result, *names: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getObject(n) for n in names))
    result.close()
    return out


def execute(spark: SparkSession, connection: Connection, statements: list[str]) -> int:
    """Run statements in one transaction; if one fails none stays. How many ran."""
    with session(spark, connection) as open_:
        open_.setAutoCommit(False)
        try:
            for text in statements:
                statement = open_.createStatement()
                statement.execute(text.strip().rstrip(";"))
                statement.close()
            open_.commit()
        except Exception:
            open_.rollback()
            raise
    return len(statements)


def statements_of(script: str) -> list[str]:
    """The statements of a script without comments and without its own BEGIN, COMMIT and ROLLBACK; a semicolon in quotes ends none."""
    out, now, quote = [], "", ""
    lines = "\n".join(x for x in script.splitlines() if not x.lstrip().startswith("--"))
    for c in lines:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        if c == ";" and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [s for s in (*out, now.strip()) if s and s.upper() not in ("BEGIN", "COMMIT", "ROLLBACK")]


def _schema(meta, name: str) -> str | None:
    """The schema's name as the database writes it: the same, else one that differs in case alone."""
    found = sorted((s for (s,) in _rows(meta.getSchemas(), "TABLE_SCHEM") if s.lower() == name.lower()), key=lambda s: s != name)
    return found[0] if found else None


def _tables(spark: SparkSession, meta, schema: str | None) -> list[str]:
    if schema is None:
        return []
    gateway = spark.sparkContext._gateway
    kinds = gateway.new_array(gateway.jvm.java.lang.String, 1)
    kinds[0] = "TABLE"
    return sorted(t for (t,) in _rows(meta.getTables(None, schema, "%", kinds), "TABLE_NAME"))


def tables(spark: SparkSession, connection: Connection, schema: str) -> list[str]:
    with session(spark, connection) as open_:
        meta = open_.getMetaData()
        return _tables(spark, meta, _schema(meta, schema))


def quoted(spark: SparkSession, connection: Connection, schema: str, table: str) -> str:
    """schema.table in quotes, as the database writes them."""
    with session(spark, connection) as open_:
        return f'"{_schema(open_.getMetaData(), schema) or schema}"."{table}"'


def exists(spark: SparkSession, connection: Connection, schema: str, table: str) -> bool:
    return table.lower() in {t.lower() for t in tables(spark, connection, schema)}


def columns(spark: SparkSession, connection: Connection, schema: str, table: str | None = None) -> DataFrame:
    """Dictionary rows of a table, or of all tables of the schema."""
    rows = []
    with session(spark, connection) as open_:
        meta = open_.getMetaData()
        own = _schema(meta, schema)
        for t in _tables(spark, meta, own):
            if table is None or t.lower() == table.lower():
                for name, place, kind, size, digits, nullable in _rows(meta.getColumns(None, own, t, "%"), "COLUMN_NAME", "ORDINAL_POSITION", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "NULLABLE"):
                    number = kind.upper() in ("NUMBER", "NUMERIC", "DECIMAL")
                    rows.append((own, t, name, place, "NUMBER" if number else kind, None if number else size, size if number else None, digits if number else None, "N" if nullable == 0 else "Y"))
    return spark.createDataFrame(rows, KIND)


def keys(spark: SparkSession, connection: Connection, schema: str) -> KeyRegistry:
    """Primary, foreign and index keys of all tables of the schema."""
    rows = []
    with session(spark, connection) as open_:
        meta = open_.getMetaData()
        own = _schema(meta, schema)
        for t in _tables(spark, meta, own):
            rows += [(t, "P", name or "", c, k) for name, c, k in _rows(meta.getPrimaryKeys(None, own, t), "PK_NAME", "COLUMN_NAME", "KEY_SEQ")]
            rows += [(t, "R", name or "", c, k) for name, c, k in _rows(meta.getImportedKeys(None, own, t), "FK_NAME", "FKCOLUMN_NAME", "KEY_SEQ")]
            rows += [(t, "I", name, c, k) for name, c, k in _rows(meta.getIndexInfo(None, own, t, False, True), "INDEX_NAME", "COLUMN_NAME", "ORDINAL_POSITION") if c]
    return KeyRegistry.from_constraints(spark.createDataFrame(rows, "table_name string, constraint_type string, constraint_name string, column_name string, position int"))


def create(spark: SparkSession, connection: Connection, dictionary: DataFrame, schema: str, table: str, pk: tuple[str, ...] = (), drop: bool = False) -> list[str]:
    """Make a table from dictionary rows, its schema first if there is none, with its key; one that exists stays unless it is to be dropped. What ran."""
    with session(spark, connection) as open_:
        meta = open_.getMetaData()
        own = _schema(meta, schema)
        there = next((t for t in _tables(spark, meta, own) if t.lower() == table.lower()), None)
    if there and not drop:
        return []
    run = [] if own else [f'CREATE SCHEMA "{schema.lower()}"']
    run += [f'DROP TABLE "{own}"."{there}"'] if there else []
    held = F.lower("column_name").isin([c.lower() for c in pk])  # a key has no nulls
    run.append(ddl.create_table(dictionary.withColumn("nullable", F.when(held, F.lit("N")).otherwise(F.col("nullable"))), pk, if_not_exists=False).first().ddl)
    if pk:
        rows = spark.createDataFrame([(schema, table, f"pk_{table}", c, k) for k, c in enumerate(pk)], "schema_name string, table_name string, constraint_name string, column_name string, position int")
        run.append(ddl.primary_key(rows).first().ddl)
    execute(spark, connection, run)
    return run
