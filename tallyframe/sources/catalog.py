"""What the catalog knows: tables, columns, keys, partitions, sizes; keys that Spark has no place for are in a registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class KeyRegistry:
    """Primary, foreign and index keys by table name, without regard to case."""

    primary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: dict[str, tuple[str, ...]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def _of(known: dict[str, tuple[str, ...]], table: str) -> tuple[str, ...]:
        found = {k.lower(): v for k, v in known.items()}.get(table.lower(), ())
        return tuple(dict.fromkeys(c.lower() for c in found))

    def pk(self, table: str, explicit: tuple[str, ...] | None = None, profile: tuple[str, ...] | None = None) -> tuple[str, ...]:
        """The key: what the caller says, else the profile, else what is registered."""
        return tuple(explicit or profile or self._of(self.primary, table))

    def fk(self, table: str) -> tuple[str, ...]:
        return self._of(self.foreign, table)

    def indexed(self, table: str) -> tuple[str, ...]:
        return self._of(self.indexes, table)

    def composite(self, table: str) -> bool:
        return len(self.pk(table)) > 1

    @classmethod
    def from_constraints(cls, rows: DataFrame) -> KeyRegistry:
        """From dictionary rows (table_name, constraint_type P, R or I, constraint_name, column_name, position)."""
        found: dict[str, dict[str, list]] = {"P": {}, "R": {}, "I": {}}
        for r in rows.orderBy("table_name", "constraint_name", "position").collect():  # a dictionary, not data
            found[r.constraint_type].setdefault(r.table_name.lower(), []).append(r.column_name.lower())
        return cls(*[{t: tuple(dict.fromkeys(c)) for t, c in found[k].items()} for k in "PRI"])


def tables(spark: SparkSession, schema: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)


def tables_like(spark: SparkSession, schema: str, pattern: str) -> list[str]:
    """Tables whose name a LIKE pattern fits, without regard to case."""
    names = spark.createDataFrame([(t,) for t in tables(spark, schema)], "name string")
    return sorted(r.name for r in names.where(F.lower("name").like(pattern.lower())).collect())


def columns(df: DataFrame) -> list[str]:
    return [c.lower() for c in df.columns]


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def numeric_scales(df: DataFrame, float_scale: int = 6) -> dict[str, int]:
    """The numeric columns with their scales; whole numbers have 0."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out[f.name.lower()] = f.dataType.scale
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out[f.name.lower()] = float_scale
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name.lower()] = 0
    return out


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def is_partitioned(spark: SparkSession, name: str) -> bool:
    return bool(partition_columns(spark, name))


def table_bytes(spark: SparkSession, name: str) -> int | None:
    """The table's size from its statistics, which are computed if there are none."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect():
        if r.col_name == "Statistics":
            return int(r.data_type.split(" bytes")[0])
    return None


def table_key(spark: SparkSession, name: str) -> tuple[str, ...]:
    """The key that a catalog table's properties name, as create_spark_table writes it."""
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}.get("primary_key", "")
    return tuple(c for c in found.split(",") if c)


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """key..., n of keys that more rows than one have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def matching(source: list[str], target: list[str], only: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Tables of the source (or those of only) that the target has too, and those that it lacks; without regard to case."""
    wanted, theirs = {t.lower() for t in only}, {t.lower() for t in target}
    mine = [t for t in source if not wanted or t.lower() in wanted]
    return [t for t in mine if t.lower() in theirs], [t for t in mine if t.lower() not in theirs]


def matching_tables(spark: SparkSession, source: str, target: str, only: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    return matching(tables(spark, source), tables(spark, target), only)
