"""Two copies of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TablePair:
    """source and target, the columns that identify a row (none: the table has no key) and those to compare."""

    source: DataFrame
    target: DataFrame
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None

    @property
    def values(self) -> list[str]:
        """The compared columns that are no keys, as the source has them."""
        there = {c.lower() for c in self.target.columns}
        wanted = {c.lower() for c in self.columns} if self.columns else {c.lower() for c in self.source.columns}
        keys = {k.lower() for k in self.keys}
        return [c for c in self.source.columns if c.lower() in wanted & there and c.lower() not in keys]

    @property
    def missing(self) -> list[str]:
        """Columns to compare that the target lacks."""
        there = {c.lower() for c in self.target.columns}
        wanted = {c.lower() for c in (*self.columns, *self.keys)} if self.columns else None
        return [c for c in self.source.columns if c.lower() not in there and (wanted is None or c.lower() in wanted)]

    @property
    def extra(self) -> list[str]:
        """Columns that only the target has, if all are to be compared."""
        here = {c.lower() for c in self.source.columns}
        return [] if self.columns else [c for c in self.target.columns if c.lower() not in here]

    def schema_diff(self) -> DataFrame:
        """column_name, source_type, target_type, reason of the columns that one side lacks. Both must be empty for the tables to be identical."""
        kinds = [{f.name: f.dataType.simpleString() for f in d.schema.fields} for d in (self.source, self.target)]
        rows = [(c, kinds[0][c], None, "missing_in_target") for c in self.missing] + [(c, None, kinds[1][c], "extra_in_target") for c in self.extra]
        return self.source.sparkSession.createDataFrame(rows, "column_name string, source_type string, target_type string, reason string")

    def where(self, predicate: str | None) -> TablePair:
        """Both sides under the same condition; names resolve without regard to case."""
        if not predicate:
            return self
        return TablePair(self.source.where(predicate), self.target.where(predicate), self.keys, self.columns)

    def select(self, *columns: str) -> TablePair:
        names = list(dict.fromkeys([*self.keys, *columns]))
        return TablePair(self.source.select(*names), self.target.select(*names), self.keys, self.columns)


def side_by_side(source: DataFrame, target: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by..., source_<name>, target_<name> of two tables with a row for each by; nulls in by are equal, as they are in a grouping."""

    def marked(df, own, other):
        mine = [F.col(n).alias(f"{own}_{n}") for n in names]
        return df.select(*by, *mine, *[F.lit(None).cast(df.schema[n].dataType).alias(f"{other}_{n}") for n in names], F.lit(own).alias("__side"))

    both = marked(source, "source", "target").unionByName(marked(target, "target", "source"))
    of = lambda side, n: F.max(F.when(F.col("__side") == side, F.col(f"{side}_{n}"))).alias(f"{side}_{n}")
    return both.groupBy(*by).agg(*[of(side, n) for n in names for side in ("source", "target")])
