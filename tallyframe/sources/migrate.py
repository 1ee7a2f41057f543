"""Copies of tables, verified afterwards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.hashing import row_hash, tree_digest
from tallyframe.operators.aggregates import compare_aggregates, numeric, row_counts
from tallyframe.operators.pair import TablePair


@dataclass(frozen=True)
class Verification:
    source_rows: int
    target_rows: int
    counts_match: bool
    hashes_match: bool | None
    aggregates_match: bool | None

    @property
    def match(self) -> bool:
        return bool(self.counts_match and self.hashes_match and self.aggregates_match)


def whole_table_digests(pair: TablePair) -> DataFrame:
    """source_rows, target_rows, source_hash, target_hash, match of the two tables as a whole, at any size."""
    columns = [*pair.keys, *pair.values]

    def side(df, name):
        return tree_digest(df.select(*columns), row_hash(df, columns), []).select(F.col("row_count").alias(f"{name}_rows"), F.col("digest").alias(f"{name}_hash"), F.lit(1).alias("one"))

    both = side(pair.source, "source").join(side(pair.target, "target"), "one", "full_outer")
    zero = F.lit(0).cast("long")
    return both.select(F.coalesce("source_rows", zero).alias("source_rows"), F.coalesce("target_rows", zero).alias("target_rows"), "source_hash", "target_hash", F.col("source_hash").eqNullSafe(F.col("target_hash")).alias("match"))


def verify(pair: TablePair) -> Verification:
    """Row counts, then if they agree the digest of the whole tables, then the numeric columns' aggregates."""
    counts = row_counts(pair).first()
    if not counts.match:
        return Verification(counts.source_rows, counts.target_rows, False, None, None)
    hashes = whole_table_digests(pair).first()
    numbers = [c for c in (*pair.keys, *pair.values) if numeric(pair.source.schema[c].dataType)]
    same = compare_aggregates(pair, numbers).agg(F.coalesce(F.bool_and("match"), F.lit(True)).alias("m")).first().m if numbers else True
    return Verification(counts.source_rows, counts.target_rows, True, bool(hashes is None or hashes.match), bool(same))


def migrate(source: DataFrame, write: Callable[[DataFrame, str], None], read: Callable[[], DataFrame], keys: tuple[str, ...] = (), truncate: bool = False) -> Verification:
    """Write source (mode overwrite if truncate, else append; also if it has no rows, so nothing stale stays), read the target again and verify."""
    write(source, "overwrite" if truncate else "append")
    return verify(TablePair(source, read(), keys))
