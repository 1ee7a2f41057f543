"""Row hashes and order-free digests of sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.canonical import LOB_PREFIX, row_text

ALGORITHM = "sha256"


def row_hash(df: DataFrame, columns: list[str], policy: str = "distinct", lobs=(), strict: bool = False, prefix: int = LOB_PREFIX) -> Column:
    """Lower-case hex SHA-256 of the row's canonical text in UTF-8."""
    return F.sha2(row_text(df.schema, columns, policy, lobs, strict, prefix), 256)


def list_digest(hashes: Column) -> Column:
    """Aggregate: SHA-256 of the row hashes in order, one after the other. Order of rows doesn't matter, repetition does."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), ""), 256)


def tree_digest(df: DataFrame, hashes: Column, by: list[str], digits: int = 3) -> DataFrame:
    """The same for groups of any size: digests of the 16 ** digits parts of a group by the hashes' first digits, then the digest of those.

    by..., row_count, digest. No task holds more than one part of one group.
    """
    parts = df.withColumn("__h", hashes).groupBy(*by, F.substring("__h", 1, digits).alias("__part")).agg(F.count(F.lit(1)).alias("__n"), list_digest(F.col("__h")).alias("__d"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "__d"))), lambda x: x["__d"]), "")
    return parts.groupBy(*by).agg(F.sum("__n").alias("row_count"), F.sha2(ordered, 256).alias("digest"))
