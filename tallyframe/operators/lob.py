"""Digests of large objects from their lengths and samples of their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.hashing import tree_digest
from tallyframe.operators.pair import TablePair

SAMPLE = 1024


def sampled(c: Column, size: int = SAMPLE, binary: bool = False) -> Column:
    """All of a value up to size characters (bytes), else its first and last size of them."""
    length = F.octet_length(c) if binary else F.length(c)
    ends = F.concat(F.substring(c, 1, size), c.substr(length - size + 1, F.lit(size)))
    return F.when(length <= size, c).otherwise(ends)


def lob_digest(df: DataFrame, column: str, by: tuple[str, ...] = (), size: int = SAMPLE) -> DataFrame:
    """by..., row_count, null_count, total_length, digest (order-free, of the rows' sampled values).

    A change outside both samples that keeps the length is not seen.
    """
    binary = isinstance(df.schema[column].dataType, T.BinaryType)
    c = F.col(column) if binary else F.col(column).cast("string")
    length = (F.octet_length(c) if binary else F.length(c)).cast("long")
    rows = df.select(*by, length.alias("__length"), F.sha2(F.coalesce(sampled(c, size, binary).cast("binary"), F.lit(b"")), 256).alias("__value"), c.isNull().alias("__null"))
    one = [F.sum("__length").alias("total_length"), F.count_if("__null").alias("null_count")]
    sums = rows.groupBy(*by).agg(*one) if by else rows.agg(*one)
    hashed = F.sha2(F.concat_ws(":", F.coalesce(F.col("__length").cast("string"), F.lit("null")), "__value"), 256)
    tree = tree_digest(rows, hashed, list(by))
    if not by:
        sums, tree = (d.withColumn("__one", F.lit(1)) for d in (sums, tree))
    joined = sums.join(tree, list(by) or ["__one"])
    return joined.select(*by, "row_count", "null_count", F.coalesce("total_length", F.lit(0).cast("long")).alias("total_length"), "digest")


def compare_lob(pair: TablePair, column: str, by: tuple[str, ...] = (), size: int = SAMPLE) -> DataFrame:
    """by..., both sides' rows, lengths and digests, match (digest and length agree)."""
    names = ("row_count", "total_length", "digest")
    s, t = (lob_digest(d, column, by, size).select(*by, *[F.col(n).alias(f"{side}_{n}") for n in names]) for d, side in ((pair.source, "source"), (pair.target, "target")))
    if not by:
        s, t = (d.withColumn("__one", F.lit(1)) for d in (s, t))
    both = s.join(t, list(by) or ["__one"], "full_outer")
    match = F.col("source_digest").eqNullSafe(F.col("target_digest")) & F.col("source_total_length").eqNullSafe(F.col("target_total_length"))
    return both.select(*by, *[f"{side}_{n}" for n in names for side in ("source", "target")], match.alias("match"))
