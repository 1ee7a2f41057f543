"""Chunks of a table as a column: every row of either side is in exactly one, and all chunks are one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.canonical import LOB_PREFIX
from tallyframe.functions.hashing import list_digest, row_hash
from tallyframe.operators.pair import TablePair, side_by_side

#: An ordered numbering is split into twice as many ranges as there are shuffle partitions, at least so many, and each is drawn from so many keys.
RANGES, DRAWN = 16, 32
#: Starts of one column up to so many are searched by nested conditions, others in an array.
TREE = 128


def by_width(key: str, size: int) -> Column:
    """Chunks of size consecutive key values, from 0; of rows with the same key in the same chunk on both sides."""
    return F.floor(F.col(key).cast("decimal(38,10)") / F.lit(size)).cast("long")


def whole_key(df: DataFrame, keys: tuple[str, ...]) -> bool:
    kind = df.schema[keys[0]].dataType if len(keys) == 1 else None
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(kind, T.DecimalType) and kind.scale == 0


def strategy(df: DataFrame, keys: tuple[str, ...], force_keyset: bool = False) -> str:
    """between for one whole-number key, else keyset; single without a key."""
    if not keys:
        return "single"
    return "between" if whole_key(df, keys) and not force_keyset else "keyset"


def should_fall_back(mismatches: int, limit: int = 3) -> bool:
    """Whether so many mismatching chunks call for keyset chunks."""
    return mismatches >= limit


@dataclass(frozen=True)
class Ranges:
    """About equal ranges of the keys of a table: where each but the first starts."""

    keys: tuple[str, ...]
    starts: list[tuple]

    @classmethod
    def of(cls, df: DataFrame, keys: tuple[str, ...], ranges: int | None = None) -> Ranges:
        """From the keys whose hash falls in a class of about ranges * DRAWN; one pass over the key columns, and a key that repeats counts once."""
        ranges = ranges or max(RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        known = df.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys))
        every = max(1, known.count() // (ranges * DRAWN))
        drawn = known.where(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).distinct().limit(8 * ranges * DRAWN)
        rows = sorted(tuple(r) for r in drawn.collect())
        if len(rows) < 2 * DRAWN:
            return cls(keys, [])
        return cls(keys, sorted({rows[len(rows) * k // ranges] for k in range(1, ranges)}))

    def place(self, df: DataFrame) -> Column:
        """The number of the range that a row is in, by binary search."""
        if not self.starts:
            return F.lit(0)
        kinds = {k: df.schema[k].dataType for k in self.keys}

        def literal(values):
            parts = [F.lit(v).cast(kinds[k]).alias(k) for v, k in zip(values, self.keys, strict=True)]
            return F.struct(*parts) if len(parts) > 1 else parts[0]

        key = F.struct(*self.keys) if len(self.keys) > 1 else F.col(self.keys[0])
        starts = [literal(s) for s in self.starts]
        if len(self.keys) == 1 and len(starts) <= TREE:  # nested conditions, which are compiled

            def among(lo: int, hi: int) -> Column:
                if lo == hi:
                    return F.lit(lo)
                middle = (lo + hi + 1) // 2
                return F.when(key >= starts[middle - 1], among(middle, hi)).otherwise(among(lo, middle - 1))

            return among(0, len(starts))
        steps, all_ = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))]), F.array(*starts)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(all_, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def numbered(df: DataFrame, keys: tuple[str, ...], name: str = "rn", ranges: Ranges | None = None) -> DataFrame:
    """df with the number of each row (from 0) in key order.

    Rows are numbered within ranges of the key and the sizes of the ranges before are added, so no task sorts the whole table.
    """
    ranges = ranges or Ranges.of(df, keys)
    marked = df.withColumn("__range", ranges.place(df))
    sizes = marked.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return marked.join(F.broadcast(before), "__range").withColumn(name, own - 1 + F.col("__before")).drop("__range", "__before")


def keyset_bounds(df: DataFrame, keys: tuple[str, ...], size: int, ranges: Ranges | None = None) -> DataFrame:
    """chunk_id and the first key of each chunk of size rows, as start_<key>, and of the chunk after, as end_<key> (null at the end)."""
    starts = numbered(df.select(*keys), keys, ranges=ranges).where(F.col("rn") % size == 0).withColumn("chunk_id", (F.col("rn") / size).cast("long"))
    after = starts.select((F.col("chunk_id") - 1).alias("chunk_id"), *[F.col(k).alias(f"end_{k}") for k in keys])
    return starts.select("chunk_id", *[F.col(k).alias(f"start_{k}") for k in keys]).join(after, "chunk_id", "left")


def with_keyset(df: DataFrame, bounds: DataFrame, keys: tuple[str, ...], ranges: Ranges | None = None) -> DataFrame:
    """df with the chunk_id of the half-open range of bounds that its key is in; keys under the first start are in the first."""
    ranges = ranges or Ranges.of(df, keys)
    starts = bounds.select(*[F.col(f"start_{k}").alias(k) for k in keys], F.col("chunk_id").alias("__start"), F.lit(0).alias("__row"))
    starts = starts.withColumn("__range", ranges.place(starts))
    rows = df.withColumn("__start", F.lit(None).cast("long")).withColumn("__row", F.lit(1)).withColumn("__range", ranges.place(df))
    # the last start of the ranges before goes to rows that stand before any start of their own range
    last = starts.groupBy("__range").agg(F.max("__start").alias("__last"))
    seen = df.sparkSession.range(len(ranges.starts) + 1).select(F.col("id").cast("int").alias("__range")).join(last.withColumn("__range", F.col("__range") + 1), "__range", "left")
    carried = seen.select("__range", F.max("__last").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)).alias("__carried"))  # one row a range
    inside = F.last("__start", True).over(Window.partitionBy("__range").orderBy(*keys, "__row").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.unionByName(starts, allowMissingColumns=True).withColumn("__inside", inside).join(F.broadcast(carried), "__range")
    return placed.where("__row = 1").withColumn("chunk_id", F.coalesce("__inside", "__carried", F.lit(0).cast("long"))).drop("__start", "__row", "__range", "__inside", "__carried")


def with_chunks(pair: TablePair, size: int, how: str | None = None) -> TablePair:
    """Both sides with the same chunk_id for the same key; keyset bounds are those of the source, the last chunk is open."""
    how = how or strategy(pair.source, pair.keys)
    if how == "single":
        source, target = (d.withColumn("chunk_id", F.lit(0).cast("long")) for d in (pair.source, pair.target))
    elif how == "between":
        source, target = (d.withColumn("chunk_id", by_width(pair.keys[0], size)) for d in (pair.source, pair.target))
    else:
        ranges = Ranges.of(pair.source, pair.keys)  # drawn once, for the bounds and both sides
        bounds = keyset_bounds(pair.source, pair.keys, size, ranges).persist()
        source, target = (with_keyset(d, bounds, pair.keys, ranges) for d in (pair.source, pair.target))
    return TablePair(source, target, pair.keys, pair.columns)


def digests(df: DataFrame, columns: list[str], by: list[str], policy: str = "distinct", lobs=(), strict: bool = False, prefix: int = LOB_PREFIX) -> DataFrame:
    """by..., row_count, digest of the row hashes. For groups of bounded size; groups of any size take hashing.tree_digest."""
    return df.select(*by, row_hash(df, columns, policy, lobs, strict, prefix).alias("__h")).groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), list_digest(F.col("__h")).alias("digest"))


def compare_digests(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """by..., source_rows, target_rows, source_hash, target_hash, match. Rows whose by is null are a group like any other; one empty on both sides does not occur, and would match."""
    s, t = (d.select(*by, F.col("row_count").alias("rows"), F.col("digest").alias("hash")) for d in (source, target))
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(f"{side}_rows", zero).alias(f"{side}_rows") for side in ("source", "target")]
    return side_by_side(s, t, by, ["rows", "hash"]).select(*by, *counts, "source_hash", "target_hash", F.col("source_hash").eqNullSafe(F.col("target_hash")).alias("match"))


def compare_chunks(pair: TablePair, size: int, how: str | None = None, policy: str = "distinct", columns: list[str] | None = None, lobs=(), strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Digests of all chunks of both sides, joined by chunk (and by further columns such as a partition)."""
    columns = columns or pair.values
    chunked = with_chunks(pair, size, how)
    keys = [*by, "chunk_id"]
    return compare_digests(*(digests(d, columns, keys, policy, lobs, strict) for d in (chunked.source, chunked.target)), keys)


def null_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How many rows have a null in any column of the key."""
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    return df.agg(F.count_if(none).alias("null_key_rows"))


def key_problems(pair: TablePair) -> DataFrame:
    """side, null_key_rows, repeated_keys, rows_of_repeated_keys of both sides: what speaks against the key. One grouping of the key columns a side."""

    def side(df, name):
        none = F.lit(False)
        for k in pair.keys:
            none = none | F.col(k).isNull()
        groups = df.groupBy(*pair.keys).agg(F.count(F.lit(1)).alias("n")).withColumn("none", none)
        counts = [F.coalesce(F.sum(F.when(F.col("none"), F.col("n"))), F.lit(0).cast("long")).alias("null_key_rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0).cast("long")).alias("rows_of_repeated_keys")]
        return groups.agg(*counts).withColumn("side", F.lit(name))

    return side(pair.source, "source").unionByName(side(pair.target, "target")).select("side", "null_key_rows", "repeated_keys", "rows_of_repeated_keys")


def page(df: DataFrame, keys: tuple[str, ...], after: tuple | None, size: int) -> DataFrame:
    """The next size rows in key order after a key: a struct comparison, not an OFFSET."""
    if after is not None:
        last = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        df = df.where(F.struct(*keys) > last)
    return df.orderBy(*keys).limit(size)
