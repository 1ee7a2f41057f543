"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Sizes are words (runs of anything but space and U+0009 to U+000D). Sources in code point order, null
last, have the weights 3, 1, 2, repeating; together they share 150 % of all words. A source's target
stops at twice its size and the excess is shared again by weight: with sources ordered by size over
weight, the level that solves this is the largest (total - caps before) / (weights from here on).

Each source's weight over training time t in [0, 1] is w(t) = 1 + slope * (2t - 1). Its integral is the
cumulative demand: demand(t) = target * ((1 - slope) * t + slope * t * t) words are taken up to t, and all of demand(1) at the end. Within
a source, documents stand in the order of md5(doc_id), an order that no rerun, layout or growth of another source
changes, and are laid end to end on the source's token axis, once for each pass over the source. The inverse of the demand at the
place where a pass over a document begins is its training position, that of every pass, and what has a position before t = 1 is taken:
the sum is the target to the word, only the document on the edge is taken in part. Rows come range-sorted by their first position.

The running sum over a source goes by buckets of the hash, so a source with a third of all rows is
4096 groups, not one. Sources are ranked and summed by ranges, so no task sees all of them however many there are. Texts are read once and never
move in ``mix``.

Defined cases: null text has 0 words; null source is a source of its own; a source without words has target 0; a
document without words is never taken. Rows that repeat a doc_id count as rows of their own. An
empty table gives an empty result. Columns other than doc_id, text and source are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, fingerprint, fresh

WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2
#: Hex digits of the hash that make a bucket: 16 ** 3 of them in each source.
BUCKET_DIGITS = 3


def words(text):
    """How many runs of characters other than white space a text column has."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    empty = F.lit("")
    return (F.size(parts) - (parts[0] == empty).cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == empty)).cast("int")).cast("long")


def _pick(values, rank):
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((rank - 1) % len(values) + 1).cast("int"))


def running(rows: DataFrame, order: list, **sums: str) -> DataFrame:
    """rows in ranges of order, with a number from 1 (place) and each column of sums added up over the rows before (as named); only ranges are summed in one task."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    whole = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows_in"), *[F.sum(c).alias(f"{n}_in") for n, c in sums.items()])
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    before = whole.select("range", *[(F.sum(f"{n}_in").over(ranges) - F.col(f"{n}_in")).alias(f"{n}_before") for n in ("rows", *sums)])
    own = Window.partitionBy("range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "range").withColumn("place", F.row_number().over(own) + F.col("rows_before"))
    return out.withColumns({n: F.sum(c).over(upto) - F.col(c) + F.col(f"{n}_before") for n, c in sums.items()}).drop("range", "rows_before", *[f"{n}_before" for n in sums])


def targets(sources: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size -> also weight, slope, target."""
    ranked = running(sources, ["key"])
    ranked = ranked.withColumn("weight", _pick(weights, F.col("place"))).withColumn("slope", _pick(slopes, F.col("place"))).withColumnRenamed("place", "rank")
    ranked = ranked.withColumn("room", F.col("source_size") * float(most) / F.col("weight"))
    level = cut(running(ranked, ["room", "rank"], size_before="source_size", weight_before="weight").drop("place"))
    size, weight = level.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = F.lit(size * share) - F.col("size_before") * most
    best = level.agg(F.max(left / (F.lit(weight) - F.col("weight_before")))).first()[0]
    capped = F.least(F.col("weight") * F.lit(best), (F.col("source_size") * most).cast("double"))
    return level.select("key", "source_size", "weight", "slope", capped.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias("key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"),
        words(F.col("text").cast("string")).alias("size"),
        fingerprint(F.col("text")).alias("fp"),
    ).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))


def demand(t, target, slope):
    """How many words are taken up to t: the integral of the weight schedule."""
    return target * ((1 - slope) * t + slope * t * t)


def position(offset, target, slope):
    """The t at which the cumulative demand reaches offset; null for a target of 0."""
    u = F.try_divide(offset, target)
    curved = F.try_divide(F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope), 2 * slope)
    return F.when(slope == 0, u).otherwise(curved)


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each row of docs, range-sorted by position: doc_id, size, source_size, target, taken, position (of its first word; null if not
    taken), positions (where each of its passes begins), words (what each pass takes), fp."""
    rows = cut(sized(docs))
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = targets(buckets.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weights, slopes, share, most)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = buckets.withColumn("bucket_start", F.sum("bucket_size").over(before) - F.col("bucket_size")).drop("bucket_size").join(sources, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(placed, ["key", "bucket"]).withColumn("start", F.sum("size").over(inside) - F.col("size") + F.col("bucket_start"))
    # a pass begins at its place on the token axis; of its words those are taken that the demand of the whole training reaches
    begins = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col("start") + F.col("source_size") * k)
    reached = F.floor(demand(F.lit(1.0), F.col("target"), F.col("slope")))
    zero = F.lit(0).cast("long")
    passes = F.transform(begins, lambda b: F.struct(F.greatest(zero, F.least(F.col("size"), F.col("reached") - b)).alias("words"), position(b.cast("double"), F.col("target"), F.col("slope")).alias("at")))
    out = out.withColumn("reached", reached).withColumn("passes", F.filter(passes, lambda p: p["words"] > 0))
    out = out.select("doc_id", "size", "source_size", "target", F.aggregate("passes", zero, lambda n, p: n + p["words"]).alias("taken"), F.get("passes.at", F.lit(0)).alias("position"), F.col("passes.at").alias("positions"), F.col("passes.words").alias("words"), "fp")
    return cut(out).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def schedule(docs: DataFrame, **options) -> DataFrame:
    """The mixed training set itself: rows of docs, as often as they are taken, range-sorted by position.

    Whole documents only: each pass over a document counts if at least half its words are taken, so a source is off its
    target by half a document at most. Rows are matched by doc_id and fingerprint of the text; rows that repeat both share
    one plan.
    """
    whole = F.filter(F.arrays_zip("positions", "words"), lambda p: p["words"] * 2 >= F.col("size"))
    plan = mix(docs, **options).select("doc_id", "fp", F.transform(whole, lambda p: p["positions"]).alias("positions")).where(F.size("positions") > 0).dropDuplicates(["doc_id", "fp"])
    own, at = fresh(docs, "plan"), fresh(docs, "at")
    plan = plan.select(F.struct("doc_id", "fp", "positions").alias(own))
    rows = docs.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}.doc_id")) & (fingerprint(docs["text"]) == F.col(f"{own}.fp")))
    rows = rows.withColumn(at, F.explode(F.col(f"{own}.positions")))
    return rows.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)
