"""Connected components of links by alternating large and small stars; links stay distributed throughout.

Defined cases: links of a node with itself say nothing, a link that is repeated or given both ways counts once, links with a null end are left out,
and without links there are no components. Other columns are ignored.

A round has as many tasks as its links need: up to FEW of them (counted before) the smallest neighbours are broadcast, and LINKS links are a task, as
adaptive coalescing would have it; with more, everything is dealt by node over the shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import cut

MAX_ROUNDS = 60
FEW, LINKS = 250_000, 50_000


def _stars(links: DataFrame, large: bool, tasks: int | None = None) -> DataFrame:
    """One step: every node's neighbours move to the smallest of them. links: a > b, distinct. tasks: of few links."""
    if tasks:
        links = links.coalesce(tasks)
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if tasks:
        least = F.broadcast(least.coalesce(tasks))
    moved = around.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
    out = out.where(F.col("a") != F.col("b")).distinct()
    return out.coalesce(tasks) if tasks else out


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links (a, b), except that the smallest nodes themselves are left out."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        tasks = max(2, -(-state[0] // LINKS)) if state[0] <= FEW else None  # a step makes no more links than it has
        links = cut(_stars(_stars(links, True, tasks), False, tasks))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
