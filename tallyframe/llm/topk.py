"""Exact top-k search by pivot-table elimination.

Vectors are integers (floor(scale * x)), the score is the inner product. With N(v) the squared length, the
score of q and x is (N(q) + N(x) - d(q, x)^2) / 2, and for any pivot p the triangle inequality gives d(q, x) >= |d(q, p) - d(x, p)|. So
the table of distances to PIVOTS pivots gives each pair a maximum lower bound of distance, that is a least
upper bound of score. A query takes candidates in the order of their bounds and stops as soon as the
next bound is below its k-th score: exact, however good the pivots are. Bounds are raised by a
relative 1e-9 against rounding; scores are integer arithmetic.

Pivots are a farthest-first choice from at most SAMPLE vectors (the first by a hash) and every row has its
distances to them in the table. The same sample gives each query a first k-th score, so every block starts with it.

Queries stand against all rows in tiles. Rows go to the cell of their nearest pivot and cells, counted first, are dealt into
blocks of about BLOCK rows by a hash of the row (so equal vectors are split); queries likewise. A block is packed as bytes with the least and
largest distance to each pivot. These intervals bound the scores of a pair of blocks as distances do those of a pair
of rows: pairs that no query's first k-th score allows are dropped before any vector moves. Each pair that is left is a key of
its own, one block against one block of queries, so no task holds more than that and more rows make more tasks.
Each query's k best of a block go on to the merge, at most k a block.

Defined cases: a vector that is null or has a null, NaN or infinite component takes no part. Shorter vectors count as padded
with zeros. Components and scores beyond 64 bits are the nearest number of 64 bits; products are exact before that. Rows that
repeat an id or a vector are rows of their own: each is a query of its own if its id is one, and a query leaves out its own row only. A null id
sorts last among ties and is no query. An empty table gives an empty result. With fewer than k others, all are returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut

SCALE, K = 1024, 10
PIVOTS, SAMPLE = 24, 1024
BLOCK = 4096
NO_ID = 2**63 - 1
LEAST, MOST = -(2**63), 2**63 - 1


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v (array of long), of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return rows.where(sound).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole.alias("v"))


def matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), dtype=np.int64)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to the pivots."""
    a, p = x.astype(np.float64), pivots.astype(np.float64)
    square = (a * a).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * a @ p.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice of n rows of x."""
    if not len(x):
        return x
    chosen = [int((x.astype(np.float64) ** 2).sum(axis=1).argmax())]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id."""
    return np.lexsort((ids, -scores))[:k]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q (a vector, or vectors as columns), exact, then held to 64 bits."""
    if not x.size or not q.size:
        return np.zeros((len(x), *q.shape[1:]), dtype=np.int64)
    largest = max(abs(int(x.max())), abs(int(x.min()))) * max(abs(int(q.max())), abs(int(q.min()))) * x.shape[1]
    if largest <= MOST:
        return x @ q
    return np.clip(x.astype(object) @ q.astype(object), LEAST, MOST).astype(np.int64)


def bound_of(q_norm, x_norm, gap):
    """The most that the score of two rows can be whose distance is at least gap."""
    return (q_norm + x_norm - np.maximum(gap, 0) ** 2) / 2 + 1e-9 * (q_norm + x_norm) + 1e-6


def rounding(table: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """By how much rounding may have moved the distances of rows."""
    return 1e-7 * (table.max(axis=1, initial=0) + np.sqrt(norm))


def search_block(q_rows, q, q_table, floors, x_rows, x_ids, x, x_table, k: int = K):
    """Per query: places in x and scores of its k best, none below its floor (a score that k others are known to reach)."""
    q_norm, x_norm = (q.astype(np.float64) ** 2).sum(axis=1), (x.astype(np.float64) ** 2).sum(axis=1)
    x_short, short = rounding(x_table, x_norm), rounding(q_table, q_norm)
    for i in range(len(q)):
        gap = np.abs(x_table - q_table[i]).max(axis=1) - (x_short + short[i]) if x_table.shape[1] else np.zeros(len(x))
        bound = bound_of(q_norm[i], x_norm, gap)
        order = np.flatnonzero((bound >= floors[i]) & (x_rows != q_rows[i]))
        order = order[np.lexsort((x_ids[order], -bound[order]))]
        held_at, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        threshold = floors[i]
        start, step = 0, 4 * k
        while start < len(order) and bound[order[start]] >= threshold:
            at = order[start : start + step]
            held_at, held = np.append(held_at, at), np.append(held, products(x[at], q[i]))
            keep = best_of(held, x_ids[held_at], k)
            held_at, held = held_at[keep], held[keep]
            if len(held) == k:
                threshold = max(threshold, held[-1])
            start, step = start + step, min(2 * step, 1024)
        ok = held >= floors[i]
        yield held_at[ok], held[ok]


def first_scores(rows: np.ndarray, q: np.ndarray, seed_rows: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows other than its own reach, from the sample; the least number where the sample is too small."""
    if len(seed_rows) <= k:
        return np.full(len(q), LEAST, dtype=np.int64)
    known = products(q, seed.T)
    known[rows[:, None] == seed_rows[None]] = LEAST
    return np.partition(known, -k, axis=1)[:, -k]


_CELLS = "row long, id long, v array<long>, cell int"


def _to_cells(dim: int, pivots: np.ndarray):
    """Rows with the number of their nearest pivot."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = matrix(part.column(2).to_pylist(), dim)
                cell = distances(x, pivots).argmin(axis=1) if len(pivots) else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=["row", "id", "v", "cell"])

    return run


_BLOCKS = "block long, rows binary, ids binary, vectors binary, table binary, floors binary, least binary, most binary, norm double, floor long"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("rows", "ids", "vectors", "table", "floors", "least", "most")), ("norm", pa.float64()), ("floor", pa.int64())])


def _packed(dim: int, pivots: np.ndarray, seed_rows: np.ndarray, seed: np.ndarray, k: int, queries: bool):
    """One row for a block: rows, ids, vectors, pivot distances, first k-th scores (of queries) and what bounds all of them."""

    def run(key, rows):
        number, ids = (np.concatenate([np.asarray(b.column(c), dtype=np.int64) for b in rows.to_batches()]) for c in ("row", "id"))
        x = matrix(rows.column("v").to_pylist(), dim)
        table, norm = distances(x, pivots), (x.astype(np.float64) ** 2).sum(axis=1)
        floors = first_scores(number, x, seed_rows, seed, k) if queries else np.zeros(0, dtype=np.int64)
        short = rounding(table, norm)[:, None]
        least, most = (table - short).min(axis=0), (table + short).max(axis=0)
        packed = [a.tobytes() for a in (number, ids, x, table, floors, least, most)]
        columns = [key[0].as_py(), *packed, float(norm.max()), int(floors.min()) if queries else 0]
        return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(columns, _BLOCKS_ARROW.types, strict=True)], schema=_BLOCKS_ARROW)

    return run


def _dealt(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """rows with a block, and how many blocks there are; cells are as many as pivots."""
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.withColumn("block", F.lit(0).cast("long")), 0
    first, parts, total, room = [], [], 0, 0
    for cell in range(max(counts) + 1):
        n = counts.get(cell, 0)
        if n > room:  # small cells share a block, a large one has its own
            total, room = total + max(1, -(-n // block)), block if n <= block else n
        parts.append(max(1, -(-n // block)))
        first.append(total - parts[-1])
        room = room - n if n <= block else 0
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("cell") + 1)
    return rows.withColumn("block", of(first) + F.pmod(F.xxhash64("row"), of(parts))), total


def _may_meet(batches):
    """(block, q_block) of the pairs of blocks whose intervals leave a score that some query needs."""
    schema = pa.schema([("block", pa.int64()), ("q_block", pa.int64())])
    for batch in batches:
        keep = []
        for r in range(batch.num_rows):
            least, most, q_least, q_most = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64) for c in range(2, 6))
            norm, q_norm, floor = (batch.column(c)[r].as_py() for c in range(6, 9))
            gap = float(np.maximum(least - q_most, q_least - most).max(initial=0))
            keep.append(bool(bound_of(q_norm, norm, gap) >= floor))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 100, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by every."""
    base = cut(integer_vectors(rows, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()))
    dim = base.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    sample = base.orderBy(F.xxhash64("id", "v"), "id", "row").limit(SAMPLE).collect()  # at most SAMPLE rows
    seed_rows, seed = np.array([r.row for r in sample], dtype=np.int64), matrix([r.v for r in sample], dim)
    chosen = choose_pivots(seed, pivots)
    celled = cut(base.select("row", "id", "v").mapInArrow(_to_cells(dim, chosen), _CELLS))
    candidates, n_blocks = _dealt(celled, block)
    queries, n_query = _dealt(celled.where((F.col("id") % every == 0) & (F.col("id") != NO_ID)), block)

    def blocks(dealt, of_queries):
        return cut(dealt.select("block", "row", "id", "v").groupBy("block").applyInArrow(_packed(dim, chosen, seed_rows, seed, k, of_queries), _BLOCKS))

    candidates = blocks(candidates, False)
    queries = blocks(queries, True).select(*[F.col(c).alias(f"q_{c}") for c in _BLOCKS_ARROW.names])
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>") if n else F.array().cast("array<long>"))
    # intervals alone: a few hundred bytes a block
    one = candidates.select("block", "least", "most", "norm", every_of(n_query).alias("q_block"))
    two = queries.select("q_block", "q_least", "q_most", "q_norm", "q_floor", every_of(n_blocks).alias("block"))
    met = one.join(two, ["block", "q_block"]).select("block", "q_block", "least", "most", "q_least", "q_most", "norm", "q_norm", "q_floor").mapInArrow(_may_meet, "block long, q_block long")
    met = cut(met)
    x = candidates.select("block", "rows", "ids", "vectors", "table").join(met, "block")
    y = queries.select("q_block", "q_rows", "q_ids", "q_vectors", "q_table", "q_floors").join(met, "q_block")
    pairs = x.join(y, ["block", "q_block"])
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                data = [batch.column(c)[r].as_buffer() for c in range(9)]
                x_rows, x_ids, q_rows, q_ids, floors = (np.frombuffer(data[c], np.int64) for c in (0, 1, 4, 5, 8))
                x, q = (np.frombuffer(data[c], np.int64).reshape(n, dim) for c, n in ((2, len(x_ids)), (6, len(q_ids))))
                x_table, q_table = (np.frombuffer(data[c], np.float64).reshape(n, len(chosen)) for c, n in ((3, len(x_ids)), (7, len(q_ids))))
                found = list(search_block(q_rows, q, q_table, floors, x_rows, x_ids, x, x_table, k))
                times = [len(at) for at, _ in found]
                if sum(times):
                    columns = [np.repeat(q_rows, times), np.repeat(q_ids, times), np.concatenate([x_ids[at] for at, _ in found]), np.concatenate([s for _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = pairs.select("rows", "ids", "vectors", "table", "q_rows", "q_ids", "q_vectors", "q_table", "q_floors").mapInArrow(search, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
