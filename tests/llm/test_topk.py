import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import topk as T

KIND = "vec_id long, embedding array<float>"


def whole(x):
    return max(-(2**63), min(2**63 - 1, int(np.floor(1024 * float(np.float32(x))))))


def brute(rows, k=10, every=100):
    """One list of (rank, vec_id, score) for each query row; the lists sorted by id and content."""
    sound = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(sound):
        if q is not None and q % every == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), i is None, i or 0) for j, (i, w) in enumerate(sound) if j != at]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, dim, same", [(1500, 16, 0.0), (600, 8, 0.5), (5, 3, 0.0)])
def test_equals_brute_force_with_ties(spark, n, dim, same):
    rng = np.random.default_rng(n)
    hot = rng.normal(0, 0.2, dim)
    rows = [(k, [float(x) for x in (hot if rng.random() < same else rng.normal(0, 0.2, dim))]) for k in range(n)]
    assert found(T.top_k(spark.createDataFrame(rows, KIND), block=64)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (100, [-1.0, -2.0]), (200, None)]
    rows.append((None, [0.5, 0.5]))
    d = spark.createDataFrame(rows, KIND)
    assert found(T.top_k(d)) == brute(rows)
    assert T.top_k(d.limit(0)).count() == 0


def test_repeated_rows_huge_values_and_other_columns(spark):
    huge = 1e30
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (100, [huge, 1.0]), (101, [-huge, 1.0]), (102, [huge, huge]), (103, [2.0, huge])]
    rows += [(200 + k, [0.1, 0.1]) for k in range(30)]
    d = spark.createDataFrame(rows, KIND)
    for name in ("row", "id", "v", "cell", "block", "q_block", "score", "rank", "query_id"):
        d = d.withColumn(name, F.lit("clash"))
    assert found(T.top_k(d, block=8)) == brute(rows)


def test_pairs_of_blocks_far_apart_are_dropped(spark):
    rng = np.random.default_rng(2)
    centres = np.concatenate([np.eye(8), -np.eye(8)]) * 1000
    x = np.concatenate([c + rng.normal(0, 20, (200, 8)) for c in centres]).astype(np.int64)
    table, norm = T.distances(x, centres.astype(np.int64)), (x.astype(float) ** 2).sum(axis=1)
    blocks = [(k, table[s].min(axis=0), table[s].max(axis=0), norm[s].max(), min(np.sort(x[s] @ q)[-11] for q in x[s])) for k in range(16) for s in [slice(200 * k, 200 * k + 200)]]
    columns = zip(*[(a, b, *(v.tobytes() for v in (lo, hi, q_lo, q_hi)), n, q_n, f) for a, lo, hi, n, _ in blocks for b, q_lo, q_hi, q_n, f in blocks], strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefghi"))
    left = {tuple(p.values()) for b in T._may_meet([batch]) for p in b.to_pylist()}
    best = {(a, b) for b in range(16) for q in x[200 * b : 200 * b + 200] for a in np.argsort(-(x @ q))[:11] // 200}
    assert best <= left and len(left) < 60  # of 256 pairs
    rows = [(k, [float(c) / 1024 for c in v]) for k, v in enumerate(x)]
    assert found(T.top_k(spark.createDataFrame(rows, KIND), block=64, pivots=16)) == brute(rows)


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 300, (6, 16))
    x = (centre[rng.integers(0, 6, 3000)] + rng.normal(0, 20, (3000, 16))).astype(np.int64)
    pivots = T.choose_pivots(x[:500])
    table = T.distances(x, pivots)
    bound = (x[0].astype(float) @ x[0] + (x * x).sum(axis=1) - np.abs(table - table[0]).max(axis=1) ** 2) / 2
    scores = x @ x[0]
    assert (bound >= scores - 1e-3).all()
    assert (bound >= np.sort(scores)[-11]).sum() < len(x) / 2
