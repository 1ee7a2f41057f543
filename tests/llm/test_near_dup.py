import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import near_dup as N
from tallyframe.llm.components import components
from tallyframe.llm.shingles import shingle_set, word_hashes
from tests.llm.helpers import WORD, jaccard_components, lower, odd_documents, with_clashing


def variants(seed, groups=12, size=6, words=60, edits=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, words))]
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, words, percent):
    rows = variants(words) + variants(words + 10, 3, 30, 200, 12)[:80]
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(1000, None), (1001, ""), (1002, "w1"), (1003, "W1"), (1004, "w1 w2")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
    assert got == jaccard_components(rows, words, percent)


def test_leaves_of_a_large_cell(spark, monkeypatch):
    """With leaves of four points the blocks, their corners and the pairs between them are all in use."""
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "NODE", 2)
    monkeypatch.setattr(N, "TILE", 3)
    rows = [(k, t) for k, (_, t) in enumerate(variants(4, 3, 40, 80, 14))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == jaccard_components(rows, 3, 80)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(50, 95), st.integers(0, 10**9))
def test_linked_sets_share_a_cell(n, percent, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(percent / 100, 1)], rng.integers(0, 2**64, rng.integers(0, max(1, n // 8) + 1), dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    linked = 100 * both >= percent * (len(a) + len(b) - both) and both
    if linked and len(a) != both or linked and len(b) != both:
        assert len(np.intersect1d(N.cells(a, percent), N.cells(b, percent)))
    if len(a) and len(b):
        p, q = N.counts_of(N.point(a)), N.counts_of(N.point(b))
        g = min(len(p), len(q))
        assert np.minimum(N.folded(p, g), N.folded(q, g)).sum() >= both


def test_shingles_count_what_words_do():
    for text in ("", "a", "A b", "a b c d a b c", "x\x0by\x0cz w", "é É é", "a" * 70_000 + " b c"):
        w = WORD.findall(lower(text))
        assert len(word_hashes(lower(text).encode())) == len(w)
        assert len(shingle_set(text, 3)) == (len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0)
    assert (shingle_set("a b c", 3) == shingle_set("  A\tB\nC ", 3)).all() and (shingle_set("ab c", 2) != shingle_set("a bc", 2)).all()


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 300), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    docs = with_clashing(odd_documents(spark))
    got = N.near_duplicates(docs, 3, 80).collect()
    assert len(got) == docs.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r.component_id)
    assert of[4] == [4] and of[5] == [4, 4] and of[6] == [4] and of[None] == [4] and of[8] == [7] and of[1] == [1] and of[3] == [3]
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r.component_id, r.n_shingles == 0 and r.doc_id) for r in got})
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_tries_join_cells_across_tasks(spark):
    """However the sorted rows are cut into tasks, the pairs to try connect all classes of a cell and no two cells."""
    rng = random.Random(8)
    rows = sorted({(rng.randrange(12) - 6, rng.randrange(1000)) for _ in range(120)})
    for parts in (1, 5, 40, 120):
        members = spark.sparkContext.parallelize(rows, parts).toDF("cell long, cls long")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            pairs = {(r.a, r.b) for r in N.tries(members).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        by_cell = {}
        for cell, cls in rows:
            by_cell.setdefault(cell, []).append(cls)
        for own in by_cell.values():
            for before, cls in zip(own, own[1:], strict=False):
                assert (before, cls) in pairs and (parts > 1 or (own[0], cls) in pairs)
        assert all(any(a in own and b in own for own in by_cell.values()) for a, b in pairs)


def test_no_class_is_tried_with_a_whole_cell():
    """Stretches of HUB classes, however batches cut a cell: all are connected and none stands in many pairs."""
    rows = [(0, k) for k in range(3)] + [(1, 10 + k) for k in range(500)] + [(2, 600), (2, 601)]
    for size in (1, 7, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], names=["cell", "cls"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in N._tries(batches) for r in b.to_pylist()]
        assert sorted(r for r in got if r[0] is not None) == [(0, 0, 2), (2, 600, 601)]
        pairs = {(a, b) for edge, a, b in got if edge is None}
        assert {(k, k + 1) for k in (*range(2), *range(10, 509), 600)} <= pairs
        assert {(10 + k - (k - 1) % N.HUB - 1, 10 + k) for k in range(1, 500)} <= pairs and len(pairs) < 2 * len(rows)
        assert max(Counter(x for p in pairs for x in p).values()) <= N.HUB + 4
