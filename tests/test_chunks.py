import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions.hashing import row_hash, tree_digest
from tallyframe.operators import chunks as K
from tallyframe.operators.pair import TablePair
from tallyframe.plans.pairs import load

FEW = settings(max_examples=5, deadline=None)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


@FEW
@given(st.lists(st.tuples(st.integers(-50, 50), st.sampled_from(["a", "b", "", None])), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_digest_is_free_of_order_and_sees_changes(spark, rows, rng):
    other = rows[:]
    rng.shuffle(other)

    def digest(x):
        d = frame(spark, x)
        return tree_digest(d, row_hash(d, ["k", "v"]), []).first().digest

    assert digest(rows) == digest(other)
    assert digest(rows) != digest([*rows, rows[0]])
    assert digest(rows) != digest([(rows[0][0] + 1000, rows[0][1]), *rows[1:]])


@pytest.mark.parametrize("how", ["between", "keyset"])
def test_each_key_is_in_one_chunk_on_both_sides(spark, how):
    rng = random.Random(3)
    s = frame(spark, [(k, "x") for k in rng.sample(range(-500, 3000), 900)])
    t = frame(spark, [(k, "x") for k in rng.sample(range(-800, 3200), 900)])
    pair = K.with_chunks(TablePair(s, t, ("k",)), 50, how)
    a, b = ({r.k: r.chunk_id for r in d.collect()} for d in (pair.source, pair.target))
    assert len(a) == len(b) == 900
    assert all(a[k] == b[k] for k in a.keys() & b.keys())
    if how == "keyset":
        sizes = {}
        for c in a.values():
            sizes[c] = sizes.get(c, 0) + 1
        assert set(sizes.values()) == {50}
        assert [a[k] for k in sorted(a)] == sorted(a.values())


def test_composite_bounds_are_half_open(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").source
    rows = K.keyset_bounds(c, ("conv_id", "turn"), 20).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert all((a.end_conv_id, a.end_turn) == (b.start_conv_id, b.start_turn) for a, b in zip(rows, rows[1:], strict=False))
    assert rows[-1].end_conv_id is None


def test_orders_fixture(spark, sf_dir):
    found = K.compare_chunks(load(spark, sf_dir, "orders"), 1000)
    counts = {r.match: r.n for r in found.groupBy("match").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {True: 1, False: 2}  # sf0.001


def test_empty_sides(spark):
    none = frame(spark, []).limit(0)
    some = frame(spark, [(1, "a")])
    for how in ("between", "keyset", "single"):
        assert K.compare_chunks(TablePair(none, none, ("k",)), 10, how).count() == 0
        r = K.compare_chunks(TablePair(some, none, ("k",)), 10, how).collect()
        assert len(r) == 1 and not r[0].match and r[0].target_rows == 0


def test_strategy(spark):
    d = frame(spark, [(1, "a")])
    assert K.strategy(d, ("k",)) == "between" and K.strategy(d, ("v",)) == "keyset" and K.strategy(d, ("k", "v")) == "keyset" and K.strategy(d, ()) == "single"
    assert K.should_fall_back(3) and not K.should_fall_back(2)


def test_page_goes_on_after_a_key(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").source
    first = K.page(c, ("conv_id", "turn"), None, 7).collect()
    second = K.page(c, ("conv_id", "turn"), (first[-1].conv_id, first[-1].turn), 7).collect()
    assert [(r.conv_id, r.turn) for r in first + second] == [(r.conv_id, r.turn) for r in c.orderBy("conv_id", "turn").limit(14).collect()]
