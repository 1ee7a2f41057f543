from decimal import Decimal

import pytest

from tallyframe.operators import aggregates as A
from tallyframe.operators import diff
from tallyframe.operators.pair import TablePair
from tallyframe.plans.pairs import load

KIND = "k long, a decimal(18,6), s string"


def frames(spark, source, target):
    rows = lambda x: [(k, None if a is None else Decimal(a), s) for k, a, s in x]
    return TablePair(spark.createDataFrame(rows(source), KIND), spark.createDataFrame(rows(target), KIND), ("k",))


def reasons(df):
    return sorted((r.k, r.column_name, r.reason) for r in df.collect())


def test_reasons_at_the_tolerance(spark):
    p = frames(spark, [(1, "1.0", "x"), (2, "1.0", "x"), (3, None, "x"), (4, None, None), (5, "1", "x")], [(1, "1.0001", "x"), (2, "1.000101", "y"), (3, "1.0", ""), (4, None, None), (6, "1", "x")])
    assert reasons(diff.row_diff(p)) == [(2, "a", diff.OUT_OF_TOLERANCE), (2, "s", diff.VALUE_MISMATCH), (3, "a", diff.NULL_MISMATCH), (3, "s", diff.VALUE_MISMATCH), (5, None, diff.MISSING), (6, None, diff.EXTRA)]
    assert reasons(diff.row_diff(p, by_column={"A": "0.001"}))[0] == (2, "s", diff.VALUE_MISMATCH)


def test_policies_count_empty_as_null(spark):
    p = frames(spark, [(1, "1", None)], [(1, "1", "")])
    assert reasons(diff.row_diff(p)) == [(1, "s", diff.NULL_MISMATCH)]
    assert reasons(diff.row_diff(p, policy="empty_as_null")) == []


def test_a_table_does_not_differ_from_itself_and_sides_mirror(spark, sf_dir):
    p = load(spark, sf_dir, "orders")
    assert diff.row_diff(TablePair(p.source, p.source, p.keys)).count() == 0
    ahead, back = (diff.sides(TablePair(a, b, p.keys)).collect() for a, b in ((p.source, p.target), (p.target, p.source)))
    turn = {diff.MISSING: diff.EXTRA, diff.EXTRA: diff.MISSING}
    assert {(r.o_orderkey, r.reason) for r in ahead} == {(r.o_orderkey, turn[r.reason]) for r in back}
    assert sorted(r.reason for r in ahead) == [diff.EXTRA, diff.MISSING]  # sf0.001


def test_multiset_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (3,)], "v int")
    assert sorted((r.v, r.reason, r.copies) for r in diff.multiset_diff(TablePair(a, b)).collect()) == [(1, diff.MISSING, 1), (2, diff.MISSING, 1), (3, diff.EXTRA, 1)]


def test_null_keys_meet(spark):
    p = frames(spark, [(None, "1", "x")], [(None, "1", "y")])
    assert reasons(diff.row_diff(p)) == [(None, "s", diff.VALUE_MISMATCH)]


def test_aggregates_tell_columns_apart(spark):
    p = frames(spark, [(1, "1.5", "x"), (2, None, None)], [(1, "1.5", "x"), (2, "0.25", None)])
    got = {(r.column_name, r.metric): (r.source_value, r.target_value, r.match) for r in A.compare_aggregates(p).collect()}
    assert got["a", "sum"] == ("1.500000", "1.750000", False)
    assert got["a", "avg"] == ("1.500000", "0.875000", False)
    assert got["s", "sum"] == (None, None, True) and got["k", "count"] == ("2", "2", True)
    v = A.verdict(A.compare_aggregates(p)).first()
    assert (v.total_columns, v.matched_columns, v.match) == (3, 2, False)
    loose = A.compare_aggregates(p, ["a"], tolerance={"a": "0.7"}).collect()
    assert {r.metric for r in loose if r.match} >= {"sum", "avg"}


def test_empty_tables(spark):
    p = frames(spark, [], [])
    assert A.verdict(A.compare_aggregates(p)).first().match
    assert diff.row_diff(p).count() == 0
    assert A.row_counts(p).first().match


@pytest.mark.parametrize("name, n", [("orders", 1)])
def test_tolerance_of_the_fixture(spark, sf_dir, name, n):
    assert diff.row_diff(load(spark, sf_dir, name)).where(f"reason = '{diff.OUT_OF_TOLERANCE}'").count() == n
