from pyspark.sql import functions as F

from tallyframe.operators import partitions as P


def ranges(spark, rows):
    return spark.createDataFrame(rows, "partition_name string, range_start string, range_end string")


def test_strategy_around_the_limit(spark):
    d = ranges(spark, [("a", None, "2024-01-14"), ("b", None, "2024-01-15 00:00:00"), ("c", None, "2024-01-16"), ("d", None, None), ("e", None, "soon")])
    got = {r.partition_name: r.strategy for r in P.with_strategy(d, "2024-01-15").collect()}
    assert got == {"a": "light", "b": "full", "c": "full", "d": "full", "e": "full"}
    assert {r.strategy for r in P.with_strategy(d, None).collect()} == {"full"}


def test_bounds(spark):
    rows = [("A", "TO_DATE(' 2024-02-01 00:00:00', 'SYYYY-MM-DD HH24:MI:SS', 'NLS_CALENDAR=GREGORIAN')", 1), ("B", "100", 2), ("C", "'x'", 3), ("D", "MAXVALUE", 4)]
    got = P.source_ranges(spark.createDataFrame(rows, "partition_name string, high_value string, partition_position int")).orderBy("position").collect()
    assert [(r.range_start, r.range_end) for r in got] == [(None, "2024-02-01 00:00:00"), ("2024-02-01 00:00:00", "100"), ("100", "x"), ("x", None)]
    rows = [("a", "FOR VALUES FROM ('2024-01-01') TO ('2024-02-01')"), ("b", "FOR VALUES IN ('x', 'y')"), ("c", "DEFAULT")]
    got = {r.partition_name: (r.range_start, r.range_end) for r in P.target_ranges(spark.createDataFrame(rows, "partition_name string, partition_bound string")).collect()}
    assert got == {"a": ("2024-01-01", "2024-02-01"), "b": ("x", "y"), "c": (None, None)}


def test_names_match_without_case_and_source_alone(spark):
    s, t = ranges(spark, [("P1", None, "1"), ("P2", "1", "2")]), ranges(spark, [("p1", "0", "1")])
    assert [(r.partition_name, r.range_start) for r in P.matched(s, t).collect()] == [("p1", "0")]
    assert P.matched(s, None).count() == 2


def test_predicate_quotes():
    assert P.predicate("d", "a'b", "c", "x = 1") == "(x = 1) AND `d` >= 'a''b' AND `d` < 'c'"
    assert P.predicate("d", None, None) == "TRUE"


def test_rows_go_to_numbers_texts_and_lists(spark):
    r = ranges(spark, [("a", None, "10"), ("b", "10", "20.5"), ("c", "20.5", "1000"), ("d", "2000", None)])
    rows = spark.createDataFrame([(x,) for x in (-5, 9, 10, 20, 21, 999, 1000, 1999, 2000, 10**9, None)], "k long")
    got = {x.k: x.partition_name for x in P.assigned(rows, "k", r).collect()}
    assert got == {-5: "a", 9: "a", 10: "b", 20: "b", 21: "c", 999: "c", 1000: None, 1999: None, 2000: "d", 10**9: "d", None: None}
    assert sorted(x.k for x in P.scan(rows, "k", r, "B").collect()) == [10, 20]
    lists = spark.createDataFrame([("x", ["1", "3"], "1", "3"), ("y", ["2"], "2", "2")], "partition_name string, values array<string>, range_start string, range_end string")
    assert {x.k: x.partition_name for x in P.assigned(spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int"), "k", lists).collect()} == {1: "x", 2: "y", 3: "x", 4: None}
    assert {x.k: x.partition_name for x in P.assigned(spark.createDataFrame([("1",), ("2",), ("Z",)], "k string"), "k", lists).collect()} == {"1": "x", "2": "y", "Z": None}
    one = ranges(spark, [("all", None, None)])
    assert {x.partition_name for x in P.assigned(rows.na.drop(), "k", one).collect()} == {"all"}
    assert P.assigned(rows, "k", r.limit(0)).where("partition_name is not null").count() == 0
    assert spark.createDataFrame([("FOR VALUES IN ('x', 'y')",), ("FOR VALUES FROM (1) TO (2)",)], "b string").select(P.listed(F.col("b")).alias("v")).collect() == [(["x", "y"],), (None,)]
