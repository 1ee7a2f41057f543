import json
from datetime import datetime
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tallyframe import cli, config
from tallyframe.operators import ddl, lob
from tallyframe.operators.pair import TablePair
from tallyframe.plans import report
from tallyframe.plans.engine import Engine, with_fallback
from tallyframe.plans.pairs import load
from tallyframe.sources import catalog, dictionary, migrate, tables
from tallyframe.streaming import closed_partitions

DERBY = config.Connection(url="jdbc:derby:memory:tally;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


def settings(**more):
    return config.settings_of({"validation": {"chunk_size": 1000, **more}}, {"s": {"orders": {"pk_columns": ["O_ORDERKEY"]}, "events": {"pk_columns": ["event_id"], "validation_mode": {"partition_aware": {"partition_key": "ts", "immutable_before": "2024-01-15"}}}}})


def test_orders_end_to_end(spark, sf_dir, tmp_path):
    p = load(spark, sf_dir, "orders")
    out = Engine(settings()).validate("S", "ORDERS", p.source, p.target, types=True)
    run, aggregates = out.reports()
    assert (run["total_chunks"], run["matched_chunks"]) == (3, 1) and not out.identical
    assert run["mismatch_details"] and not aggregates["summary"]["match"]
    files = out.save(str(tmp_path), datetime(2026, 1, 2, 3, 4, 5))
    assert [f.rsplit("/", 1)[1] for f in files] == ["S_ORDERS_20260102_030405.json", "S_ORDERS_aggregate_20260102_030405.json", "S_ORDERS_summary_20260102_030405.txt", "S_ORDERS_ddl_20260102_030405.sql", "S_ORDERS_ddl_20260102_030405.json"]
    assert json.load(open(files[0]))["match_rate"] == pytest.approx(1 / 3)
    assert "NOT identical" in open(files[2]).read() and open(files[3]).read().startswith("-- Type changes")


def test_same_table_is_identical(spark, sf_dir):
    p = load(spark, sf_dir, "orders")
    assert Engine(settings()).validate("s", "orders", p.source, p.source).identical
    assert Engine(settings()).validate("s", "other", p.source, p.source).identical  # no key
    out = Engine(settings()).validate("s", "other", p.source, p.target)
    assert not out.identical
    out.release()


def test_partitions_and_light_ones(spark, sf_dir):
    p = load(spark, sf_dir, "events")
    days = p.source.select(F.to_date("ts").alias("d")).distinct()
    ranges = days.select(F.date_format("d", "'p'yyyyMMdd").alias("partition_name"), F.col("d").cast("string").alias("range_start"), F.date_add("d", 1).cast("string").alias("range_end"))
    out = Engine(settings()).validate("s", "events", p.source, p.target, partitions=ranges)
    run, _ = out.reports()
    summary = run["partition_summary"]
    assert summary["total_partitions"] == 30 and summary["failed"] >= 0
    assert sum(r["rows"] for r in summary["partition_results"]) == p.source.count()


def test_a_column_that_one_side_lacks_is_no_match(spark):
    s = spark.createDataFrame([(1, "a", 2)], "k long, v string, w int")
    out = Engine().validate("s", "t", s, s.drop("w"), pk=("k",))
    assert not out.identical and out.reports()[0]["column_mismatches"] == [{"column_name": "w", "source_type": "int", "target_type": None, "reason": "missing_in_target"}]
    assert not Engine().validate("s", "t", s.drop("w"), s, pk=("k",)).identical
    assert Engine().validate("s", "t", s, s.drop("w"), pk=("k",), columns=("v",)).identical
    with pytest.raises(ValueError):
        Engine().validate("s", "t", s, s, pk=("k",), columns=("v", "none"))
    with pytest.raises(ValueError):
        Engine().validate("s", "t", s, s.drop("k"), pk=("k",))


def test_null_and_repeated_keys(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "k long, v string")
    for how in (False, True):
        out = Engine().validate("s", "t", s, s, pk=("k",), force_keyset=how)
        assert out.identical and out.reports()[0]["mismatch_details"] == []
        assert out.reports()[0]["key_problems"][0] == {"side": "source", "null_key_rows": 2, "repeated_keys": 2, "rows_of_repeated_keys": 5}
    assert Engine().full_compare("s", "t", s, s, ("k",)).count() == 0
    less = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (None, "d"), (None, "d")], "k long, v string")
    found = sorted((r.k, r.column_name, r.reason) for r in Engine().full_compare("s", "t", s, less, ("k",)).collect())
    assert found == [(1, None, "missing_in_target"), (2, "v", "value_mismatch")]
    assert not Engine().validate("s", "t", s, less, pk=("k",)).identical


def test_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    kind = "k long, d double, w decimal(38,18), n decimal(38,0)"
    rows = [(1, 1.0, Decimal("1e9"), Decimal(10) ** 37), (2, nan, Decimal("2e9"), Decimal(1)), (3, 1e33, None, None)]
    s = spark.createDataFrame(rows, kind)
    assert Engine().validate("s", "t", s, s, pk=("k",)).identical
    other = spark.createDataFrame([(1, 1.0, Decimal("1e9"), Decimal(10) ** 37), (2, inf, Decimal("2e9"), Decimal(1)), (3, 1e33, None, None)], kind)
    assert not Engine().validate("s", "t", s, other, pk=("k",)).identical


def test_large_objects_are_compared_by_samples(spark):
    s = spark.createDataFrame([(k, "x" * 3000 + str(k)) for k in range(20)], "k long, text string")
    end = s.withColumn("text", F.when(F.col("k") == 7, F.concat(F.col("text").substr(1, 2000), F.lit("y" * 1001))).otherwise(F.col("text")))
    assert Engine().validate("s", "t", s, s, pk=("k",), lobs=("text",)).identical
    out = Engine().validate("s", "t", s, end, pk=("k",), lobs=("text",))
    assert out.reports()[0]["match_rate"] == 1.0 and [x["column_name"] for x in out.reports()[0]["lob_mismatches"]] == ["text"] and not out.identical
    # with a longer prefix the chunks see it too
    assert Engine(settings(lob_prefix=2500)).validate("s", "t", s, end, pk=("k",), lobs=("text",)).reports()[0]["match_rate"] < 1


def test_light_partitions_get_no_drill_down(spark):
    """A chunk that stands in a light and in a full partition, both with a difference; and a row in no partition."""
    rows = [(k, k % 3, "a") for k in range(30)]
    s = spark.createDataFrame(rows, "k long, part int, v string")
    t = s.withColumn("v", F.when(F.col("k").isin(3, 4, 5), F.lit("b")).otherwise(F.col("v")))
    ranges = spark.createDataFrame([("P0", None, "1"), ("P1", "1", "2")], "partition_name string, range_start string, range_end string")
    own = config.settings_of({"validation": {"chunk_size": 1000}}, {"s": {"t": {"pk_columns": ["k"], "validation_mode": {"partition_aware": {"partition_key": "part"}}}}})
    assert {(r.k, r.partition_name) for r in Engine(own).validate("s", "t", s, t, partitions=ranges).differences.collect()} == {(3, "P0"), (4, "P1"), (5, None)}
    light = ranges.withColumn("range_end", F.when(F.col("partition_name") == "P0", F.lit("2023-01-01")).otherwise(F.col("range_end")))
    days = s.withColumn("part", F.when(F.col("part") == 0, F.lit("2022-06-01")).when(F.col("part") == 1, F.lit("2024-06-01")).cast("timestamp_ntz"))
    late = t.withColumn("part", F.when(F.col("part") == 0, F.lit("2022-06-01")).when(F.col("part") == 1, F.lit("2024-06-01")).cast("timestamp_ntz"))
    by_time = spark.createDataFrame([("P0", None, "2023-01-01"), ("P1", "2023-01-01", None)], light.schema)
    own = config.settings_of({"validation": {"chunk_size": 1000, "immutable_before": "2024-01-15"}}, {"s": {"t": {"pk_columns": ["k"], "validation_mode": {"partition_aware": {"partition_key": "part"}}}}})
    out = Engine(own).validate("s", "t", days, late, partitions=by_time)
    assert {(r.k, r.partition_name) for r in out.differences.collect()} == {(4, "P1"), (5, None)}
    got = {r["partition_name"]: (r["strategy"], r["status"], r["hash_status"], r["drilldown_status"], r["checks"]) for r in out.reports()[0]["partition_summary"]["partition_results"]}
    assert got == {"P0": ("light", "FAILED", "mismatch", "skipped", ""), "P1": ("full", "FAILED", "mismatch", "limited", "drilldown"), None: (None, "FAILED", "mismatch", "limited", "drilldown")}


def test_no_chunk_is_an_error(spark):
    none = spark.createDataFrame([], "k long, v string")
    run = report.run_summary(Engine().validate("s", "t", none, none, pk=("k",)).chunks)
    assert run["error_chunks"] == 1 and not report.final_verdict(run)


def test_fallback_goes_to_equal_chunks(spark):
    s = spark.range(0, 5000).withColumn("v", F.lit("a"))
    out = with_fallback(Engine(settings()), "s", "t", s, s.where("id % 7 <> 0"), pk=("id",))
    assert out.chunks.count() == 5


def test_unknown_key_is_refused(spark):
    s = spark.range(3)
    with pytest.raises(ValueError):
        Engine().validate("s", "t", s, s, pk=("none",))


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SECRET", "x")
    (tmp_path / "c.yaml").write_text("source: {url: 'jdbc:a', password: '${SECRET}', user: '${NOBODY:-me}'}\nvalidation: {chunk_size: '500', force_keyset: 'yes', chunk_size_by_pattern: {'A.%LOG': 7}}\n")
    got = config.load(str(tmp_path / "c.yaml"))
    assert got.source.password == "x" and got.source.user == "me" and got.validation.force_keyset
    assert got.validation.size_for("a.big_log") == 7 and got.validation.size_for("a.b") == 500
    assert config.profile_of({"validation_mode": "all"}).all_columns and config.truth("on") and not config.truth("no")
    with pytest.raises(ValueError):
        config.Validation(null_empty_policy="other")


def test_keys(spark):
    rows = [("T", "P", "pk", "B", 2), ("T", "P", "pk", "A", 1), ("T", "R", "fk", "A", 1), ("T", "R", "fk2", "A", 1)]
    got = catalog.KeyRegistry.from_constraints(spark.createDataFrame(rows, "table_name string, constraint_type string, constraint_name string, column_name string, position int"))
    assert got.pk("t") == ("a", "b") and got.fk("T") == ("a",) and got.composite("t") and got.pk("t", explicit=("z",)) == ("z",)


def test_jdbc_round_trip(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    write = lambda d, mode: tables.write_jdbc(d, DERBY, "PART_COPY", mode=mode)
    done = migrate.migrate(part, write, lambda: tables.read_jdbc(spark, DERBY, "PART_COPY", key="p_partkey", partitions=4), ("p_partkey",), truncate=True)
    assert done.match and done.source_rows == part.count()
    assert tables.read_jdbc(spark, DERBY, "PART_COPY", predicates=['"p_partkey" < 10', '"p_partkey" >= 10']).rdd.getNumPartitions() == 2
    assert tables.read_jdbc(spark, DERBY, query='SELECT COUNT(*) AS N FROM PART_COPY').first()[0] == part.count()
    tables.write_jdbc(part.limit(3), DERBY, "PART_COPY", truncate=True)
    assert tables.read_jdbc(spark, DERBY, "PART_COPY").count() == 3
    assert tables.jdbc_self_test(spark, DERBY, "SELECT 1 AS ONE FROM SYSIBM.SYSDUMMY1")


def test_migration_of_nothing_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    some = spark.range(3)
    some.write.parquet(path)
    done = migrate.migrate(some.limit(0), lambda d, mode: d.write.mode(mode).parquet(path), lambda: spark.read.parquet(path), truncate=True)
    assert done.target_rows == 0 and done.match


@pytest.mark.parametrize("fmt", tables.FORMATS)
def test_files(spark, tmp_path, fmt):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    tables.write_files(d, str(tmp_path / fmt), fmt)
    assert sorted(tables.read_files(spark, str(tmp_path / fmt), fmt, "k long, v string").collect()) == sorted(d.collect())


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS one")
    spark.sql("CREATE DATABASE IF NOT EXISTS two")
    spark.range(3).withColumn("p", F.lit(1)).write.mode("overwrite").partitionBy("p").saveAsTable("one.a")
    spark.range(3).write.mode("overwrite").saveAsTable("one.b")
    spark.range(3).withColumn("p", F.lit(1)).write.mode("overwrite").saveAsTable("two.a")
    assert catalog.matching_tables(spark, "one", "two") == (["a"], ["b"])
    assert catalog.is_partitioned(spark, "one.a") and not catalog.is_partitioned(spark, "one.b") and catalog.table_bytes(spark, "one.b") > 0
    assert cli.main(["schema", "one", "two"], spark) == 0
    assert catalog.tables_like(spark, "one", "%A%") == ["a"] and catalog.tables_like(spark, "one", "_") == ["a", "b"]
    assert catalog.duplicate_keys(spark.table("one.a"), ("p",)).first().n == 3
    for d in ("one", "two"):
        spark.sql(f"DROP DATABASE {d} CASCADE")


def test_cli(spark, sf_dir, tmp_path, capsys):
    part = f"parquet:{sf_dir}/part.parquet"
    assert cli.main(["validate", part, part, "--table", "s.part", "--pk", "p_partkey", "--reports", str(tmp_path)], spark) == 0
    assert cli.main(["types", part, part, "--table", "s.part", "--pk", "p_partkey"], spark) == 0
    assert cli.main(["ddl", part, "--table", "s.part", "--pk", "p_partkey"], spark) == 0
    assert cli.main(["migrate", part, f"parquet:{tmp_path}/copy", "--pk", "p_partkey", "--truncate"], spark) == 0
    assert cli.main(["selftest"], spark) == 0
    said = capsys.readouterr().out
    assert "VERDICT: identical" in said and 'CREATE TABLE IF NOT EXISTS "s"."part"' in said and "match" in said


def test_tables_keys_and_statements_over_jdbc(spark, tmp_path, capsys):
    run = [
        'CREATE SCHEMA "shop"', 'CREATE TABLE "shop"."parent" ("id" VARCHAR(10) NOT NULL PRIMARY KEY, "n" NUMERIC(9,0))',
        'CREATE TABLE "shop"."child" ("a" INTEGER NOT NULL, "b" VARCHAR(10) NOT NULL, "v" NUMERIC(8,2), PRIMARY KEY ("b", "a"), FOREIGN KEY ("b") REFERENCES "shop"."parent" ("id"))',
        *[f"INSERT INTO \"shop\".\"parent\" VALUES ('k{k}', {k})" for k in range(9)], *[f"INSERT INTO \"shop\".\"child\" VALUES ({k % 7}, 'k{k % 9}', {k}.25)" for k in range(50)],
    ]
    assert dictionary.execute(spark, DERBY, run) == len(run)
    with pytest.raises(Py4JJavaError):
        dictionary.execute(spark, DERBY, ["INSERT INTO \"shop\".\"parent\" VALUES ('gone', 1)", "INSERT INTO nowhere VALUES (1)"])
    assert dictionary.tables(spark, DERBY, "SHOP") == ["child", "parent"] and dictionary.exists(spark, DERBY, "shop", "CHILD") and not dictionary.exists(spark, DERBY, "none", "child")
    found = dictionary.keys(spark, DERBY, "shop")
    assert found.pk("child") == ("b", "a") and found.fk("child") == ("b",) and set(found.indexed("child")) == {"a", "b"}
    rows = {r.column_name: r for r in dictionary.columns(spark, DERBY, "shop", "child").collect()}
    assert (rows["v"].data_type, rows["v"].data_precision, rows["v"].data_scale, rows["v"].nullable, rows["a"].nullable) == ("NUMBER", 8, 2, "Y", "N")
    # keys of text and of several columns cut the table into parts that hold each row once
    child = tables.read_jdbc(spark, DERBY, '"shop"."child"', key=("b", "a"), partitions=4)
    assert child.rdd.getNumPartitions() == 4 and child.count() == 50 and child.distinct().count() == 50
    parent = tables.read_jdbc(spark, DERBY, '"shop"."parent"', key="id", partitions=3)
    assert parent.rdd.getNumPartitions() == 3 and sorted(r.n for r in parent.collect()) == list(range(9))  # the failed transaction left nothing
    side = f"{{url: '{DERBY.url}', driver: '{DERBY.driver}'}}"
    (tmp_path / "c.yaml").write_text(f"source: {side}\ntarget: {side}\nmigration: {{batch_size: 7, target_schema: copy}}\n")
    at = ["--config", str(tmp_path / "c.yaml")]
    assert cli.main([*at, "tables", "jdbc:shop"], spark) == 0
    number = "(SELECT \"a\", \"b\", \"v\" FROM \"shop\".\"child\") x"
    frame = tables.read_jdbc(spark, DERBY, number).select("a", "v")
    made = dictionary.create(spark, DERBY, ddl.dictionary(frame, "copy", "child"), "copy", "child", ("a",))
    assert made[0] == 'CREATE SCHEMA "copy"' and len(made) == 3 and dictionary.create(spark, DERBY, ddl.dictionary(frame, "copy", "child"), "copy", "child") == []
    assert dictionary.keys(spark, DERBY, "copy").pk("child") == ("a",)
    assert len(dictionary.create(spark, DERBY, ddl.dictionary(frame, "copy", "child"), "copy", "child", (), drop=True)) == 2
    assert cli.main([*at, "schema", "jdbc:shop", "jdbc:shop"], spark) == 0
    assert cli.main([*at, "schema", "jdbc:shop", "jdbc:copy"], spark) == 1
    assert cli.main([*at, "verify", 'jdbc:"shop"."child"', 'jdbc:"shop"."child"'], spark) == 0
    assert cli.main([*at, "types", 'jdbc:"shop"."child"', "jdbc:nowhere.child", "--table", "copy.child"], spark) == 0
    (tmp_path / "s.sql").write_text("BEGIN;\n-- a; comment\nCREATE TABLE \"copy\".\"t\" (\"x\" VARCHAR(9));\nINSERT INTO \"copy\".\"t\" VALUES ('a;b');\nCOMMIT;\n-- ROLLBACK;\n")
    assert cli.main([*at, "apply", str(tmp_path / "s.sql")], spark) == 0
    assert tables.read_jdbc(spark, DERBY, '"copy"."t"').first().x == "a;b"
    said = capsys.readouterr().out
    assert "child: identical" in said and "parent: not in jdbc:copy" in said and "a: INTEGER" not in said and "v: NUMBER(8,2) -> NUMERIC(8,2)" in said and "2 statements ran" in said


def test_verify_and_create_by_the_command_line(spark, sf_dir, tmp_path):
    part = f"parquet:{sf_dir}/part.parquet"
    assert cli.main(["verify", part, part, "--pk", "p_partkey"], spark) == 0
    spark.read.parquet(f"{sf_dir}/part.parquet").drop("p_size").write.parquet(str(tmp_path / "less"))
    assert cli.main(["verify", part, f"parquet:{tmp_path}/less", "--pk", "p_partkey"], spark) == 1
    assert cli.main(["validate", part, f"parquet:{tmp_path}/less", "--pk", "p_partkey", "--reports", str(tmp_path / "r"), "--frames", str(tmp_path / "f")], spark) == 1
    assert any("aggregates" in x.name for x in (tmp_path / "f").iterdir())
    assert cli.main(["ddl", part, "--table", "s.part", "--pk", "p_partkey", "--create", "made.part", "--drop"], spark) == 0
    assert catalog.table_key(spark, "made.part") == ("p_partkey",)
    assert cli.main(["validate", part, "made.nothing", "--table", "s.part"], spark) == 1
    spark.sql("DROP DATABASE made CASCADE")


def test_lob_sample_does_not_see_the_middle(spark):
    a = spark.createDataFrame([("x" * 3000,), ("short",), (None,), ("",)], "t string")
    inside = a.withColumn("t", F.when(F.length("t") > 100, F.concat(F.substring("t", 1, 1500), F.lit("#"), F.substring("t", 1502, 3000))).otherwise(F.col("t")))
    ends = a.withColumn("t", F.when(F.length("t") > 100, F.concat(F.lit("#"), F.substring("t", 2, 3000))).otherwise(F.col("t")))
    same = lambda b: lob.compare_lob(TablePair(a, b), "t").first().match
    assert same(a) and same(inside) and not same(ends) and not same(a.where("t is not null"))


def test_streamed_windows_equal_those_of_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = []
    q = closed_partitions.on_closed(closed_partitions.additive_digests(stream, "ts", ["event_id", "user_id"]), lambda d, _: got.extend(d.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = closed_partitions.additive_digests(events, "ts", ["event_id", "user_id"])
    closed = spark.createDataFrame(got, batch.schema)
    compared = closed_partitions.compare_windows(batch, closed).where("target_rows is not null")
    assert compared.count() >= 28 and compared.where("not match").count() == 0
