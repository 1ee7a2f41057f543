import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import mixing as M
from tests.llm.helpers import WORD, odd_documents, with_clashing


def brute_targets(sizes, weights=(3, 1, 2)):
    """Reshare until no source is above its cap, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def check(docs):
    got = M.mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    target = brute_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len(WORD.findall(r.text or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position < 1) for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(by_source) == sorted({(sizes[s], round(float(t), 6)) for s, t in target.items()})
    # every pass by itself, a word at a time on the source's axis
    for r in got:
        assert r.taken == sum(r.words) and r.position == (r.positions[0] if r.positions else None) and list(r.positions) == sorted(r.positions)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at)
    return got, target


def test_targets_and_sums(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, target = check(docs)
    taken = dict(M.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken")).collect())
    assert all(abs(taken[s] - float(t)) <= 1 for s, t in target.items())
    again = M.mix(docs.repartition(7)).select("doc_id", "taken", "positions").collect()
    assert sorted(again) == sorted((r.doc_id, r.taken, r.positions) for r in got)


def test_schedule_decides_every_pass(spark):
    """Against a walk along each source's axis: what is taken is what has a position before the end."""
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + k % 7)), "abc"[k % 3] if k % 5 else "a") for k in range(200)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.mix(docs).collect()}
    rows = [(r.doc_id, r.source, len(r.text.split())) for r in docs.collect()]
    target = brute_targets({s: sum(n for _, x, n in rows if x == s) for s in "abc"})
    for rank, s in enumerate("abc"):
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, x, n in rows if x == s)
        axis = [i for _ in range(2) for _, i, n in own for _ in range(n)][: int(target[s])]
        slope, end = M.SLOPES[rank], float(target[s])
        for _, i, _ in own:
            assert got[i].taken == axis.count(i)
        inverse = lambda o: o / end if not slope else ((1 - slope) ** 2 + 4 * slope * o / end) ** 0.5 / (2 * slope) - (1 - slope) / (2 * slope)  # noqa: E731, B023
        begins = {}
        place = 0
        for _ in range(2):
            for _, i, n in own:
                if place < int(target[s]):
                    begins.setdefault(i, []).append(inverse(place))
                place += n
        for i, at in begins.items():
            assert got[i].positions == pytest.approx(at)


def test_many_sources_go_by_ranges(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("source"))
    check(docs)


def test_odd_documents(spark):
    check(with_clashing(odd_documents(spark)))
    assert M.mix(odd_documents(spark).limit(0)).count() == 0
    nothing = odd_documents(spark).withColumn("text", F.lit(None).cast("string"))
    assert {(r.taken, r.target) for r in M.mix(nothing).collect()} == {(0, 0.0)}


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_position_inverts_the_integral(spark, slope):
    d = spark.range(0, 100).select(F.col("id").cast("double").alias("x"), F.lit(100.0).alias("t"), F.lit(slope).alias("s"))
    for r in d.select("x", M.position(F.col("x"), F.col("t"), F.col("s")).alias("p")).collect():
        assert abs(100 * ((1 - slope) * r.p + slope * r.p * r.p) - r.x) < 1e-9


def test_schedule_keeps_columns_and_order(spark, sf_dir):
    docs = with_clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = M.schedule(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in M.mix(docs).collect():
        assert copies.get(r.doc_id, 0) == sum(2 * w >= r.size for w in r.words)
    assert M.schedule(odd_documents(spark)).count() > 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = M.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
