import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallyframe.llm.language_id import UND, identify
from tests.llm.helpers import jaccard_components, lower, odd_documents, with_clashing


def test_stages_decide_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    spoken = {r.doc_id for r in identify(docs).collect() if r.lang_pred != UND and r.score >= P.LEAST_SCORE}
    out = docs
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, out, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            left = {i: t for i, t in left.items() if i in spoken}
        if k == 1:
            last = {}
            for i, t in left.items():
                last[lower(t)] = max(i, last.get(lower(t), i))
            left = {i: left[i] for i in last.values()}
        if k == 2:
            left = {i: left[i] for i, (_, c) in jaccard_components(list(left.items()), P.WORDS, P.PERCENT).items() if i == c}
        if k < 3:
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(left) and out.count() == len(left)
        if k == 3:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(left)
            docs_out = out.count()
    assert out.where("piece = 0").count() == docs_out
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_over_a_folder(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} & {7, 11, 12}


def test_columns_pass_through_and_nothing_gives_nothing(spark, sf_dir):
    docs = with_clashing(odd_documents(spark)).withColumn("fp_", F.lit(1))
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= 2 * docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    # one row of those that repeat id and text
    assert P.STAGES[1][1](spark, docs, sf_dir).where("doc_id = 5").count() == 1
    assert P.STAGES[4][1](spark, docs.limit(0), sf_dir).count() == 0


def test_a_run_goes_on_after_its_last_whole_stage(spark, sf_dir, monkeypatch):
    run_id = uuid.uuid4().hex
    called = []

    def traced(name, stage, fails=False):
        def f(spark, docs, sf_dir):
            called.append(name)
            if fails:
                raise RuntimeError(name)
            return stage(spark, docs, sf_dir)

        return name, f

    stages = [(name, lambda spark, docs, sf_dir, k=k: docs.where(f"doc_id % 7 <> {k}")) for k, (name, _) in enumerate(P.STAGES)]
    monkeypatch.setattr(P, "STAGES", [traced(n, f, k == 3) for k, (n, f) in enumerate(stages)])
    with pytest.raises(RuntimeError):
        P.run(spark, sf_dir, run_id)
    monkeypatch.setattr(P, "STAGES", [traced(n, f) for n, f in stages])
    got = P.run(spark, sf_dir, run_id)
    names = [n for n, _ in stages]
    assert called == names[:4] + names[3:]
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 7 > 4")
    assert got.count() == want.count() > 0
