import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import exact_dedup as D
from tests.llm.helpers import lower, odd_documents, with_clashing


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.integers(0, 60_000), st.integers(0, 10**6))
def test_chunks_cover_and_follow_content(head, n, seed):
    body = random.Random(seed).randbytes(n)
    for data in (head, body, head + body):
        ends = D.cuts(data)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert all(D.MIN_CHUNK <= s <= D.MAX_CHUNK for s in sizes[:-1]) and all(s <= D.MAX_CHUNK for s in sizes)
    if n > 50_000:
        split = lambda x: {x[a:b] for a, b in zip([0, *D.cuts(x)], D.cuts(x), strict=False)}
        assert len(split(body) & split(head + body)) >= len(split(body)) / 2


def test_equals_brute_force(spark):
    docs = with_clashing(odd_documents(spark))
    rows = [(r.doc_id, lower(r.text)) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = D.exact_dedup(docs).collect()
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), str(largest[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert D.exact_dedup(docs.limit(0)).count() == 0


def weak(chunk):
    """Only a chunk's length: many chunks of other contents have the same identifier."""
    return len(chunk).to_bytes(4, "little") + bytes(D.ID_BYTES - 4)


def test_identifiers_are_verified_by_bytes(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3000, 3000, 40, 40, 9000)]
    rows = [(k, (base[k % 5] if k % 7 else base[k % 5][:-1] + "#").upper() if k % 3 else base[k % 5]) for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len({D.recipe(D.normalised(t), weak) for _, t in rows}) < len(groups)
    for identify in (weak, D.identifier):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in D.exact_dedup(docs, identify).collect()}
        assert got == {i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)])) for i, t in rows}


def test_chunks_are_sent_once_and_only_of_recurring_texts(spark):
    rows = [(k, "same text " * 2000 if k % 2 else f"own {k} " * 2000) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    marks = D._marks(D._grouped(D.recipes(docs), ["recipe"], 40))
    sent = D._texts(docs).select("fp", "text").mapInArrow(D._contents(D.identifier, marks), "id binary, bytes binary").collect()
    assert b"".join(bytes(r.bytes) for r in sent).startswith(b"same text") and len({bytes(r.id) for r in sent}) == len(sent) == len(set(D.chunks(b"same text " * 2000)))


def test_hot_groups(spark, monkeypatch):
    rows = [(k, "Same Text" if k % 3 else f"own {k}") for k in range(4000)]
    got = D.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    hot = got.where("group_size > 1").collect()
    assert len(hot) == sum(1 for k in range(4000) if k % 3) and {r.keep_id for r in hot} == {3998} and sum(r.kept for r in hot) == 1
    assert got.count() == 4000


def test_catalog_of_chunks(spark, sf_dir):
    rows = D.recipes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    chunks = D.chunk_catalog(rows)
    total = chunks.selectExpr("sum(n_uses * n_bytes) as b").first().b
    assert total == sum(len(D.normalised(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect())
    assert chunks.where("n_uses > 1").count() > 0
