import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import packing as K
from tests.llm.helpers import DOCS, odd_documents, with_clashing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = Counter(lengths)
    patterns = K.plan(dict(counts), 64)
    used, bins = Counter(), 0
    for times, items in patterns:
        assert times > 0 and sum(n * x for x, n in items) <= 64
        bins += times
        for x, n in items:
            used[x] += n * times
    assert used == counts
    assert -(-sum(lengths) // 64) <= bins <= 2 * max(1, -(-sum(lengths) // 64))


def test_exact_combinations_come_first():
    assert K.plan({50: 1, 14: 1, 10: 1, 4: 1}, 64)[0] == (1, [(50, 1), (14, 1)])
    assert K.plan({50: 1, 13: 1, 10: 1, 4: 1}, 64)[0] == (1, [(50, 1), (10, 1), (4, 1)])
    assert K.plan({50: 1, 13: 1, 5: 2, 4: 1}, 64)[0] == (1, [(50, 1), (5, 2), (4, 1)])
    assert len(K.plan({30: 10**9, 34: 10**9}, 64)) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=14), st.lists(st.tuples(st.integers(1, 24), st.integers(1, 24)), max_size=12))
def test_index_of_sums_against_all_combinations(lengths, lookups):
    counts = np.zeros(25, dtype=np.int64)
    for x in lengths:
        counts[x] += 1
    index = K.Sums(counts)
    for gap, spent in lookups:  # counts fall between lookups
        pool = sorted((x for x in range(25) for _ in range(counts[x])), reverse=True)
        want = [max((c for c in combinations(pool, n) if sum(c) == gap), default=None) for n in (1, 2, 3)]
        assert [index.single(gap), index.pair(gap), index.triple(gap)] == want
        counts[spent] = max(0, counts[spent] - 1)


def test_pieces_and_ids(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(K.paths()[0])
    special = spark.createDataFrame([(20, "a <|endoftext|> b<|endoftext|>", "en", "a", 1), (21, "<|endoftext|>", "en", "a", 1), (22, "漢 <|endoftext|>", "en", "a", 1)], DOCS)
    docs = with_clashing(odd_documents(spark).unionByName(special))
    rows = K.pack(docs).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        want += [(r.doc_id, k, s, (starts[1:] + [len(ids)])[k] - s, zlib.crc32(ids[s : (starts[1:] + [len(ids)])[k]].tobytes())) for k, s in enumerate(starts)]
    key = lambda x: (x[0] is None, *[v or 0 for v in x])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert K.pack(docs.limit(0)).count() == 0


def test_both_encoders_agree(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer, ranks = K.paths()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> a", "a  b\n\n c\t", "it's I'LL 1²3½", "“quote” — x…", "naïve\u00a0space", "\u2003wide", "a\x1cb\x85c", "漢字 123 ٣", "x" * 5000]
    exact = Tokenizer.from_file(tokenizer)
    for t in texts:
        assert K.encode(t, tokenizer, ranks)[:-1].tolist() == exact.encode(t, add_special_tokens=False).ids


def test_sequences_hold_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    tokenizer, ranks = K.paths()
    data = b"".join(sorted(bytes(r.ids) for r in K.sequences(docs).collect()))
    want = sum(len(K.encode(r.text, tokenizer, ranks)) for r in docs.collect())
    assert len(data) == 4 * want
    assert K.sequences(docs).where("n_ids > 2048").count() == 0


def test_close_to_the_bound(spark):
    rows = K.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    total, used = rows.agg({"length": "sum"}).first()[0], rows.select("sequence_id").distinct().count()
    assert used <= 1.01 * -(-total // 2048) + 1
