import math
import re
import zlib

import numpy as np

from tallyframe.llm import toxicity as T
from tests.llm.helpers import odd_documents, with_clashing


def accuracy(rows):
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return (y == p).mean()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.score_toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert len(rows) > 50 and accuracy(rows) >= 0.95
    assert sum(r.toxic for r in rows) > 0
    ids = got.select("doc_id", "held_out", "score", "predicted").collect()
    assert len(ids) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in ids)


def test_misspellings_share_subwords():
    rng = np.random.default_rng(2)
    plain = ["table", "river", "green", "window", "paper", "music", "garden", "letter", "winter", "coffee"]
    clean = [" ".join(rng.choice(plain, 30)) for _ in range(150)]
    toxic = [" ".join([*rng.choice(plain, 15), "blockhead", *rng.choice(plain, 15)]) for _ in range(150)]
    table, bias = T.train(clean + toxic, [0] * 150 + [1] * 150)
    scores = T.scores(["river blockhaed table", "blockheadd", "river paper garden", "", None, "BLOCKHEAD"], table, bias)
    assert (scores[[0, 1, 5]] > 0.5).all() and (scores[[2, 3, 4]] < 0.5).all()


def plainly(text, table, bias):
    """The score of a text by loops over words, subwords and bytes."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = [m for m in re.findall(rb"[0-9a-z\x80-\xff]+", data)]
    halves = []
    for k in range(0, len(words), T.WINDOW // 2):
        numbers = []
        for w in words[k : k + T.WINDOW // 2]:
            w = b" " + w + b" "
            for n in T.GRAMS:
                for i in range(len(w) - n + 1):
                    h = sum(b * pow(0x01000193, j, 1 << 32) for j, b in enumerate(w[i : i + n])) & 0xFFFFFFFF
                    h = (h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
                    h = (h ^ (h >> 15)) * 0xC2B2AE35 & 0xFFFFFFFF
                    numbers.append(float(table[h >> (32 - T.BUCKET_BITS)]))
        halves.append((sum(numbers), len(numbers)))
    windows = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(halves, halves[1:], strict=False)] + halves[-1:]
    logit = max((bias + s / (n + T.PRIOR) for s, n in windows), default=bias)
    return 1 / (1 + math.exp(-logit))


def test_scores_equal_plain_loops(spark, sf_dir):
    table = np.random.default_rng(3).normal(0, 1, 1 << T.BUCKET_BITS)
    texts = ["a bc def", "", None, "...", "ghij klm", "é à Ünï-CODE", "  two   spaces, and. dots " * 9, "x" * 400, "one " * 40, "\n\t."]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").limit(40).collect()]
    assert np.allclose(T.scores(texts, table, -1.0), [plainly(t, table, -1.0) for t in texts])


def test_parts_of_long_texts_change_nothing():
    rng = np.random.default_rng(3)
    table = rng.normal(0, 1, 1 << T.BUCKET_BITS)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, 20_000)).encode(), b" " * 3000 + b"z" * 5000 + b" end", b"", b"...", b"a b c d e f g h i"]
    whole = T.half_windows(texts, table, 1 << 30)
    for step in (7, 1000, 4096):
        for a, b in zip(whole, T.half_windows(texts, table, step), strict=True):
            assert np.allclose(a, b)


def test_labels_that_differ_are_toxic(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k in range(20) for y in ((0, 1) if k % 2 else (1, 0, 0))], "doc_id long, toxic int")
    assert set(T.sample(docs, labels)[1]) == {1}


def test_odd_tables(spark):
    docs = with_clashing(odd_documents(spark))
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (1, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    assert T.score_toxicity(docs, labels).count() == docs.count()
    assert {r.predicted for r in T.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    assert T.score_toxicity(docs, labels.limit(0)).count() == docs.count()
    assert T.score_toxicity(docs.limit(0), labels).count() == 0
