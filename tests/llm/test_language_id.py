import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import language_id as L
from tests.llm.helpers import odd_documents, with_clashing


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == docs.count()
    rows = [(r.lang, got[r.doc_id]) for r in docs.collect()]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for _, g in rows)
    held = [(lang, g.lang_pred) for lang, g in rows if g.held_out and g.lang_pred != "und"]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    net = {k: v.astype(np.float64) for k, v in L.initial(3, rng).items()}
    rows, y = rng.integers(0, 256, (4, L.WINDOW)), np.array([0, 1, 2, 1])
    loss = lambda: -L.forward(net, rows)[np.arange(4), y].mean()
    for name, g in L.gradients(net, rows, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net[name][at]
        net[name][at] = old + 1e-5
        up = loss()
        net[name][at] = old - 1e-5
        down = loss()
        net[name][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])), name


def plainly(text, net, names):
    """Language and score by loops over windows, places, filters and bytes."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.encode()
    total, weight = [0.0] * len(names), 0.0
    for s in range(0, len(data), L.WINDOW):
        own = data[s : s + L.WINDOW]
        row = own + b" " * (L.WINDOW - len(own))
        z = [float(b) for b in net["bias"]]
        for i, k in enumerate(L.WIDTHS):
            for f in range(L.FILTERS):
                best = max(sum(float(net["embed"][row[t + j]][e]) * float(net[f"w{k}"][j * L.EMBED + e][f]) for j in range(k) for e in range(L.EMBED)) for t in range(L.WINDOW - k + 1))
                top = max(0.0, best + float(net[f"b{k}"][f]))
                z = [x + top * float(net["out"][i * L.FILTERS + f][c]) for c, x in enumerate(z)]
        log = max(z) + math.log(sum(math.exp(x - max(z)) for x in z))
        total = [t + (x - log) * len(own) / L.WINDOW for t, x in zip(total, z, strict=True)]
        weight += len(own) / L.WINDOW
    p = [math.exp(t / weight) for t in total]
    return names[p.index(max(p))], max(p) / sum(p)


def test_predictions_equal_plain_loops():
    net, names = L.train(["der die das und ist", "the of and to in is", "le la les et est"] * 30, ["de", "en", "fr"] * 30)
    texts = ["und das ist der Hund", "Été — le chat et la table " * 7, "the end of it, and more of the same " * 8, "x", "12 !", None, "漢字 is the word"]
    for text, lang, score in zip(texts, *L.predict(texts, net, names), strict=True):
        want = plainly(text, net, names)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_sample_is_the_first_by_the_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, langs = L.sample(docs, 5)
    may = [r for r in docs.where(F.length("text") <= L.SAMPLE_CHARS).withColumn("h", F.xxhash64("doc_id")).collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and any(c.isalpha() for c in r.text)]
    want = [(r.text, r.lang) for lang in {r.lang for r in may} for r in sorted((r for r in may if r.lang == lang), key=lambda r: r.h)[:5]]
    assert sorted(zip(texts, langs, strict=True)) == sorted(want)


def test_batches_do_not_matter(spark):
    model = L.train(["der die das und ist", "the of and to in is", "le la les et est"] * 30, ["de", "en", "fr"] * 30)
    texts = ["und das ist der Hund", None, "", "123 !!", "the end of it", "x" * 300_000]
    together = L.predict(texts, *model)
    alone = [L.predict([t], *model) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone], atol=1e-6)
    assert together[0][1:4] == ["und"] * 3 and together[1][1:4] == [0.0] * 3


def test_odd_tables(spark):
    docs = with_clashing(odd_documents(spark))
    got = L.identify(docs).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 10)} == {"und"}
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0
    kept = L.annotate(docs, "found", "found_score")
    assert kept.columns == [*docs.columns, "found", "found_score"] and kept.drop("found", "found_score").exceptAll(docs).count() == 0
