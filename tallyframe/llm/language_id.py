"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, the last padded with spaces. In a window each byte has a
learnt embedding; filters of several widths slide over it, each filter's maximum over the window is
kept, and a softmax over the maxima gives the languages. All parameters are trained in numpy by
backpropagation with Adam. A text's language is that with the largest sum of log probabilities over
all its windows (weighted by their bytes that are no padding), its score the softmax of their mean.

Trained on the driver with a bounded sample: of the rows outside the held-out fold with a language
and a letter, the SAMPLE rows that come first by a hash of doc_id in each of at most MAX_LANGUAGES
languages (the most frequent), texts of at most SAMPLE_CHARS characters, and of their windows TRAIN_WINDOWS of each language, drawn at random. Only
rows with a hash under a language's share of about MARGIN * SAMPLE rows are sorted to find the first, so a language with most of all rows is no large
task. Prediction is one pass over whole texts without a
shuffle; windows of many texts are filtered at once, BATCH at a time, which bounds memory for texts of
any length.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
can be learnt. Repeated rows each get their result. Columns other than doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import crc32_of_id

WINDOW, EMBED, FILTERS = 128, 8, 16
WIDTHS = (2, 3, 4)
BATCH = 512
SAMPLE, SAMPLE_CHARS, MAX_LANGUAGES = 600, 8000, 200
TRAIN_WINDOWS, MARGIN = 6000, 4
EPOCHS, TRAIN_BATCH, RATE = 6, 128, 0.01
FOLDS, HELD_OUT = 3, 1
UND = "und"


def windows(data: bytes) -> np.ndarray:
    """data as rows of WINDOW bytes."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data + b" " * (n * WINDOW - len(data)), dtype=np.uint8).reshape(n, WINDOW)


def initial(n_languages: int, rng) -> dict[str, np.ndarray]:
    net = {"embed": rng.normal(0, 0.5, (256, EMBED))}
    for k in WIDTHS:
        net[f"w{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS))
        net[f"b{k}"] = np.zeros(FILTERS)
    net["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_languages))
    net["bias"] = np.zeros(n_languages)
    return {k: v.astype(np.float32) for k, v in net.items()}


def _slid(x: np.ndarray, k: int) -> np.ndarray:
    """x (windows, bytes, EMBED) as every k neighbouring bytes' embeddings: (windows, bytes - k + 1, k * EMBED)."""
    n, t, d = x.shape
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, t - k + 1, k * d), (s[0], s[1], s[2]))


def forward(net, rows: np.ndarray, keep: bool = False):
    x = net["embed"][rows]
    maxima, where = [], []
    for k in WIDTHS:
        flat = np.ascontiguousarray(_slid(x, k)).reshape(-1, k * EMBED)
        y = (flat @ net[f"w{k}"]).reshape(len(rows), WINDOW - k + 1, FILTERS)
        if keep:
            at = y.argmax(axis=1)
            where.append(at)
            top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
        else:
            top = y.max(axis=1)
        maxima.append(top + net[f"b{k}"])
    pooled = np.maximum(np.concatenate(maxima, axis=1), 0)
    z = pooled @ net["out"] + net["bias"]
    z -= z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return (log_p, x, where, pooled) if keep else log_p


def gradients(net, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    log_p, x, where, pooled = forward(net, rows, keep=True)
    n = len(rows)
    dz = np.exp(log_p)
    dz[np.arange(n), labels] -= 1
    dz /= n
    out = {"out": pooled.T @ dz, "bias": dz.sum(axis=0)}
    dp = (dz @ net["out"].T) * (pooled > 0)
    embed = np.zeros_like(net["embed"])
    for i, k in enumerate(WIDTHS):
        d = dp[:, i * FILTERS : (i + 1) * FILTERS]
        out[f"b{k}"] = d.sum(axis=0)
        at = where[i][:, :, None] + np.arange(k)  # (windows, filters, k): the bytes that gave each maximum
        own = np.arange(n)[:, None, None]
        picked = x[own, at].reshape(n, FILTERS, k * EMBED)
        out[f"w{k}"] = np.einsum("nf,nfe->ef", d, picked)
        back = d[:, :, None] * net[f"w{k}"].T[None]
        np.add.at(embed, rows[own, at].reshape(-1), back.reshape(-1, EMBED))
    out["embed"] = embed
    return out


def train(texts: list[str], langs: list[str], seed: int = 11, most: int = TRAIN_WINDOWS) -> tuple[dict[str, np.ndarray], list[str]] | None:
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = initial(len(names), rng)
    parts, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        w = windows(text.encode("utf-8", "surrogatepass"))
        parts.append(w)
        labels.append(np.full(len(w), names.index(lang)))
    rows, y = np.concatenate(parts), np.concatenate(labels)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:most] for k in range(len(names))])
    rows, y = rows[chosen], y[chosen]
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), TRAIN_BATCH):
            step += 1
            pick = order[s : s + TRAIN_BATCH]
            rate = RATE * 0.6**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in gradients(net, rows[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                net[k] -= (rate * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
    return net, names


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(texts: list[str | None], net, names: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    total = np.zeros((len(texts), len(names)))
    size = np.zeros(len(texts))
    stack: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    weight: list[np.ndarray] = []
    waiting = 0

    def done():
        nonlocal waiting
        if waiting:
            rows, of, w = np.concatenate(stack), np.concatenate(owner), np.concatenate(weight)
            for s in range(0, len(rows), BATCH):
                np.add.at(total, of[s : s + BATCH], forward(net, rows[s : s + BATCH]) * w[s : s + BATCH, None])
            np.add.at(size, of, w)
        stack.clear()
        owner.clear()
        weight.clear()
        waiting = 0

    known = [has_letter(t) for t in texts]
    for k, text in enumerate(texts):
        if not known[k]:
            continue
        data = text.encode("utf-8", "surrogatepass")
        for s in range(0, len(data), WINDOW * 8192):
            rows = windows(data[s : s + WINDOW * 8192])
            w = np.ones(len(rows))
            w[-1] = (len(data[s : s + WINDOW * 8192]) - 1) % WINDOW / WINDOW + 1 / WINDOW
            stack.append(rows)
            owner.append(np.full(len(rows), k))
            weight.append(w)
            waiting += len(rows)
            if waiting >= 4 * BATCH:
                done()
    done()
    mean = total / np.maximum(size, 1e-9)[:, None]
    best = mean.argmax(axis=1)
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p = p.max(axis=1) / p.sum(axis=1)
    return [names[b] if ok else UND for b, ok in zip(best, known, strict=True)], [float(x) if ok else 0.0 for x, ok in zip(p, known, strict=True)]


def sample(docs: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and languages of at most size rows of each of at most MAX_LANGUAGES languages outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and doc_id is not null").where((crc32_of_id(F.col("doc_id")) % FOLDS != HELD_OUT) & (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike(r"\p{L}"))
    common = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not common:
        return [], []
    # the first by the hash are under this limit, but for a language of few rows, which has none
    limits = F.create_map(*[F.lit(x) for lang, n in common.items() for x in (lang, -(2**63) + (MARGIN * size << 64) // n if n > MARGIN * size else 2**63 - 1)])
    keyed = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).where(F.col("h") <= F.element_at(limits, F.col("lang")))
    first = keyed.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= size).select("doc_id").distinct()
    got = rows.join(F.broadcast(first), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * size * len(common)).collect()
    return [r.text for r in got], [r.lang for r in got]


def annotate(docs: DataFrame, lang_col: str, score_col: str, size: int = SAMPLE) -> DataFrame:
    """docs with two columns more. If nothing can be learnt every language is UND."""
    model = train(*sample(docs, size))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(at).to_pylist()
                langs, scores = predict(texts, *model) if model else ([UND] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score."""
    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), "lang_pred", "score", size)
    return found.select("doc_id", (F.coalesce(crc32_of_id(F.col("doc_id")), F.lit(-1)) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score")
