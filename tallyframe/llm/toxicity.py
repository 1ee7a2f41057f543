"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Texts are lower-cased (A-Z) bytes; a word is a run of bytes other than ASCII that is no letter or digit.
Every run of 3 to 5 bytes within a word and the separators around it is a subword, hashed to one of
2**BUCKET_BITS embeddings. A window of WINDOW words (they start every WINDOW / 2) is the average of its subwords'
embeddings, on which a linear softmax gives the two classes; embeddings and softmax are trained
jointly in numpy. A text is as toxic as its most toxic window, in training too, so a few words count as
much in a long text as in a short one, and a misspelling shares most of its subwords with what was learnt.

Trained on the driver with a bounded sample: of the labelled rows outside the held-out fold, the SAMPLE
toxic rows and CLEAN times as many others that come first by a hash of doc_id, texts of at most SAMPLE_CHARS characters before those of at most LONGEST, SAMPLE_TOTAL characters in all. A model is
as large at any size of the corpus (2**BUCKET_BITS numbers once embeddings and softmax are multiplied out). Scoring is
one pass over whole texts without a shuffle; subwords are looked up SLICE places at a time, which bounds memory for texts of any length and changes no score.

Defined cases: null and empty texts and those without a subword score as the bias of a window without
subwords. Rows with a null label teach nothing, a doc_id with both labels is toxic; a doc_id that repeats gets a score for each of its rows. If
the sample lacks a class, every score is the share of toxic rows in the sample (0 if it is empty), kept under 0.5
unless all of them are toxic. Columns other than doc_id and text are ignored, label tables need doc_id and toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, crc32_of_id

BUCKET_BITS, DIM = 18, 8
GRAMS = (3, 4, 5)
WINDOW = 12
SLICE = 1 << 17
SAMPLE, CLEAN, SAMPLE_CHARS, LONGEST, SAMPLE_TOTAL = 800, 4, 2500, 20_000, 6_000_000
ROUNDS, STEPS, RATE, DECAY = 12, 25, 0.3, 2e-8
#: A window counts as if it had this many more subwords that say nothing.
PRIOR = 10
FOLDS, HELD_OUT = 5, 0

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x01000193


def grams(raw: np.ndarray):
    """For each n of GRAMS: the bucket at every place of raw (lower-cased bytes), and whether a subword of n bytes stands there."""
    gap = _SEPARATORS[raw]
    a = np.where(gap, np.uint32(32), raw).astype(np.uint32)
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    h, power = a, np.uint32(1)
    for n in range(2, max(GRAMS) + 1):
        if len(a) < n:
            return
        power = np.uint32((int(power) * _BASE) & 0xFFFFFFFF)
        h = h[: len(a) - n + 1] + a[n - 1 :] * power
        if n in GRAMS:
            inside = gaps[n - 1 : n - 1 + len(h)] == gaps[1 : 1 + len(h)]  # no separator between the first and the last byte
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0xC2B2AE35)
            mixed >>= np.uint32(32 - BUCKET_BITS)
            yield mixed, inside


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row with separators around each; the place where each half window begins, and its text's number.

    A half window is WINDOW / 2 words; a text without words has none.
    """
    raw = np.frombuffer(b" " + b"  ".join(texts) + b" ", dtype=np.uint8)
    gap = _SEPARATORS[raw]
    heads = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.cumsum([len(t) + 2 for t in texts])
    of = np.searchsorted(ends, heads, side="right")
    first = np.searchsorted(heads, ends - [len(t) + 2 for t in texts])
    chosen = (np.arange(len(heads)) - first[of]) % (WINDOW // 2) == 0
    return raw, heads[chosen] - 1, of[chosen]


def window_logits(total: np.ndarray, count: np.ndarray, of: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each window (two half windows of one text, or one if the text has no more), at the place of its first half."""
    more = np.zeros(len(of), dtype=bool)
    more[:-1] = of[1:] == of[:-1]
    if len(of) > 1:
        total = total + np.where(more, np.append(total[1:], 0), 0)
        count = count + np.where(more, np.append(count[1:], 0), 0)
    return bias + total / (count + PRIOR), count


def half_windows(texts: list[bytes], table: np.ndarray, step: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each half window of the texts the sum of its subwords' numbers, how many they are, and its text's number; step places at a time."""
    raw, marks, of = laid_out(texts)
    total, count = np.zeros(len(marks)), np.zeros(len(marks), dtype=np.int64)
    for start in range(0, len(raw), step):
        first, end = np.searchsorted(marks, [start + 1, start + step])
        first = max(int(first) - 1, 0)  # the half window that start is in; before the first are separators alone
        if end == 0:
            continue
        part = raw[start : start + step + max(GRAMS) - 1]
        here = min(step, len(part))
        sums, seen = np.zeros(here), np.zeros(here, dtype=np.int32)
        for bucket, inside in grams(part):
            n = min(here, len(bucket))
            sums[:n] += table[bucket[:n]] * inside[:n]
            seen[:n] += inside[:n]
        edges = np.maximum(marks[first:end] - start, 0)
        total[first:end] += np.add.reduceat(sums, edges)
        count[first:end] += np.add.reduceat(seen, edges)
    return total, count, of


def scores(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Scores of whole texts, that of their most toxic window each; short texts are laid out together, up to SLICE bytes."""
    group: list[bytes] = []
    found: list[tuple] = []
    room = first = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if group and room + len(data) > SLICE:
            total, count, of = half_windows(group, table)
            found.append((total, count, of + first))
            group, room, first = [], 0, k
        group.append(data)
        room += len(data)
    if group:
        total, count, of = half_windows(group, table)
        found.append((total, count, of + first))
    best = np.full(len(texts), float(bias))
    total, count, of = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
    if len(of):
        logit, _ = window_logits(total, count, of, bias)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        best[of[starts]] = np.maximum.reduceat(logit, starts)
    return 1 / (1 + np.exp(-np.clip(best, -500, 500)))


def summed(own: np.ndarray, values, n: int, at: np.ndarray | None = None, step: int = 1 << 20) -> np.ndarray:
    """For each of n groups the sum of values (of values[at]), a part at a time, which bounds the memory."""
    out = np.zeros(n)
    for s in range(0, len(own), step):
        out += np.bincount(own[s : s + step], weights=values[s : s + step] if at is None else values[at[s : s + step]], minlength=n)
    return out


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """A number for each bucket (embedding times softmax, toxic less other) and the bias."""
    y = np.asarray(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        share = min(share, 0.49) if share < 1 else 0.99
        return np.zeros(1 << BUCKET_BITS), float(np.log(max(share, 1e-6) / (1 - share)))
    cell_parts, bucket_parts, doc_parts, n_cells = [], [], [], 0
    for k, text in enumerate(texts):
        raw, marks, of = laid_out([text.encode("utf-8", "surrogatepass").translate(LOWER)])
        if not len(marks):
            continue
        cell_at = np.zeros(len(raw), dtype=np.int32)
        cell_at[marks[1:]] = 1
        cell_at = np.cumsum(cell_at, dtype=np.int32) + np.int32(n_cells)
        found = [(cell_at[at], bucket[at].astype(np.int32)) for bucket, inside in grams(raw) for at in (np.flatnonzero(inside),)]
        if found:
            cells, buckets = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(cells, kind="stable")  # so that the whole is in the order of its cells
            cell_parts.append(cells[order])
            bucket_parts.append(buckets[order])
        doc_parts.append(np.full(len(of), k))
        n_cells += len(marks)
    if not n_cells:
        return np.zeros(1 << BUCKET_BITS), float(np.log(min(max(y.mean(), 1e-6), 0.49)))
    doc = np.concatenate(doc_parts)
    cell = np.concatenate(cell_parts)
    del cell_parts
    bucket = np.concatenate(bucket_parts)
    del bucket_parts
    count = np.bincount(cell, minlength=n_cells)
    first = np.concatenate([[0], np.cumsum(count)])
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    known = doc[starts]
    y = y[known]
    last = np.append(starts[1:], n_cells) - 1

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    w = rng.normal(0, 1.0, DIM)
    b = -2.0
    seen = np.bincount(bucket, minlength=1 << BUCKET_BITS) > 0
    state = [np.zeros_like(e), np.zeros_like(e), np.zeros_like(w), np.zeros_like(w), 0.0, 0.0]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    weight /= weight.sum()
    step = 0
    for turn in range(ROUNDS):
        if turn == 0:  # no window is known yet: whole texts
            own = np.repeat(np.arange(len(starts), dtype=np.int32), last - starts + 1)[cell]
            used, bag = np.arange(1 << BUCKET_BITS), bucket
        else:  # each text's most toxic window
            logit, _ = window_logits(summed(cell, e @ w, n_cells, bucket), count, doc, b)
            top = np.lexsort((-logit, doc))[starts]
            spans = [np.arange(first[t], first[min(t + 2, z + 1)]) for t, z in zip(top, last, strict=True)]
            own = np.repeat(np.arange(len(top)), [len(x) for x in spans])
            used, bag = np.unique(bucket[np.concatenate(spans)], return_inverse=True)
        length = np.bincount(own, minlength=len(y)) + PRIOR
        eu, m, v = e[used], state[0][used], state[1][used]
        for _ in range(STEPS if turn else 8):
            step += 1
            z = summed(own, eu @ w, len(y), bag) / length + b
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
            r = summed(bag, g / length, len(used), own)
            ge, gw, gb = np.outer(r, w) + DECAY * eu, eu.T @ r, float(g.sum())
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            m, v = 0.9 * m + 0.1 * ge, 0.999 * v + 0.001 * ge * ge
            eu = eu - rate * m / (np.sqrt(v) + 1e-8)
            state[2], state[3] = 0.9 * state[2] + 0.1 * gw, 0.999 * state[3] + 0.001 * gw * gw
            w = w - 0.1 * rate * state[2] / (np.sqrt(state[3]) + 1e-8)
            state[4], state[5] = 0.9 * state[4] + 0.1 * gb, 0.999 * state[5] + 0.001 * gb * gb
            b -= 0.1 * rate * state[4] / (np.sqrt(state[5]) + 1e-8)
        e[used], state[0][used], state[1][used] = eu, m, v
    return np.where(seen, e @ w, 0.0), float(b)  # subwords that no training text holds say nothing


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most size toxic and CLEAN * size other rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc32_of_id(F.col("doc_id")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= LONGEST)
    lengths = texts.select("doc_id", (F.length("text") > SAMPLE_CHARS).alias("long")).join(known, "doc_id").groupBy("doc_id", "y").agg(F.max("long").alias("long"))
    order = [F.col("long"), F.xxhash64("doc_id"), F.col("doc_id")]
    picked = lengths.where("y = 1").orderBy(*order).limit(size).unionByName(lengths.where("y = 0").orderBy(*order).limit(CLEAN * size))  # at most (1 + CLEAN) * size ids
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(*order, "text").select("text", "y").limit(2 * (1 + CLEAN) * size).toLocalIterator()
    kept, room = [], SAMPLE_TOTAL
    for r in rows:
        room -= len(r.text)
        if room < 0:
            break
        kept.append(r)
    return [r.text for r in kept], [r.y for r in kept]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    table, bias = train(*sample(docs, labels, size))
    table = table.astype(np.float32)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist(), table, bias), pa.float64())], schema=_SCHEMA)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (F.coalesce(crc32_of_id(F.col("doc_id")), F.lit(-1)) % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
