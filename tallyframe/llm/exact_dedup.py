"""Exact deduplication by content-defined chunk recipes.

Each text is normalised (A-Z lower-cased, UTF-8) and cut where a rolling hash of its last 16
bytes hits a fixed pattern, so equal passages give equal chunks wherever they stand. A chunk's
identifier is its length with two independent digests of its bytes, and a document's recipe the ordered list
of its identifiers, 28 bytes for some 2 KB of text.

1. One pass over the texts gives recipes; texts do not move. Only documents whose whole recipe recurs can be equal.
2. The chunks of those documents are deduplicated: in each task every identifier is kept with its bytes once, then once over all
   tasks, where the bytes under an identifier are compared. An identifier with one content is verified; one with several (no real
   table is known to have any) is not.
3. Ordered lists of verified identifiers are compared: recipes whose identifiers are all verified stand for their texts. Documents with an
   identifier of several contents are told apart by their bytes beside the list.

So a long document's bytes move once, as chunks, and only for a recipe that recurs; of a third of all rows that are copies each task
sends one.

Groups of any size: recipes are counted with map-side aggregation; the few groups that hold over
1/1000 of all rows (under 1000 of them by definition) are joined back by broadcast, all others by a shuffle. Documents whose recipe recurs
are marked for the second pass in a bit map of 2**MARK_BITS bits, of that size for any table; one that is marked by chance costs its chunks' way
and changes nothing.

Defined cases: null text counts as empty (an empty recipe). A null doc_id orders below every
other; rows that repeat id and text are rows of their group, and exactly one row of a group stays. An
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import LOWER, cut, fingerprint

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 512, 11, 16384
ID_BYTES = 28
#: Groups with more than this share of all rows are joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.001
#: Bits of the map that marks documents, and of one of its parts.
MARK_BITS, PART_BITS = 26, 15
#: Bytes of chunks that a task remembers to have sent; beyond them it begins anew and may send one again.
REMEMBERED = 64_000_000


def _gear() -> np.ndarray:
    """256 mixing values from a rule: the first bytes of the digests of 0 to 255."""
    return np.array([struct.unpack("<I", hashlib.blake2b(bytes([i]), digest_size=4).digest())[0] for i in range(256)], dtype=np.uint32)


GEAR = _gear()


def cuts(data: bytes, low: int = MIN_CHUNK, bits: int = MEAN_BITS, high: int = MAX_CHUNK) -> list[int]:
    """Ends of the content-defined chunks of data; chunks have low to high bytes, the last may have fewer."""
    n = len(data)
    if n <= low:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8):  # after step k each value covers 2k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    ends, start = [], 0
    for m in marks.tolist():
        while m - start > high:
            start += high
            ends.append(start)
        if m - start >= low:
            ends.append(m)
            start = m
    while n - start > high:
        start += high
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def identifier(chunk: bytes) -> bytes:
    return struct.pack("<I", len(chunk)) + hashlib.blake2b(chunk, digest_size=16).digest() + hashlib.sha1(chunk).digest()[:8]


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def recipe(data: bytes, identify=identifier) -> bytes:
    """The ordered identifiers of data's chunks, each ID_BYTES long."""
    return b"".join(map(identify, chunks(data)))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary())])


def _recipes(identify, marks: np.ndarray | None = None):
    """Recipes; with marks only of marked documents, and with their normalised text as content."""

    def run(batches):
        for batch in batches:
            if marks is not None:
                batch = _marked(batch, 2, marks)
            ids, rows, prints, texts = (batch.column(k) for k in range(4))
            data = [normalised(t.as_py()) for t in texts]
            out = [ids, rows, prints, pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array([recipe(d, identify) for d in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(data, pa.binary())] * (marks is not None), schema=_SCHEMA if marks is None else _SCHEMA.append(pa.field("content", pa.binary())))

    return run


def _marked(batch, column: int, marks: np.ndarray):
    """The rows of batch whose fp has its bit."""
    at = np.asarray(batch.column(column), dtype=np.int64) & np.int64((1 << MARK_BITS) - 1)
    return batch.filter(pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))


def _contents(identify, marks: np.ndarray):
    """(id, bytes) of the chunks of marked documents, each once as long as it is remembered."""
    schema = pa.schema([("id", pa.binary()), ("bytes", pa.binary())])

    def run(batches):
        known: dict[bytes, set[bytes]] = {}
        held = 0
        for batch in batches:
            for text in _marked(batch, 0, marks).column(1):
                out = []
                for chunk in chunks(normalised(text.as_py())):
                    name = identify(chunk)
                    if chunk not in (same := known.setdefault(name, set())):
                        same.add(chunk)
                        held += len(chunk)
                        out.append((name, chunk))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)
                if held > REMEMBERED:
                    known, held = {}, 0

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), fingerprint(F.col("text")).alias("fp"), F.col("text").cast("string").alias("text"))


_KIND = "doc_id long, row long, fp long, text_sha256 string, recipe binary"


def recipes(docs: DataFrame, identify=identifier) -> DataFrame:
    """doc_id, row (a number of its own for each row), fp, text_sha256, recipe."""
    return _texts(docs).mapInArrow(_recipes(identify), _KIND)


def _ids(of: str = "recipe"):
    return F.expr(f"transform(sequence(0, cast(length({of}) / {ID_BYTES} as int) - 1), i -> substring({of}, i * {ID_BYTES} + 1, {ID_BYTES}))")


def chunk_catalog(recipes: DataFrame) -> DataFrame:
    """Distinct chunks of recipes: chunk_id, n_bytes, n_uses; what a chunk store would hold once."""
    ids = recipes.where(F.length("recipe") > 0).select(F.explode(_ids()).alias("chunk_id"))
    little = [F.conv(F.hex(F.expr(f"substring(chunk_id, {i + 1}, 1)")), 16, 10).cast("long") * 256**i for i in range(4)]
    size = little[0] + little[1] + little[2] + little[3]
    return ids.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_uses")).withColumn("n_bytes", size)


def _grouped(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """rows with the size and the best row of their group, null where it has one row."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
    groups = cut(groups.where("group_size > 1"))
    limit = max(1000, int(n_rows * HOT_SHARE))
    names = rows.columns
    marked = rows.join(F.broadcast(groups.where(F.col("group_size") > limit)), keys, "left")
    done = marked.where("best is not null").select(*names, "group_size", "best")
    open_ = marked.where("best is null").select(*names).join(groups.where(F.col("group_size") <= limit), keys, "left").select(*names, "group_size", "best")
    return cut(done.unionByName(open_))


def _marks(grouped: DataFrame) -> np.ndarray:
    """The bit map of the fps of rows whose recipe recurs."""
    at = F.col("fp").bitwiseAND((1 << MARK_BITS) - 1)
    parts = grouped.where("best is not null").groupBy(F.shiftright(at, PART_BITS).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << PART_BITS) - 1)).alias("bits"))
    out = np.zeros((1 << MARK_BITS) // 8, dtype=np.uint8)
    for r in parts.collect():  # at most 2 ** (MARK_BITS - PART_BITS) parts of 4 KB
        start = r.part << (PART_BITS - 3)
        out[start : start + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def exact_dedup(docs: DataFrame, identify=identifier) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, fp."""
    rows = cut(recipes(docs, identify))
    n_rows = rows.count()
    grouped = _grouped(rows, ["recipe"], n_rows)
    marks = _marks(grouped)
    if marks.any():
        # chunks of recurring recipes: one row for each identifier and content
        sent = _texts(docs).select("fp", "text").mapInArrow(_contents(identify, marks), "id binary, bytes binary")
        stored = sent.repartition("id").groupBy("id", "bytes").agg(F.count(F.lit(1)).alias("times"))
        several = cut(stored.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("id"))
        if several.limit(1).count():
            lists = grouped.where("best is not null and length(recipe) > 0").select("recipe").distinct()
            unsure = cut(lists.select("recipe", F.explode(_ids()).alias("id")).join(several, "id", "left_semi").select("recipe").distinct())
            told_apart = _texts(docs).mapInArrow(_recipes(identify, marks), _KIND + ", content binary").join(unsure, "recipe", "left_semi")
            sure = rows.join(unsure, "recipe", "left_anti").withColumn("content", F.lit(b""))
            grouped = _grouped(cut(sure.unionByName(told_apart)), ["recipe", "content"], n_rows)
    return grouped.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        (F.length("recipe") / ID_BYTES).cast("long").alias("n_chunks"),
        "fp",
    )
