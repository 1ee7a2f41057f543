"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most CAPACITY tokens: a document's ids and a final 0; a longer one is cut into full
pieces with the shorter one first. Which piece goes where depends on lengths alone, so the plan is made from the histogram of lengths, which
has at most CAPACITY rows at any size of the corpus: the longest length left opens a sequence and its
gap is looked up in an index of single lengths, pair sums and triple sums, built once and kept to what the counts still allow; where no
combination fills it exactly, the best fit (the longest length that fits) goes in and the rest of the gap is
looked up again. Such a pattern is used as often as the counts allow, so a step uses up a length and
there are a few thousand patterns, not one for each sequence.

A pattern's slots take ranges of ranks within a length. Ranks come from counts by partition and length
and a row number inside each such group, so neither a common length nor the whole table is ever one task's.
The slot table (bounded as above) goes to the tasks, which find each piece's sequence and offset by binary search.

Ids are those of the tokenizer in the JSON file with its own handling of special strings (an added token in a text
is one id). Texts of plain Latin characters without such a string are encoded from the same
vocabulary as ranks, which is three times as fast; all others by the tokenizers library.

Defined cases: null and empty texts are the id 0 alone. A null doc_id and repeated rows are documents of
their own. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut

CAPACITY = 2048
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = 0
#: Characters that every engine classes alike, so that both encoders split a text into the same words.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞₠-₿]")
_PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_encoders: dict = {}


def plain(text: str) -> bool:
    """Whether both encoders are known to split text alike; two passes in C for what Latin-1 can hold."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return _PLAIN.search(text) is None


def paths(tokenizer: str | None = None, ranks: str | None = None) -> tuple[str, str]:
    if tokenizer and ranks:
        return tokenizer, ranks
    import public_tokenizers

    return tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)


def _fast(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _exact(path: str):
    """The tokenizer of the JSON file and the strings that it takes as one token each."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        _encoders[path] = Tokenizer.from_file(path), added
    return _encoders[path]


def encode(text: str | None, tokenizer: str, ranks: str) -> np.ndarray:
    """The ids of text and END, as little-endian unsigned 32-bit numbers."""
    if not text:
        return np.array([END], dtype="<u4")
    exact, added = _exact(tokenizer)
    if plain(text) and not any(t in text for t in added):
        ids = _fast(ranks).encode_to_numpy(text, disallowed_special=())
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, dtype="<u4")
    out[:-1], out[-1] = ids, END
    return out


def bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """start and length of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, row (a number for each row of docs), piece, start, length, ids_crc32, and if asked for ids as bytes."""
    json_path, ranks_path = paths(tokenizer, ranks)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = pa.schema(list(zip(["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids, kinds, strict=True)))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encode(text.as_py(), json_path, ranks_path)
                for k, (start, length) in enumerate(bounds(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    for column, value in zip(out, (doc, row, k, start, length, zlib.crc32(data), data), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES + ", ids binary" * with_ids)


class Sums:
    """Single lengths, pairs and triples by their sum, as far as counts allow.

    pairs and triples are indexed once, by sum, as the combination with the longest members. Counts only fall, so a combination that they
    no longer allow is never allowed again: a lookup that finds its entry spent moves it on to the next, and all lookups together pass
    each combination once.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        here = counts > 0
        self.pairs: dict[int, int] = {}  # sum: the longer member
        for total in range(2, len(counts)):
            longer = np.arange(total - 1, (total - 1) // 2, -1)
            found = np.flatnonzero(here[longer] & here[total - longer])
            if len(found):
                self.pairs[total] = int(longer[found[0]])
        self.triples: dict[int, int] = {}  # sum: the longest member
        sums = np.zeros(len(counts), dtype=bool)
        sums[list(self.pairs)] = True
        for total in range(3, len(counts)):
            longest = np.arange(total - 2, (total - 1) // 3, -1)
            found = np.flatnonzero(here[longest] & sums[total - longest])
            if len(found):
                self.triples[total] = int(longest[found[0]])

    def _allowed(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def single(self, gap: int):
        return (gap,) if self.counts[gap] > 0 else None

    def pair(self, gap: int):
        """The pair with the longest member."""
        for a in range(self.pairs.get(gap, 0), (gap - 1) // 2, -1):
            if self._allowed(a, gap - a):
                self.pairs[gap] = a
                return a, gap - a
        self.pairs.pop(gap, None)
        return None

    def triple(self, gap: int):
        """The triple with the longest member, then the longest second."""
        for a in range(self.triples.get(gap, 0), (gap - 1) // 3, -1):
            rest = gap - a
            if self.counts[a] and self.pair(rest):
                # the entry may need a length that a uses up
                for b in range(min(a, self.pairs[rest]), (rest - 1) // 2, -1):
                    if self._allowed(a, b, rest - b):
                        self.triples[gap] = a
                        return a, b, rest - b
        self.triples.pop(gap, None)
        return None

    def fill(self, gap: int):
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many of it in a sequence)]) patterns that use up counts."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out = Sums(left), []
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        used = {longest: 1}
        left[longest] -= 1
        gap = capacity - longest
        while gap:
            got = sums.fill(gap)
            if not got:
                fits = np.flatnonzero(left[: gap + 1])
                if not len(fits):
                    break
                got = (int(fits[-1]),)
            for x in got:
                used[x] = used.get(x, 0) + 1
                left[x] -= 1
                gap -= x
        times = 1 + min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * (times - 1)
        out.append((times, sorted(used.items(), reverse=True)))


def slots(patterns) -> np.ndarray:
    """Rows (length, first rank, how many in a sequence, first sequence, offset of the first) by length and rank."""
    rows, rank, sequence = [], {}, 0
    for times, used in patterns:
        offset = 0
        for length, n in used:
            at = rank.get(length, 0)
            rows.append((length, at, n, sequence, offset))
            rank[length] = at + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for each row of parts (doc_id, row, piece, start, length, ids_crc32)."""
    parts = cut(parts).withColumn("part", F.spark_partition_id())
    groups = parts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    first = groups.withColumn("first", F.sum("n").over(earlier) - F.col("n")).drop("n")
    own = Window.partitionBy("part", "length").orderBy("row", "piece")
    ranked = parts.join(first, ["part", "length"]).withColumn("rank", F.row_number().over(own) - 1 + F.col("first"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shift = 2**48
    keys = table[:, 0] * shift + table[:, 1]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(k), dtype=np.int64) for k in (3, 5))
            slot = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            inside = rank - slot[:, 1]
            sequence = slot[:, 3] + inside // np.maximum(slot[:, 2], 1)
            offset = slot[:, 4] + inside % np.maximum(slot[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(pieces(docs, capacity, tokenizer, ranks), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """The packed training rows themselves: sequence_id, n_ids, ids (little-endian unsigned 32-bit) of each sequence; doc_id must be unique."""
    placed = pack(docs, capacity, tokenizer, ranks).select("doc_id", "piece", "sequence_id", "offset")
    data = pieces(docs, capacity, tokenizer, ranks, with_ids=True).select("doc_id", "piece", "ids")
    both = placed.join(data, ["doc_id", "piece"])
    lists = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"))  # capacity ids at most
    joined = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return lists.select("sequence_id", joined.alias("ids")).withColumn("n_ids", (F.length("ids") / 4).cast("long"))
