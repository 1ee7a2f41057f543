"""License scan as an exact set-similarity join, in DataFrame functions only.

Every text is lower-cased (A-Z) and cut into words. Base phrases are counted at every place where their
words stand consecutively. Beside them, each text block (a line; of longer lines every run of BLOCK
words, a run starting every BLOCK / 2; and of the whole text, over line ends, runs of BLOCK words or twice the longest template, a run
starting every half of it) is compared with license templates as sets of words: a block
matches if it contains at least ``threshold`` of a template's words.

The join is exact. Words of the templates are ordered by the number of documents of the whole corpus that hold them, rarest
first. A block that reaches the threshold must hold one of the first |T| - ceil(threshold * |T|) + 1 words of
the template (prefix filter), have enough words at all (length filter), and from the first common word
on both must have enough words left (positional filter); survivors are counted out. Only blocks that
hold a prefix word are ever laid out as rows. Template words and postings number a few hundred at most
(MAX_WORDS is checked), so they are literals and a broadcast table; texts never move.

Defined cases: null text is empty; a text without words has n_words 0, no base places, empty labels
and score 0. Repeated rows each get their result. An empty table gives an empty result. Columns other than doc_id and text are
ignored. score is 1 where a base phrase stands, else the best containment of a matched template, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ascii_lower, cut

#: Fixed values of the query: label, phrase.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: label, words of a license notice.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "released into the public domain under cc0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
THRESHOLD = 0.85
BLOCK = 64
MAX_WORDS = 5000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(lowered):
    return F.filter(F.split(lowered, NOT_WORD, -1), lambda x: x != "")


def _starts(lowered, tokens, phrase: str):
    """Where the words of phrase stand consecutively in tokens, by number from 0."""
    parts = phrase.split()
    may = F.lit(True)
    for p in parts:
        may = may & F.contains(lowered, F.lit(p))
    last = F.size(tokens) - len(parts)

    def stands(i):
        at = F.get(tokens, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            at = at & (F.get(tokens, i + k) == p)
        return at

    return F.when(may & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)).otherwise(F.array().cast("array<int>"))


def _blocks(lowered, size: int):
    """The word lists of the lines, long lines as overlapping runs of size words."""
    lines = F.transform(F.split(lowered, "\n", -1), words)

    def runs(line):
        step = size // 2
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(line) - step - 1, F.lit(0)), F.lit(step)), lambda i: F.slice(line, i + 1, size))
        return F.when(F.size(line) <= size, F.array(line)).otherwise(many)

    return F.flatten(F.transform(lines, runs))


def _runs(tokens, prefix, size: int, step: int):
    """Those runs of size words, one starting every step words, whatever lines they are in, that hold a word of prefix."""
    at = F.filter(F.transform(tokens, lambda x, i: F.when(F.array_contains(prefix, x), i)), lambda i: i.isNotNull())
    first = lambda i: (F.greatest(i - size + step, F.lit(0)) / step).cast("int") * step
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(first(i), i, F.lit(step)))))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))


def _strings(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def word_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """All words of the templates, those in the fewest documents first (ties by the word)."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"the templates have more than {MAX_WORDS} words")
    tokens = docs.select(words(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w"))
    counted = tokens.select(F.explode(F.array_intersect("w", _strings(vocabulary))).alias("word")).groupBy("word").count()
    found = {r.word: r["count"] for r in counted.collect()}  # at most MAX_WORDS rows
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    order = word_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted({rank[w] for w in text.split()})) for label, text in templates]
    postings = [(t, label, r, i, len(ranks), needed(len(ranks), threshold)) for t, (label, ranks) in enumerate(sets) for i, r in enumerate(ranks[: len(ranks) - needed(len(ranks), threshold) + 1])]
    prefix = _strings(sorted({order[p[2]] for p in postings}))
    vocabulary = _strings(order)
    least = min(needed(len(ranks), threshold) for _, ranks in sets)

    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    tokens = lowered.withColumn("w", words(F.col("t")))
    base = tokens.withColumn("places", F.array(*[_starts(F.col("t"), F.col("w"), p) for _, p in phrases]))
    # notices also go on over line ends, and long ones could fall between the runs of a line
    longest = max(len(text.split()) for _, text in templates)
    over = F.lit(True) if longest > block // 2 else F.contains(F.col("t"), F.lit("\n"))
    wide = F.when(over, _runs(F.col("w"), prefix, max(block, 2 * longest), max(1, longest // 2))).otherwise(F.array().cast("array<array<string>>"))
    blocks = F.concat(F.filter(_blocks(F.col("t"), block), lambda b: F.arrays_overlap(b, prefix)), wide)
    base = base.withColumn("blocks", F.when(F.arrays_overlap("w", prefix), blocks).otherwise(F.array().cast("array<array<string>>")))
    flat = F.flatten("places")
    label = F.array_compact(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(name)) for k, (name, _) in enumerate(phrases)]))
    # of a block only how many different words it has and the ranks of its template words are kept
    ranks = F.transform("blocks", lambda b: F.struct(F.size(F.array_distinct(b)).alias("n"), F.array_sort(F.transform(F.array_intersect(b, vocabulary), lambda x: F.array_position(vocabulary, x).cast("int") - 1)).alias("ranks")))
    rows = cut(base.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"), F.array_sort(F.array_distinct(label)).alias("base"), F.filter(ranks, lambda b: F.size(b["ranks"]) >= least).alias("blocks")))

    index = F.broadcast(spark.createDataFrame(postings, "template int, label string, rank int, place int, size int, need int"))
    members = F.broadcast(spark.createDataFrame([(t, ranks) for t, (_, ranks) in enumerate(sets)], "template int, members array<int>"))
    each = rows.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", F.col("b.n").alias("n"), F.col("b.ranks").alias("ranks"))
    hits = each.select("*", F.posexplode("ranks").alias("at", "rank")).join(index, "rank")
    hits = hits.where((F.col("n") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.size("ranks") - F.col("at") - 1) >= F.col("need")))
    scored = hits.join(members, "template").withColumn("share", F.size(F.array_intersect("ranks", "members")) / F.col("size"))
    found = scored.where(F.size(F.array_intersect("ranks", "members")) >= F.col("need")).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
