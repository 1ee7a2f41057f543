"""Brute-force versions of the operators, and small tables with every odd case."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Null, empty and very long texts, ties and repeated rows, nulls in every column."""
    long_text = " ".join(f"word{k % 997} filler{k % 13}" for k in range(60_000))
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew another pot of very strong tea in the hall"
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n", None, "b", 3),
        (4, base, "en", "a", 1),
        (5, base.upper(), "en", None, 1),
        (5, base.upper(), "en", None, 1),
        (6, base + " now", "en", "b", 1),
        (None, base + " then", "en", "b", 1),
        (7, long_text, "en", "a", 1),
        (8, long_text + " end", "en", "c", 1),
        (9, "x", None, "c", None),
        (10, "12345 $$$", "en", "c", 9),
        (11, "Été ça va très bien, merci beaucoup à vous — 漢字 \U0001f600", "fr", "c", 9),
        (12, "Licensed under the Apache License, Version 2.0.\nAll rights reserved. All   RIGHTS-reserved", "en", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def with_clashing(df):
    """df with more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    for name in ("row", "fp", "size", "rank", "kept", "key", "bucket", "score", "plan", "at", "gone", "lang_pred", "recipe", "n", "cls", "length"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def jaccard_components(rows, words, percent):
    """doc_id -> (set size, smallest doc_id of the component), of rows with different ids."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = set() if not w else {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}
