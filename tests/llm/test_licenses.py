import re

from pyspark.sql import functions as F

from tallyframe.llm import licenses as L
from tests.llm.helpers import lower, odd_documents, with_clashing

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    t = lower(text)
    w = WORDS.findall(t)
    starts, base = [], set()
    for label, phrase in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        if at:
            base.add(label)
    best, more = 0.0, set()
    for line in t.split("\n"):
        x = WORDS.findall(line)
        runs = [x] if len(x) <= L.BLOCK else [x[i : i + L.BLOCK] for i in range(0, len(x) - L.BLOCK // 2, L.BLOCK // 2)]
        for r in runs:
            for label, template in L.TEMPLATES:
                words = set(template.split())
                n = len(words & set(r))
                if n >= L.needed(len(words), L.THRESHOLD):
                    more.add(label)
                    best = max(best, n / len(words))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if starts else best


def test_equals_brute_force(spark):
    long_line = "filler " * 100 + "licensed under the Apache License version 2.0 " + "filler " * 100
    texts = [long_line, "CC-BY cc by.CC\nBY", "cc bye", "éccé by", "Released under the MIT License, ok", "released under the license", "GENERAL  PUBLIC-LICENSE general public license", "this work is licensed under the gnu general license version 3"]
    d = odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    got = L.scan(with_clashing(d.withColumn("source", F.lit("s"))))
    rows = {}
    for r in got.collect():
        rows.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score))
    want = {}
    for r in d.collect():
        want.setdefault(r.doc_id, []).append(brute(r.text))
    assert rows == want
    assert rows[100][0][5] == "apache" and rows[104][0][5] == "mit" and rows[105][0][5] == ""


def test_wrapped_and_long_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files"
    texts = ["other words\n" + bsd, "a b c\n" * 200 + mit + "\nx" * 200, "Licensed under the Apache\nLicense, Version 2.0", "Licensed under the\nlicense"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in L.scan(d).orderBy("doc_id").collect()] == ["bsd", "mit", "apache", ""]
    long = [" ".join(f"w{k}" for k in range(n)) for n in (60, 90)]
    d = spark.createDataFrame([(k, "x " * 16 + t + " y" * 100) for k, t in enumerate(long)], "doc_id long, text string")
    assert [r.labels for r in L.scan(d.where("doc_id = 0"), templates=(("a", long[0]),)).collect()] == ["a"]
    assert [r.labels for r in L.scan(d.where("doc_id = 1"), templates=(("b", long[1]),)).collect()] == ["b"]


def test_empty_table(spark):
    assert L.scan(odd_documents(spark).limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = L.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
