"""Components against union-find, few links and many, and the tasks that few links take."""

import random

import pytest

from tallyframe.llm import components as C


def brute(links):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {x: top(x) for x in parent if top(x) != x}


@pytest.mark.parametrize("few", [250_000, 0])
def test_components_of_chains_stars_and_loose_links(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    r = random.Random(5)
    links = [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    got = C.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == brute(links)


def test_few_links_take_few_tasks(spark):
    """With 211 shuffle partitions that nothing coalesces, a round of 40 links was 2,532 tasks, each with files of its own."""
    context = spark.sparkContext
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-links", "few links")
        assert {r.component for r in C.components(links).collect()} == {0}
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds}
        done = [i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))]
    finally:
        context._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < sum(done) < 2000, sum(done)
