"""Connected components against a union-find over random graphs, chains and hubs."""

import os
import random

import pytest

from curbledger.llm.components import connected, extended
from curbledger.session import discard, ensure_checkpoint_dir, stored


def brute(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
    return {x: top(x) for x in list(root)}


rng = random.Random(5)
CHAIN = list(range(300))
rng.shuffle(CHAIN)


@pytest.mark.parametrize("links", [
    [],
    [(1, 1), (None, 2), (3, None)],
    [(5, 1), (1, 5), (2, 5), (9, 8)],
    list(zip(CHAIN, CHAIN[1:])),
    [(0, k) for k in range(1, 200)],
    [(rng.randrange(150), rng.randrange(150)) for _ in range(90)],
])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in connected(frame).collect()} == brute(links)


def folders(spark):
    return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))


@pytest.mark.parametrize("n", [0, 1, 40, 90])
def test_more_links_give_what_all_links_give(spark, n):
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    label = connected(spark.createDataFrame(links[:n], "a long, b long"))
    root = {r.node: r.root for r in label.collect()}
    more = [(root.get(a, a), root.get(b, b)) for a, b in links[n:]]
    found = extended(label, spark.createDataFrame(more, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == brute(links)


def test_steps_leave_no_files(spark):
    """On many partitions the small files of all steps took more disk than the documents."""
    before = folders(spark)
    label = connected(spark.createDataFrame(list(zip(CHAIN, CHAIN[1:])), "a long, b long"))
    assert len(folders(spark) - before) == 1
    label = extended(label, spark.createDataFrame([(0, 300)], "a long, b long"))
    assert len(folders(spark) - before) == 1
    discard(label, label.select("node"))
    assert folders(spark) == before


def test_discard_leaves_other_frames(spark):
    kept = stored(spark.range(10))
    discard(kept.filter("id > 3"), spark.range(3))
    assert kept.count() == 10
