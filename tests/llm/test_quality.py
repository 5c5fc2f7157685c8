"""Quality rules and weak labels: counts against plain loops, models on made-up corpora."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curbledger.llm import linear
from curbledger.llm import quality_rules as Q
from curbledger.llm import weak_labels as L
from curbledger.llm import words as W

rng = random.Random(10)
GOOD = ["the", "engine", "reads", "tables", "and", "writes", "partitions", "quickly", "été", "because", "order", "matters"]


def good(n=60):
    return ". ".join(" ".join(rng.choice(GOOD) + rng.choice("abcdefgh") for _ in range(9)).capitalize() for _ in range(n // 9)) + "."


def bad(n=60):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choice(GOOD) + rng.choice(["***", "$$$", "###"]) for _ in range(n))
    if kind == 1:
        return " ".join(rng.choice(GOOD).upper() + "!!" for _ in range(n))
    return "buy now cheap pills today\n" * (n // 5)


ROWS = [(i, good() if i % 4 else bad()) for i in range(800)]
ODD = [(5000, None), (5001, ""), (5002, " \n"), (None, good()), (5003, "one"), (5004, "w " * 100_000), (5005, "<|> " * 50),
       (5006, "a\na\n\n \nb\na "), (5007, "tie"), (5007, "tie")]
LABELS = [(i, int(i % 4 > 0), 0) for i in range(0, 800, 2)] + [(None, 1, 0), (5000, None, None), (2, 1, 0), (5001, 0, 0), (5001, 1, 0)]


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    cover = set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            cover.update(range(i, i + 5))
    n, r = len(words), len(cover)
    return (n, sum(len(x.decode()) for x in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, "kept", 0.5) for d, t in ROWS + ODD], "doc_id long, text string, score string, label double")
    return docs.repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_rules(spark, tables):
    got = Q.op10_quality_rules(*tables).collect()
    assert len(got) == len(ROWS + ODD)
    want = sorted((repr(d), *brute(t)) for d, t in ROWS + ODD)
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 800 and r.doc_id % 2]
    assert all(r.kept for r in unseen if r.doc_id % 4) and len(unseen) == 400
    trained_on = {r.doc_id: r.kept for r in got}
    assert sum(trained_on[i] == (i % 4 > 0) for i in range(0, 800, 2)) >= 398


def test_weak_labels(spark, tables):
    got = {r.doc_id: r for r in L.op9_weak_labels(*tables).collect()}
    right = [got[i].kept == (i % 4 > 0) for i in range(800)]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert L.op9_weak_labels(*tables).count() == len(ROWS + ODD)
    out = L.good_documents(*tables)
    assert out.columns == tables[0].columns and out.filter("doc_id < 800").count() == sum(r.kept for d, r in got.items() if d is not None and d < 800)


def test_without_labels_and_without_rows(spark, tables):
    docs, labels = tables
    none = labels.limit(0)
    got = {r.doc_id: r.kept for r in L.op9_weak_labels(docs, none).collect()}
    assert np.mean([got[i] == (i % 4 > 0) for i in range(800)]) > 0.9
    assert Q.op10_quality_rules(docs, none).filter("kept").count() > 0
    empty = docs.limit(0)
    assert L.op9_weak_labels(empty, none).collect() == [] and Q.op10_quality_rules(empty, labels).collect() == []


def test_expectation_maximisation_finds_accuracies():
    draw = np.random.default_rng(3)
    n = 40_000
    truth = draw.random(n) < 0.8
    right = np.array([[0.97, 0.4], [0.95, 0.3], [0.99, 0.45], [0.98, 0.98]])
    hit = draw.random((n, 4))
    votes = np.where(truth[:, None], (hit < right[:, 0]).astype(int), 1 - (hit < right[:, 1]))
    votes[draw.random((n, 4)) < 0.2] = 2
    pattern, count = np.unique(L.pattern_of(votes), return_counts=True)
    share, found, posterior = L.expectation_maximisation(pattern, count, 4)
    assert abs(share - 0.8) < 0.02 and np.abs(found - right).max() < 0.05
    guess = posterior[np.searchsorted(pattern, L.pattern_of(votes))] > 0.5
    assert (guess == truth).mean() > 0.95


def test_probabilities_are_calibrated():
    texts, labels = [], []
    for _ in range(3000):
        p = rng.choice([0.2, 0.5, 0.9])
        texts.append(" ".join(rng.choice(GOOD) for _ in range(30)) + f" grade{p} grade{p} grade{p}")
        labels.append(float(rng.random() < p))
    model = linear.fit(texts[:2000], np.array(labels[:2000]), np.ones(2000))
    model = linear.Model.of_bytes(model.to_bytes())
    part = pa.array(texts[2000:])
    p = model.probability(W.split(part), W.split(part, lower=True))
    for low, high in ((0, 0.35), (0.35, 0.7), (0.7, 1)):
        inside = (p >= low) & (p < high)
        if inside.sum() > 50:
            assert abs(p[inside].mean() - np.array(labels[2000:])[inside].mean()) < 0.12


def test_sample_is_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    rows = Q.sample(docs, labels, rows=500).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("w")).collect()
    assert all(400 < r.n < 600 for r in rows) and {round(r.w) for r in rows} == {4, 36}
