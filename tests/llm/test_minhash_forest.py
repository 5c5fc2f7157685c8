"""Near-duplicate components against all pairs."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from curbledger.llm import minhash_forest as M
from curbledger.session import ensure_checkpoint_dir


def sets(text, size):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if len(words) >= size else {tuple(words)}


def brute(rows, size=4):
    all_sets = [sets(t, size) for _, t in rows]
    key = [M.NO_ID if d is None else d for d, _ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(all_sets):
        for j in range(i):
            b = all_sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), key[i]), key[i])
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[top(i)]
        out.append((d, len(all_sets[i]), None if c == M.NO_ID else c, c == key[i]))
    return sorted(out, key=repr)


def corpus(seed, groups=12, size=12, words=120, edits=6):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(50))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, words))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else " ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def chain(n=40, words=200):
    rng = random.Random(3)
    text = [str(rng.random()) for _ in range(words)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(text)))
        text[(i * 5) % words] = str(rng.random())
        text[(i * 7 + 3) % words] = str(rng.random())
    return rows


CASES = {
    "groups": corpus(1), "many edits": corpus(2, edits=14), "one large group": corpus(3, groups=2, size=90, edits=5), "chain": chain(),
    "odd": [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (None, "a b"), (8, "x " * 500), (9, "x x x x"),
            (10, "x x x"), (11, "É a"), (12, "é a"), (13, "q w e r"), (13, "q w e r"), (13, "z z"), (14, "y" * 200_000), (15, None)],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_same_as_all_pairs(spark, name):
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in CASES[name]], "doc_id long, text string, component int, node string")
    got = M.op3_minhash_forest(docs.repartition(3)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=repr) == brute(CASES[name])


def template(n=1000, own=18, words=126, seed=5):
    """Texts that share a template at 0.75 or less with one another, and 60 hidden pairs of 0.8 and a little more."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(words - own)]
    texts = [base + [str(rng.random()) for _ in range(own)] for _ in range(n)]
    for k in range(60):  # the pair shares a part of its end
        texts[n - 1 - k] = texts[k][:-12] + [str(rng.random()) for _ in range(12)]
    rows = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(rows)
    return rows


def test_pairs_hidden_among_texts_of_one_template(spark):
    rows = template()
    some = dict(rows)
    known = [100 * len(a & b) / len(a | b) for a, b in ((sets(some[x], 4), sets(some[y], 4)) for x, y in [(0, 999), (0, 1), (500, 999)])]
    assert 80 <= known[0] < 85 and 70 <= known[1] <= 76 and 70 <= known[2] <= 76
    got = M.op3_minhash_forest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, 999 - d if d > 939 else d) for d, _ in rows)


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(d, t, 5) for d, t in CASES["groups"]], "doc_id long, text string, tag int")
    out = M.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, _, kept in brute(CASES["groups"], 5) if kept)


def test_stage_with_repeated_and_missing_ids(spark):
    text = lambda k, end: " ".join([f"{k}w{i}" for i in range(100)] + [end])
    rows = [(3, text("a", "x")), (5, text("a", "y")), (5, text("b", "x")), (6, text("c", "x")), (6, text("c", "y")),
            (None, text("d", "x")), (None, text("d", "y")), (None, text("e", "x")), (7, text("e", "y")), (8, None), (8, "")]
    out = [tuple(r) for r in M.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(out) == len(set(out)) == 7
    assert {rows[0], rows[2], rows[7], (8, None), (8, "")} < set(out)
    assert len({rows[3], rows[4]} & set(out)) == len({rows[5], rows[6]} & set(out)) == 1


def test_signatures_estimate_similarity():
    a = " ".join(str(i) for i in range(2000))
    b = " ".join(str(i) for i in range(400, 2000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([a, b])], ["doc", "tag", "text"])
    out = next(M._sketch(4)(iter([batch])))
    x, y = (np.frombuffer(v, np.uint32) for v in out.column("signature").to_pylist())
    assert 0.6 < (x == y).mean() < 0.95


@pytest.mark.parametrize("lead", [[], ["a", "b", "c"]])
def test_unequal_words_of_equal_polynomials(spark, lead):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(k, " ".join([*lead, "".join(letters[b] for b in bits)])) for k, letters in ((1, "ab"), (2, "ba"))]
    got = M.op3_minhash_forest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_rounds_leave_no_files(spark):
    """The result reads the sketches, the labels and the groups' first documents; other steps' files go."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    docs = spark.createDataFrame(corpus(3, groups=4, size=6), "doc_id long, text string")
    before = set(os.listdir(folder))
    found = M.near_components(docs, shingle=4)
    assert len(set(os.listdir(folder)) - before) <= 3
    assert found.count() == docs.count()
