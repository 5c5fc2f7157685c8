"""Fill-in-middle against plain slicing of lines, and the learned index against all bounds."""

import hashlib
import re

import numpy as np
import pytest

from curbledger.llm import fill_middle as M

TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é\nüß\n漢字\n\U0001f600 x\r\ny", "a <P> b\nc", "<S>", "x<M", "<", "a<\nS>b\n<\n",
    "\n".join("w" * (i % 37) for i in range(400)), "x" * 5000 + "\n" + "y\n" * 900, "l\n" * 3000 + "long" * 9000, "z" * 200_000,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(i + 100, t) for i in range(12) for t in TEXTS[5:9]] + [(None, "a\nb\nc"), (5, "one\n"), (-3, "p\nq")]


def brute(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


@pytest.mark.parametrize("error", [0, 1, 60, 120])
def test_every_bound_comes_back_from_prediction_and_residual(error):
    rng = np.random.default_rng(5)
    cases = [M.line_bounds(t or "") for t in TEXTS] + [np.cumsum(np.r_[0, rng.geometric(p, 3000)]) for p in (0.9, 0.05, 0.0003)]
    for bounds in cases:
        index = M.fit(bounds, error)
        assert [M.bound(index, k) for k in range(len(bounds))] == bounds.tolist()
        assert np.abs(bounds - M.predicted(index[:3], np.arange(len(bounds)))).max() <= error + 1


def test_even_lines_need_one_segment():
    assert len(M.fit(np.arange(50_000) * 81)[0]) == 1


@pytest.mark.parametrize("rate, spm, seed", [(100, 50, 7), (60, 0, 7), (60, 100, 1), (0, 50, 7)])
def test_same_as_plain_slicing(spark, rate, spm, seed):
    docs = spark.createDataFrame([(t, i, "plain", 1) for i, t in ROWS], "text string, doc_id long, form string, n int").repartition(3)
    got = M.fill_in_middle(docs, rate, spm, seed).withColumn("back", M.restored(M.F.col("form"), M.F.col("output"))).collect()
    ours = [(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back) for r in got]
    theirs = [(i, *brute(i, t, rate, spm, seed), t or "") for i, t in ROWS]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)
    assert all(len(r.residuals) == r.n + 1 for r in got)


def test_empty_table(spark):
    assert M.op13_fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_is_its_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    theirs = duckdb.connect().execute(M.OP13_SQL.replace("FROM documents", f"FROM '{path}'"))
    names = [c[0] for c in theirs.description]
    ours = M.op13_fill_middle(spark.read.parquet(path)).select(*names).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs.fetchall())
