"""Every stage of the pipeline against a brute-force version, each on what its predecessor kept."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from curbledger.llm import hilbert_packing, weak_labels
from tests.llm import test_minhash_forest as near
from tests.llm import test_substring_dedup as sub

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {}, docs.columns
    current = docs
    for name, stage in P.STAGES:
        current = P.stored(stage(spark, current, SF))
        kept[name] = current.collect()
        assert name == "packing" or current.columns == columns
    few = docs.select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.kept for r in weak_labels.op9_weak_labels(few, labels).collect()}
    rows = [(r.doc_id, r.text) for r in kept["quality_classifier"]]
    assert {d for d, _ in rows} == {d for d, k in scores.items() if k} and len(rows) > 100

    first = {}
    for d, t in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), d)
    rows = sorted((r.doc_id, r.text) for r in kept["exact_dedup"])
    assert [d for d, _ in rows] == sorted(first.values())

    stay = {d for d, _, _, k in near.brute(rows, 5) if k}
    rows = sorted((r.doc_id, r.text) for r in kept["near_dedup"])
    assert {d for d, _ in rows} == stay

    want = {d: (n, gone, sha) for d, n, gone, sha in sub.brute(rows) if gone == 0 or gone < n}
    rows = sorted((r.doc_id, r.text) for r in kept["substring_dedup"])
    assert [d for d, _ in rows] == sorted(want)
    assert all(sub.hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() == want[d][2] for d, t in rows)

    tok = Tokenizer.from_file(public_tokenizers.path(hilbert_packing.TOKENIZER))
    total = {}
    for r in kept["packing"]:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}


NAMES = ["tag", "_doc", "_sha", "_tag", "_rows", "rest", "found", "doc", "sha", "rows", "row", "score", "kept", "node", "root", "spot", "label", "part"]


def test_own_columns_come_back_from_every_stage(spark):
    words = " ".join(f"word{i} and" for i in range(60)) + "."
    rows = [(1, words), (2, words), (2, words), (None, "A line of its own, with ten words and some more."), (3, words + " end"), (4, None), (4, "x " * 40)]
    docs = spark.createDataFrame([(d, t, "l", "s", len(t or ""), *[f"mine {n}" for n in NAMES]) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"mine {n}" for r in got for n in NAMES), name


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b"), (7, "a b"), (7, "a b"), (7, "c"), (8, "")]])
def test_odd_tables_run_through(spark, tmp_path, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "mine") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tag string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {d for d, _ in rows}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
