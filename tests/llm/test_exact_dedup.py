"""Exact deduplication against a dictionary of normalised texts, also with forced collisions."""

import hashlib
import re

import pytest

from curbledger.llm import exact_dedup as E

LONG = "lorem ipsum " * 500
ROWS = [
    (3, "a b"), (1, "a  b"), (2, "a\n\tb"), (4, "a b "), (5, " a b"), (6, None), (7, ""), (8, " "), (9, "\x0b\x0c\r"),
    (10, LONG), (11, LONG + "x"), (12, LONG), (12, LONG), (12, "other"), (None, "a b"), (None, None), (13, "é e"),
    (14, "é e"), (15, LONG[:-1] + "y"), (15, LONG),
] + [(i, "copy of one text") for i in range(100, 130)]


def brute(rows):
    groups = {}
    for doc, text in rows:
        t = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(t, []).append(E.NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        t = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        keep = min(groups[t])
        out.append((doc, None if keep == E.NO_ID else keep, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints_compose():
    data = bytes(range(256)) * 50
    for cut in (0, 1, 77, len(data)):
        parts = data[:cut], data[cut:]
        assert E.combine(E.fingerprint(parts[0]), E.fingerprint(parts[1]), len(parts[1])) == E.fingerprint(data)


@pytest.mark.parametrize("modulus", [E.MODULUS, 5])  # 5: nearly all texts of a length collide
@pytest.mark.parametrize("huge", [E.HUGE, 2])        # 2: nearly all texts go the way of huge ones
@pytest.mark.parametrize("rows", [ROWS, []])
def test_same_as_brute_force(spark, monkeypatch, modulus, huge, rows):
    monkeypatch.setattr(E, "MEMBERS", 7)
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, keep int, sha string")
    got = E.exact_groups(docs.repartition(3), modulus, huge, 64).collect()
    ours = [(None if r.doc == E.NO_ID else r.doc, None if r.keep == E.NO_ID else r.keep, r.group_size, r.sha.hex()) for r in got]
    assert sorted(ours, key=repr) == brute(rows)
    kept = [r.sha for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.sha for r in got})
    assert all(r.doc == r.keep for r in got if r.kept)


def test_stage_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = spark.createDataFrame([(d, t, "s", i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, print string, _n int")
    out = E.first_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in out.collect()]
    assert sorted(texts) == sorted({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in ROWS})
