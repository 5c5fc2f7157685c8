"""Merge segmentation against the sentencepiece library, an agenda of its own, and round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from curbledger.llm import merge_dropout as M

PATH = public_tokenizers.path(M.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
rng = random.Random(9)
PARTS = ["the", "ing", "tion", " ", " ", "  ", "\n", "a", "é", "日本", "ß", "\t", "<s>", "</s>", "<0x41>", "!", "12", "x", "Ñ", "\U0001f600", "\x00"]
TEXTS = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(800)] + [
    "", " ", "\n", "a" * 500, "the quick brown fox " * 2000, "internationalization" * 30]


def ids(text, dropout, seed=1, doc=0):
    return M.Encoder(PATH, dropout, seed).texts([text], np.array([doc]))[0]


def test_without_dropout_as_the_library():
    got = M.Encoder(PATH, 0.0, 1).texts(TEXTS, np.arange(len(TEXTS)))
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [SP.encode(t) for t in TEXTS]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_side_by_side_as_one_by_one(dropout):
    p = M.pieces(PATH)
    segments = sorted({s for t in TEXTS for s in M._SEGMENT.findall(" " + t) if len(s) <= M.LONG}, key=len)
    keys = M._keys(3, [(s, 1) for s in segments])
    assert M.merge_many(p, segments, keys, dropout) == [M.merge_one(p, s, int(k), dropout) for s, k in zip(segments, keys)]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_lossless(dropout):
    texts = TEXTS + ["▁", "a ▁b"]
    p = M.pieces(PATH)
    for t, v in zip(texts, M.Encoder(PATH, dropout, 2).texts(texts, np.arange(len(texts)))):
        assert p.decode(v).decode() == t
        assert SP.decode(np.frombuffer(v, np.uint16).tolist()) == t or t.startswith(" ") or "\x00" in t


def test_varied_but_keyed():
    text = "segmentation of international considerations " * 40
    a = ids(text, 0.1)
    assert a == ids(text, 0.1)
    assert len({a, ids(text, 0.1, seed=2), ids(text, 0.1, doc=5), ids(text, 0.0)}) == 4
    assert len(ids(text, 0.0)) < len(a) < len(ids(text, 0.5)) < len(ids(text, 1.0))


def test_every_occurrence_is_drawn_by_itself():
    words = [" of", " considerations", " segmentation"]
    p, n = M.pieces(PATH), 3000
    for word in words:
        text = (word * n)[1:]
        got = np.frombuffer(ids(text, 0.1, doc=7), np.uint16)
        key = M.W.mixed(M.W.mixed(np.full(n, 7, np.uint64) + np.uint64(1)) + np.arange(n, dtype=np.uint64))
        want = [M.merge_one(p, word, int(k), 0.1) for k in key]
        assert got.tobytes() == b"".join(want)
        assert len(set(want)) > (1 if len(word) < 4 else 4)


def test_rate_of_skipped_candidates():
    n = 200_000
    got = M._skipped(np.arange(n, dtype=np.uint64), np.zeros(n, np.int64), np.full(n, 77), 0.1).mean()
    assert abs(got - 0.1) < 0.005


def test_frame(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (900, None), (901, "twice"), (901, "twice")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int")
    got = M.op5_merge_dropout(docs.repartition(3)).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert len({(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 901}) == 1
    assert [r.n_tokens for r in got if r.doc_id == 900] == [0]
    assert M.op5_merge_dropout(docs.limit(0)).collect() == []


def test_blocks_of_a_text_do_not_matter(monkeypatch):
    text = "internationalization of  the\n\n segments and their considerations " * 50
    whole = ids(text, 0.3, doc=4)
    for size in (1, 50, 999):
        monkeypatch.setattr(M, "SLICE", size)
        assert ids(text, 0.3, doc=4) == whole


def test_splits_of_one_piece_are_drawn_apart():
    n = 200_000
    key, zero = np.arange(n, dtype=np.uint64), np.zeros(n, np.int64)
    one, two = (M._skipped(key, zero, np.full(n, 77), 0.1, split) for split in (1, 2))
    assert abs((one & two).mean() - 0.01) < 0.002


def test_cuts_are_those_of_the_pattern():
    for t in [*TEXTS, "  a  \n b\n\n  c "]:
        assert "".join(M._SEGMENT.findall(" " + t)) == " " + t
        data = np.frombuffer((" " + t).encode(), np.uint8)
        line, blank = data == 10, data == 32
        cut = line.copy()
        cut[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        cut[0] = True
        at = [*np.flatnonzero(cut), len(data)]
        assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == M._SEGMENT.findall(" " + t)
