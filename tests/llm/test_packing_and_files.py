"""Packing and token files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from curbledger.llm import hilbert_packing as H
from curbledger.llm import token_files as T
from curbledger.llm.token_ids import ByteEncoder, WordEncoder, encoder
from curbledger.session import shared_folder

ODD = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "'s", "'", "é", " ", "　", "1", "!", "<|endoftext|>", "\r", "\x1c", "\x85", "́",
       "Σ", "ß", "日本", " the", " ", "\x00"]
rng = random.Random(7)
ROWS = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(60)))) for i in range(300)] + [
    (1000, None), (1001, ""), (None, "no id"), (None, None), (-5, "before all"), (7, "again"), (7, "again"), (2000, "word " * 30_000), (2001, "x" * 100_000)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind, name", [(ByteEncoder, H.TOKENIZER), (WordEncoder, T.TOKENIZER)])
def test_segments_give_the_same_ids(kind, name):
    e = encoder(kind, public_tokenizers.path(name))
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(20_000)] + [None, "", "İstanbul", "aİ bc", "x" * 200 + " y"]
    ids, bounds = e.texts(pa.array(texts))
    assert [t for t, a, b in zip(texts, bounds[:-1], bounds[1:]) if ids[a:b].tolist() != e.plain(t or "").tolist()] == []
    ids, bounds = e.texts(pa.array(["one", None, "two"]), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*e.plain("one"), 1], [1], [*e.plain("two"), 1]]
    assert e.texts(pa.array([], pa.string()), 1)[0].tolist() == []


def test_memory_generations(monkeypatch):
    monkeypatch.setattr("curbledger.llm.token_ids.KEEP", 5)
    e = ByteEncoder(public_tokenizers.path(H.TOKENIZER))
    for _ in range(6):
        t = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) for _ in range(50))
        assert e.texts(pa.array([t]))[0].tolist() == e.plain(t).tolist()


def test_hilbert_curve_visits_neighbours():
    bits, n = 3, 3
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")).reshape(n, -1).T
    keys = H.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rows", [ROWS, []])
def test_packing(spark, rows):
    tok = Tokenizer.from_file(public_tokenizers.path(H.TOKENIZER))
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, n int, row int")
    got = H.pack(docs.repartition(5)).collect()
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = {}
    for r in got:
        ids = np.frombuffer(r.ids, np.uint16)
        assert r.ids_crc32 == crc(ids) and len(ids) == r.length > 0 and r.offset + r.length <= H.LENGTH
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
    for d, texts in want.items():
        mine = sorted(p for k, ps in pieces.items() if k[0] == d for p in ps)
        if len(texts) == 1:
            assert sum((p for _, p in mine), []) == texts[0]
            assert [s for s, _ in mine] == np.cumsum([0] + [len(p) for _, p in mine[:-1]]).tolist()
        else:
            assert sum(len(p) for _, p in mine) == sum(map(len, texts))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == H.LENGTH or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_similar_documents_are_neighbours():
    texts = [" ".join(rng.choice(words) for _ in range(300)) for words in (["alpha", "beta", "gamma"], ["one", "two", "three"]) for _ in range(10)]
    e = encoder(ByteEncoder, public_tokenizers.path(H.TOKENIZER))
    keys = H.hilbert_keys(H.points(*e.texts(pa.array(texts))), H.BITS)
    first = np.argsort(keys)[:10]
    assert set(first // 10) in ({0}, {1})


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7, 7, 9], list(range(1000)), [0, 1 << 40], [(1 << 63) + 5],
                                    np.cumsum(np.random.default_rng(1).integers(0, 900, 70_000)).tolist()])
def test_elias_fano(values):
    about, parts = T.EliasFano.of(np.array(values, np.uint64)).sections()
    ef = T.EliasFano.read(about, b"".join(parts))
    assert ef.all().tolist() == values
    n = len(values)
    for i, j in [(0, n), (0, 0), (n // 3, n // 2), (n - 1, n), (max(0, n - 300), n), (1, min(n, 258))]:
        assert ef.between(i, j).tolist() == values[i:j] if n else True
    for limit in {0, *values[::97], *[v - 1 for v in values[1::131] if v], 1 << 62}:
        for known in {0, sum(v <= limit for v in values) // 2}:
            assert ef.upto(limit, known) == sum(v <= limit for v in values)
    for i in range(0, len(values), max(1, len(values) // 500)):
        assert ef.select(i) == values[i]
    if len(values) > 1000:
        assert ef.bits() < len(values) * (2.2 + np.log2(values[-1] / len(values)))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_files(spark, rows):
    tok = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    docs = spark.createDataFrame([(d, t, 0, "s") for d, t in rows], "doc_id long, text string, shard int, file string")
    folder = shared_folder(spark)
    written = T.write_files(docs.repartition(5), folder)
    got = sorted(T.read_files(written, folder).collect(), key=lambda r: r.start)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(d), len(i), crc(i)) for d, many in ids.items() for i in many)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    order = [T.NO_ID if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    for r in written.collect()[:2]:
        one = T.TokenFile(f"{folder}/{r.file}")
        docs_here = one.doc_ids()
        for i in (0, one.n_docs - 1):
            assert one.document(i).tolist() in ids[docs_here[i]]


def test_pieces_of_slices():
    blob = np.arange(10, dtype=np.uint16).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([10, 10]), pa.array([blob, blob], pa.binary()), pa.array([13, 23])], ["doc", "n", "ids", "upto"])
    out = pa.Table.from_batches(H._pieces(8, True)(iter([batch]))).to_pylist()
    assert [(r["doc"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in out] == [
        (1, 0, 5, 0, 3), (1, 5, 5, 1, 0), (2, 0, 3, 1, 5), (2, 3, 7, 2, 0)]


def test_small_blocks_are_read_through_select(spark, monkeypatch, tmp_path):
    """The files are read block by block: only the blocks' own bounds are decoded."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    folder = shared_folder(spark)
    T.write_files(docs, folder)
    source = T.TokenFile(f"{folder}/part-000000.ids")
    whole, seen = source.ends.all().tolist(), []
    monkeypatch.setattr(T.EliasFano, "all", None)
    monkeypatch.setattr(T, "READ_IDS", 500)
    monkeypatch.setattr(T, "TokenFile", lambda uri: source)
    for batch in T._read(folder)(iter([pa.RecordBatch.from_pylist([{"file": "part-000000.ids", "before": 10}])])):
        seen += list(zip(batch.column("start").to_pylist(), batch.column("n_tokens").to_pylist()))
    assert [s - 10 + n for s, n in seen] == whole and seen[0][0] == 10
