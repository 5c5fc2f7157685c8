"""Language identification on made-up languages, and the filters against sets."""

import random
import zlib

import numpy as np
import pyarrow as pa

from curbledger.llm import language_id as L

rng = random.Random(8)
SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "ne"], "bb": ["ström", "gär", "lund", "ök"], "cc": ["слово", "мир", "дом", "лес"]}


def text(lang, n=25):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize()


ROWS = [(i, lang, text(lang)) for i in range(600) for lang in [rng.choice(sorted(SYLLABLES))]]
ODD = [(700, "aa", None), (701, None, "123 !!"), (702, "zz", ""), (None, "bb", text("bb")), (703, None, text("cc")), (704, "aa", text("aa", 30_000)),
       (705, "bb", "x"), (706, "aa", "a"), (706, "aa", "a")]


def test_predictions(spark):
    docs = spark.createDataFrame([(d, t, g, 1.0, "h") for d, g, t in ROWS + ODD], "doc_id long, text string, lang string, score double, held_out string")
    got = L.op8_language_id(docs.repartition(3)).collect()
    assert len(got) == len(ROWS + ODD)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == g for d, g, _ in ROWS)
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in ROWS)
    assert [by[d].lang_pred for d in (700, 701, 702, 703, 704)] == ["und", "und", "und", "cc", "aa"]
    assert not by[None].held_out and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_is_learnt_from_held_out_rows(spark):
    some = [(d, t, g) for d, g, t in ROWS]
    turned = [(d, t, "cc" if zlib.crc32(str(d).encode()) % 4 == 2 else g) for d, t, g in some]
    a, b = (sorted(map(tuple, L.op8_language_id(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect())) for r in (some, turned))
    assert a == b


def test_no_languages_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.op8_language_id(docs).collect()] == ["und"]
    assert L.op8_language_id(docs.limit(0)).collect() == []


def test_grams_are_those_of_the_text():
    texts = ["Ab  cd", "", None, "é", "x", "long enough\twords"]
    hashes, first = L.grams(pa.array(texts))
    def one(t):
        b = "".join(" " + w for w in (t or "").lower().split()).encode()
        b = b + b" " if b else b
        return [b[i:i + L.GRAM] for i in range(len(b) - L.GRAM + 1)]
    assert np.diff(first).tolist() == [len(one(t)) for t in texts]
    code = np.array([int.from_bytes(g, "big") for t in texts for g in one(t)], np.uint64)
    assert (hashes == L.W.mixed(code)).all()


def test_a_lookup_returns_all_languages_of_an_ngram():
    hashes, _ = L.grams(pa.array(["shared words", "only first"]))
    masks = np.zeros(L.CELLS, np.uint64)
    for cell in L.cells(hashes):
        masks[cell] |= np.uint64(1)
    half = L.grams(pa.array(["shared words"]))[0]
    for cell in L.cells(half):
        masks[cell] |= np.uint64(2)
    one, two = L.cells(half)
    assert (masks[one] & masks[two] == 3).all()


def test_texts_without_long_ngrams(spark):
    rows = [(d, g, t) for d, g, t in ROWS] + [(d + 10_000, "cc", text("cc")) for d, _, _ in ROWS]
    odd = [(20_000, None, "q"), (20_001, None, "ök"), (20_002, None, "ka"), (20_003, None, "zzzzqqqq"), (20_004, None, "7"), (20_005, None, "ok")]
    docs = spark.createDataFrame([(d, t, g) for d, g, t in rows + odd], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.op8_language_id(docs).collect()}
    assert [got[d].lang_pred for d in (20_000, 20_001, 20_002, 20_003, 20_004)] == ["cc", "bb", "aa", "cc", "und"]
    assert got[20_005].lang_pred in SYLLABLES and got[20_001].score > 0 and got[20_000].score >= 0
    assert all(got[d].lang_pred == g for d, g, _ in rows)


def test_short_grams_are_those_of_the_text():
    hashes, owner = L.short_grams(pa.array(["X", "", "ok no"]))
    whole = [b" x ", b"", b" ok no "]
    want = [(n, g) for n, b in enumerate(whole) for k in range(1, L.GRAM) for g in [b[i:i + k] for i in range(len(b) - k + 1)]]
    code = np.array([(len(g) << 40) + int.from_bytes(g, "big") for _, g in want], np.uint64)
    assert sorted(zip(owner.tolist(), hashes.tolist())) == sorted(zip([n for n, _ in want], L.W.mixed(code).tolist()))


def test_no_jump_between_199_and_200_documents(spark):
    """One document more of a language changes next to nothing, at any size."""
    sizes = (199, 200, 201)
    texts = [(text("aa", 6), text("bb", 6)) for _ in range(max(sizes))]
    new = [text(g, 3) + " " + text(h, 3) for g in ("aa", "bb") for h in ("aa", "bb") for _ in range(40)]
    out = []
    for n in sizes:
        ids = [d for d in range(5000) if zlib.crc32(str(d).encode()) % 4 != 2][:2 * n]
        rows = [(d, texts[k // 2][k % 2], ("aa", "bb")[k % 2]) for k, d in enumerate(ids)]
        filters = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=10 ** 6)
        out.append((filters.predict(pa.array(new)), int((filters.masks > 0).sum())))
    (first, score), cells = out[0]
    for (best, other), used in out[1:]:
        assert (best == first).mean() >= 0.98 and np.abs(other - score).max() < 0.1
        assert abs(used - cells) < 0.03 * cells


def test_more_languages_than_bits(spark):
    ids = [d for d in range(9000) if zlib.crc32(str(d).encode()) % 4 != 2]
    words = {f"l{k:02d}": ["".join(random.Random(k * 10 + j).choices("abcdefghijklmnop", k=7)) for j in range(6)] for k in range(70)}
    make = lambda g: " ".join(rng.choice(words[g]) for _ in range(8))
    rows = [(d, make(g), g) for d, g in zip(ids, [g for g in words for _ in range(5)])]
    filters = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.masks.shape == (2, L.CELLS)
    best, _ = filters.predict(pa.array([make(g) for g in words]))
    assert [filters.names[b] for b in best] == list(words)


def test_verdict_as_with_plain_sets(spark):
    """Counts of n-grams found in sets, without filters and corrections, give the same languages."""
    known = [(d, g, t) for d, g, t in ROWS if zlib.crc32(str(d).encode()) % 4 != 2]
    have = {g: {} for g in SYLLABLES}
    for d, g, t in known:
        for h in set(L.grams(pa.array([t]))[0].tolist()):
            have[g][h] = have[g].get(h, 0) + 1
    size = {g: sum(x == g for _, x, _ in known) for g in have}
    code = [(g, h - (1 << 64) if h >> 63 else h, n) for g in have for h, n in have[g].items()]
    part = {(r.g, r.h): r.n >= L.LEAST_SHARE * size[r.g] + r.u for r in spark.createDataFrame(code, "g string, h long, n long").selectExpr(
        "*", f"pmod(xxhash64(h), {L._SPOTS}) / {L._SPOTS} AS u").collect()}
    sets = {g: {h for h in have[g] if part[g, h - (1 << 64) if h >> 63 else h]} for g in have}
    texts = [text(rng.choice(sorted(SYLLABLES)), rng.randint(2, 9)) for _ in range(200)]
    filters = L.train(spark.createDataFrame([(d, t, g) for d, g, t in known], "doc_id long, text string, lang string"))
    best, _ = filters.predict(pa.array(texts))
    for t, b in zip(texts, best):
        counts = {g: sum(h in sets[g] for h in L.grams(pa.array([t]))[0].tolist()) for g in have}
        assert counts[filters.names[b]] == max(counts.values())
