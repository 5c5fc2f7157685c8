"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: cell i holds masks of 64 bits with bit l set if language l
set cell i.  An n-gram (five bytes of the lower-cased text, words apart by one space) looks up two
cells; the AND of their masks is the set of all languages that contain it.  For each language the n-grams
of a text are counted (a popcount of its bit), and the count is corrected for the false positives that
the filter's fill lets expect.  The language with the largest corrected count is the answer.  A text without any
known n-gram of five bytes (a word of one or two letters has none at all) is judged by its n-grams of one to
four bytes, spaces included, which are in the same filters.  Of equal counts, zeros too, the language with more
training documents wins.

A language contains the n-grams that at least `LEAST_SHARE` of its training documents have, and a part of one
document: the part is a hash of the n-gram, so the fewer documents a language has, the more of its rare
n-grams count, without a size at which that begins.  Since the text of a document has finitely many, this bounds
the filter's load whatever the size of the corpus; the filter itself is `CELLS` masks (8 MB for each 64
languages).  Training takes about `FIT_ROWS` documents of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.llm import words as W

FIT_ROWS = 4000
LEAST_SHARE = 0.004
CELLS = 1 << 20
GRAM = 5
LANGUAGES = 64       # bits of a mask; more languages have further masks
SLICE = W.SLICE_BYTES // 4
HELD_OUT = 2         # crc32(doc_id) mod 4 of documents that training never sees
_SPOTS = 1 << 30


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def grams(texts: pa.Array, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of `size` bytes of every text, and the texts' bounds among them."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    w = W.split(lower)
    # the words again, each with a space before and one behind the last
    sizes = w.ends - w.starts + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.full(begin[-1] + 1, 32, np.uint64)
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    at = np.flatnonzero(inner > 0)
    data[at] = w.data[(np.repeat(w.starts, sizes) + inner - 1)[at]]
    bounds = begin[w.first]  # a text's n-grams start in it and may end in the space that follows
    lengths = np.maximum(np.diff(bounds) + 1 - (size - 1), 0) * (np.diff(bounds) > 0)
    first = np.concatenate([[0], np.cumsum(lengths)])
    start = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], lengths)
    code = np.zeros(len(start), np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | data[start + k]
    if size < GRAM:  # no short one is equal to one of five bytes
        code += np.uint64(size << 8 * GRAM)
    return W.mixed(code), first


def short_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of one to four bytes and their texts' numbers."""
    found = [grams(texts, size) for size in range(1, GRAM)]
    return np.concatenate([h for h, _ in found]), np.concatenate([np.repeat(np.arange(len(texts)), np.diff(first)) for _, first in found])


def cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(CELLS - 1)).astype(np.int64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents by language and n-gram, added up for each slice."""
    for part in W.slices(batches, "text", size=SLICE):
        hashes, first = grams(part.column("text"))
        language = part.column("language").to_numpy()
        short, owner = short_grams(part.column("text"))
        hashes, owner = np.concatenate([hashes, short]), np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(first)), owner])
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, lang = h[new], language[o[new]]
        order = np.lexsort((h, lang))
        h, lang = h[order], lang[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])
        at = np.flatnonzero(head)
        yield pa.RecordBatch.from_arrays([pa.array(lang[at].astype(np.int32)), pa.array(h[at].view(np.int64)),
                                          pa.array(np.diff(np.append(at, len(h))))], ["language", "h", "n"])


class Filters:
    """The trained filters: language names in order, the masks, and the languages' training documents."""

    def __init__(self, names: list[str], masks: np.ndarray, documents: list[int]) -> None:
        self.names, self.masks, self.documents = names, masks.reshape(-1, CELLS), documents
        self.order = np.argsort(-np.array(documents, np.int64), kind="stable")  # who wins of equals
        fill = np.array([self._bit(self.masks[b // LANGUAGES], b).mean() for b in range(len(names))])
        self.false = np.minimum(fill * fill, 0.999)  # two cells must be set by chance

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks >> np.uint64(language % LANGUAGES)) & np.uint64(1)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score of every text (-1 without words or languages)."""
        hashes, first = grams(texts)
        if not self.names:
            return np.full(len(texts), -1), np.zeros(len(texts))
        true, n = self._counts(hashes, first)
        few = np.flatnonzero(true.max(axis=1, initial=0.0) <= 0)
        if len(few):
            short, owner = short_grams(texts.take(pa.array(few)))
            by = np.argsort(owner, kind="stable")
            true[few], n[few] = self._counts(short[by], np.searchsorted(owner[by], np.arange(len(few) + 1)))
        best = self.order[true[:, self.order].argmax(axis=1)]
        return np.where(n > 0, best, -1), np.clip(true.max(axis=1, initial=0.0) / np.maximum(n, 1), 0.0, 1.0)

    def _counts(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts by text and language, and the texts' numbers of n-grams."""
        one, two = cells(hashes)
        found = [masks[one] & masks[two] for masks in self.masks]
        n = np.diff(first).astype(np.float64)
        counts = np.stack([W.per_text(self._bit(found[b // LANGUAGES], b).astype(np.float64), first) for b in range(len(self.names))], axis=1)
        return np.maximum((counts - n[:, None] * self.false) / (1 - self.false), 0.0), n


def train(docs: DataFrame, rows: int = FIT_ROWS) -> Filters:
    """Learns from text and lang of documents that are not held out, about `rows` for each language."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # languages are few
    names = sorted(counts)
    if not names:
        return Filters([], np.zeros(CELLS, np.uint64), [])
    spot = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(_SPOTS))
    mine = F.lit(None).cast("int")
    for i, name in enumerate(names):
        mine = F.when((F.col("lang") == name) & (spot < int(_SPOTS * min(1.0, rows / counts[name]))), i).otherwise(mine)
    chosen = known.select(mine.alias("language"), "text").filter("language IS NOT NULL")
    frequent = chosen.mapInArrow(_distinct, "language int, h long, n long").groupBy("language", "h").agg(F.sum("n").alias("n"))
    share = F.element_at(F.array(*[F.lit(LEAST_SHARE * min(rows, counts[x])) for x in names]), F.col("language") + 1)
    load = frequent.filter(F.col("n") >= share + F.pmod(F.xxhash64("h"), F.lit(_SPOTS)) / F.lit(_SPOTS))
    spots = load.select("language", F.explode(F.array(F.col("h").bitwiseAND(CELLS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(CELLS - 1))).alias("cell"))
    word = F.floor(F.col("language") / LANGUAGES).cast("int")
    masks = spots.groupBy(word.alias("word"), "cell").agg(F.expr(f"bit_or(shiftleft(1L, language % {LANGUAGES}))").alias("mask"))
    # at most CELLS rows for each 64 languages, as packed arrays
    packed = masks.groupBy("word", F.pmod("cell", F.lit(16)).alias("p")).agg(F.collect_list("cell").alias("c"), F.collect_list("mask").alias("m"))
    out = np.zeros((-(-len(names) // LANGUAGES), CELLS), np.uint64)
    for row in packed.toLocalIterator():
        out[row.word, np.array(row.c)] = np.array(row.m, np.int64).view(np.uint64)
    return Filters(names, out, [counts[x] for x in names])


def _predicted(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Filters(*filters.value)
        names = np.array([*ready.names, "und"], object)
        for part in W.slices(batches, "text", size=SLICE):
            best, score = ready.predict(part.column("text"))
            letter = part.column("has_letter").to_numpy(zero_copy_only=False)
            best = np.where(letter, best, -1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()),
                                              pa.array(np.where(best >= 0, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score: only the text decides; `und` without letters or languages."""
    sent = docs.sparkSession.sparkContext.broadcast((filters.names, filters.masks, filters.documents))  # 8 MB for each 64 languages, whatever the input
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("has_letter"), "text")
    return rows.mapInArrow(_predicted(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(docs: DataFrame) -> DataFrame:
    """A NULL doc_id is never held out; a NULL lang teaches nothing."""
    return predict(docs, train(docs))
