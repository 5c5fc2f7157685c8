"""Token-id files: concatenated ids with Elias-Fano document boundaries.

A file has, in this order:

* ids of all its documents, one after the other, 16 bits each, little-endian;
* the documents' ends (in ids) and the documents' ids less the first, each an ascending list in
  Elias-Fano form: the low bits of every value side by side, the high bits in unary as a bit
  string, and the places of every 256th one in it (32 or 64 bits) to start a select from.  That is
  about 2 + log2(largest / n) bits a value;
* a JSON footer with the places of these sections, its length in 8 bytes, and `MAGIC`.

Files hold ascending ranges of document ids.  They are written under a name of the attempt's own
and then moved, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbledger.llm.token_ids import SLICE, WordEncoder, crcs, encoder
from curbledger.llm.words import slices
from curbledger.session import shared_folder, stored

MAGIC = b"IDSEF001"
END = 2
TOKENIZER = "word_bpe_49k.json"
STEP = 256          # ones between two select places
READ_IDS = 1 << 20  # ids read from a file at once
NO_ID = -(1 << 63)  # stands for a NULL document id: before all others


class EliasFano:
    """An ascending list of numbers from 0 on, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        largest = int(values[-1]) if n else 0
        bits = max(0, (largest // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits and n:
            parts = [np.packbits(((block[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
                     for block in (values[i:i + (1 << 15)] for i in range(0, n, 1 << 15))]  # blocks end at whole bytes
            low = np.concatenate(parts)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (128 >> (ones & 7)).astype(np.uint8))
        kind = np.uint32 if not n or int(ones[-1]) < 1 << 32 else np.uint64
        return cls(n, bits, low, high, ones[::STEP].astype(kind))

    def sections(self) -> tuple[dict, list[bytes]]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.places.tobytes()]
        return {"n": self.n, "low_bits": self.low_bits, "place_bytes": self.places.itemsize, "sizes": [len(p) for p in parts]}, parts

    @classmethod
    def read(cls, about: dict, data: bytes) -> EliasFano:
        a, b, _ = np.cumsum(about["sizes"])
        kind = np.uint32 if about["place_bytes"] == 4 else np.uint64
        return cls(about["n"], about["low_bits"], np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:], kind))

    def all(self) -> np.ndarray:
        """All values, as unsigned 64-bit numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high))[:self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        for at in range(0, self.n if self.low_bits else 0, 1 << 15):
            m = min(1 << 15, self.n - at)
            first = at * self.low_bits // 8
            bits = np.unpackbits(self.low[first:first + (m * self.low_bits + 7) // 8])[:m * self.low_bits].reshape(m, self.low_bits)
            out[at:at + m] |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def _one(self, i: int) -> int:
        """Where one number i stands among the high bits, from the nearest select place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        one, left = int(self.places[i // STEP]), i % STEP
        byte = one >> 3
        bits = np.unpackbits(self.high[byte:byte + 1])
        bits[:one & 7] = 0
        while (count := int(bits.sum())) <= left:
            left -= count
            byte += 1
            bits = np.unpackbits(self.high[byte:byte + 1])
        return byte * 8 + int(np.flatnonzero(bits)[left])

    def select(self, i: int) -> int:
        """Value i, without reading the rest."""
        one = self._one(i)
        low, begin = 0, i * self.low_bits
        for k in range(self.low_bits):
            at = begin + k
            low |= (int(self.low[at >> 3]) >> (7 - (at & 7)) & 1) << k
        return (one - i) << self.low_bits | low

    def between(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, from their own high and low bits alone."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = self._one(i), self._one(j - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[first >> 3:(last >> 3) + 1])) + (first >> 3 << 3)
        ones = ones[(ones >= first) & (ones <= last)]
        out = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            begin, end = i * self.low_bits, j * self.low_bits
            bits = np.unpackbits(self.low[begin >> 3:(end + 7) >> 3])[begin & 7:][:end - begin].reshape(j - i, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def upto(self, value: int, i: int) -> int:
        """How many values are at most `value`; at least i of them are known to be.  By bisection over select."""
        step = 1
        while i + step <= self.n and self.select(i + step - 1) <= value:
            i, step = i + step, 2 * step
        while step:
            if i + step <= self.n and self.select(i + step - 1) <= value:
                i += step
            step //= 2
        return i

    def bits(self) -> int:
        return 8 * (self.low.nbytes + self.high.nbytes + self.places.nbytes)


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path, of whatever store the folder is in."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return arrow_fs.FileSystem.from_uri(uri)


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        length = int.from_bytes(tail[:8], "little")
        self.about = json.loads(self.file.read_at(length, size - 16 - length))
        at, lists = 2 * self.about["n_ids"], []
        for name in ("ends", "docs"):
            total = sum(self.about[name]["sizes"])
            lists.append(EliasFano.read(self.about[name], self.file.read_at(total, at)))
            at += total
        self.ends, self.docs = lists
        self.n_docs = self.ends.n

    def doc_ids(self, start: int = 0, end: int | None = None) -> list[int | None]:
        end, null = self.n_docs if end is None else end, self.about["n_null"]
        known = self.docs.between(max(0, start - null), max(0, end - null))
        return [None] * max(0, min(end, null) - start) + [int(v) + self.about["first_doc"] for v in known]

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(2 * (end - start), 2 * start), "<u2")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def close(self) -> None:
        self.file.close()


def _write(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(WordEncoder, path)
        shard = TaskContext.get().partitionId()
        store, root = opened(folder)
        name = f"{root}/part-{shard:06d}.ids"
        own = f"{root}/_attempt-{uuid.uuid4().hex}"
        counts, docs, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None
        for part in slices(batches, "text", size=SLICE):
            if out is None:
                out = store.open_output_stream(own)
            ids, bounds = encode.texts(part.column("text"), END)
            out.write(ids.astype("<u2").tobytes())
            counts.append(np.diff(bounds))
            docs.append(part.column("doc").to_numpy())
        if out is None:
            return
        ends, doc = np.cumsum(np.concatenate(counts)), np.concatenate(docs)
        n_null = int((doc == NO_ID).sum())
        known = doc[n_null:]
        first = int(known[0]) if len(known) else 0
        about = {"n_ids": int(ends[-1]), "n_null": n_null, "first_doc": first}
        for key, values in (("ends", ends), ("docs", known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1))):
            about[key], parts = EliasFano.of(values).sections()
            for section in parts:
                out.write(section)
        footer = json.dumps(about).encode()
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        out.close()
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(doc)]), pa.array([int(ends[-1])]),
                                          pa.array([f"part-{shard:06d}.ids"])], ["shard", "n_docs", "n_ids", "file"])

    return run


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write files to `folder` (one that all executors share) in ascending order of doc_id.

    Returns what was written: shard, n_docs, n_ids, file.  A NULL or empty text is its end id alone; rows
    of one id are written by text; NULL ids come first.  Other columns are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    ranges = rows.repartitionByRange("doc", F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"), "text")
    return stored(ranges.mapInArrow(_write(folder, path), "shard long, n_docs long, n_ids long, file string"))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = TokenFile(f"{folder}/{row['file']}")
                at = start = 0
                while at < source.n_docs:  # blocks of documents: select finds their bounds, and only a block is decoded
                    to = max(at + 1, source.ends.upto(start + READ_IDS, at))
                    ends = np.concatenate([[start], source.ends.between(at, to).astype(np.int64)])
                    bounds = ends - start
                    crc = crcs(source.ids(start, int(ends[-1])), bounds)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(source.doc_ids(at, to), pa.int64()), pa.array(ends[:-1] + row["before"]),
                        pa.array(np.diff(bounds)), crc,
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at, start = to, int(ends[-1])
                source.close()

    return run


def read_files(written: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    One row for each file is ordered in one place; files have at least a partition's size.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    files = max(1, written.count())
    return placed.repartitionByRange(files, "shard").select("file", "before").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(docs: DataFrame) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    return read_files(write_files(docs, folder), folder)
