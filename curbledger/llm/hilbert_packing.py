"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's token ids are hashed to random directions in four dimensions; the mean of its tokens'
directions is a point, and the point's place on a Hilbert curve is its key.  Documents are
range-sorted by key, so neighbours along the curve use similar words, and are laid end to end
in that order; the sequences are the pieces between multiples of the length.  Only the very
last sequence can have padding.

Only (key, id, number of tokens) are sorted; ids meet their position in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.functions.ordered import running_sum
from curbledger.llm.token_ids import SLICE, ByteEncoder, crcs, encoder
from curbledger.llm.words import binaries, slices
from curbledger.session import stored

LENGTH = 2048
END = 1
DIMENSIONS, BITS = 4, 12
SPREAD = 6.0  # of the points in the unit cube: means of many tokens lie close to the middle
TOKENIZER = "byte_bpe_50k.json"
NO_ID = -(1 << 63)  # stands for a NULL document id: before all others

_directions: list[np.ndarray] = []


def directions() -> np.ndarray:
    """A fixed random direction for each 16-bit id."""
    if not _directions:
        _directions.append(np.random.default_rng(4).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32))
    return _directions[0]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by the transposed-bits method."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo the excess rotations, from the highest bit down
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def points(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Grid points of documents: `ids` of all of them, and where each begins."""
    table, at = directions(), bounds.tolist()
    sums = np.array([np.ones(b - a, np.float32) @ table[ids[a:b]] for a, b in zip(at[:-1], at[1:])], np.float64).reshape(-1, DIMENSIONS)
    means = sums / np.maximum(np.diff(bounds), 1)[:, None]
    return np.minimum((0.5 + 0.5 * np.tanh(SPREAD * means)) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ByteEncoder, path)
        for part in slices(batches, "text", size=SLICE):
            ids, bounds = encode.texts(part.column("text"), END)
            yield pa.RecordBatch.from_arrays([
                part.column("doc"), pa.array(hilbert_keys(points(ids, bounds), BITS)), pa.array(np.diff(bounds)), binaries(ids, 2 * bounds),
            ], ["doc", "key", "n", "ids"])

    return run


def _pieces(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            n, end = part.column("n").to_numpy(), part.column("upto").to_numpy()
            begin = end - n
            pieces = (end - 1) // length - begin // length + 1
            row = np.repeat(np.arange(part.num_rows), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // length + nth
            low = np.maximum(begin[row], sequence * length)
            high = np.minimum(end[row], (sequence + 1) * length)
            start = low - begin[row]
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.uint16)
            bounds = np.concatenate([[0], np.cumsum(high - low)])  # the pieces lie one after the other
            columns = [part.column("doc").take(pa.array(row)), pa.array(start), pa.array(high - low), crcs(ids, bounds),
                       pa.array(n[row]), pa.array(sequence), pa.array(low - sequence * length)]
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(binaries(ids, 2 * bounds))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    `ids` holds 16-bit little-endian ids.  A NULL or empty text is its end id alone; rows of one id are
    packed one by one; a NULL id is kept.  Other columns of `docs` are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    tokens = stored(rows.mapInArrow(_tokens(path), "doc long, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id()))
    placed = running_sum(tokens.select("key", "doc", "row", "n"), [], ["key", "doc", "row"], "n", "upto").select("row", "upto")
    kind = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = tokens.select("row", "doc", "n", "ids").join(placed, "row").drop("row").mapInArrow(
        _pieces(length, with_ids), kind + (", ids binary" if with_ids else ""))
    return pieces.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def op4_hilbert_packing(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
