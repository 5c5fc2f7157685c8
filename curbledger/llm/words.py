"""Words and word windows of Arrow text batches, as numpy arrays.

A word is a run of bytes other than `[\\x20\\x09-\\x0D]` in UTF-8, so a code point is never cut.
`hashes` are polynomials over a word's bytes modulo two primes, which have no structured collisions as a
power of two has; hashes of windows are polynomials over them modulo 2**64: a window of 2L words is made
from two windows of L words by one multiplication.  `buckets` are quicker polynomials over bytes, for
models that bear collisions.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 2 << 20  # texts are worked on in slices of about this size; a longer text is one slice

_ODD = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
PRIMES = ((2147483647, 1103515249), (2147483629, 715827883))  # and the bases of polynomials modulo them
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


_memories: list[dict] = [_tables]


def memory(of: dict) -> dict:
    """`of`, to be emptied by `release`."""
    _memories.append(of)
    return of


def release() -> None:
    """Forget what earlier stages left in this worker process."""
    for m in _memories:
        m.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least (base is odd)."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        pair = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor & _ODD, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        have = _tables[base] = tuple(pair)
    return have


def prime_powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo a prime below 2**31 for i < n at least."""
    have = _tables.get(prime)
    if have is None or len(have[0]) < n:
        pair = []
        for factor in (base, pow(base, -1, prime)):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, 1 << 16):  # doubling
                out = np.concatenate([out, out * np.uint64(pow(factor, len(out), prime)) % np.uint64(prime)])
            pair.append(out)
        have = _tables[prime] = tuple(pair)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (finalizer of a public 64-bit generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Sums of all prefixes, the empty one first."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    upto = sums(sizes.astype(np.int64))
    return np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)


@dataclass
class Words:
    data: np.ndarray      # bytes of the texts, one after the other
    bounds: np.ndarray    # byte bounds of the texts, one more than texts
    starts: np.ndarray    # byte bounds of the words
    ends: np.ndarray
    first: np.ndarray     # number of the first word of each text, and the total

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text, for every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 62-bit hash of each word's bytes, polynomials modulo two primes; words of one hash are taken as equal."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):  # blocks of words, so that sums stay below 2**64
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES)))
            part = self.data[low:self.ends[to - 1]]
            if len(part) > 4 * SLICE_BYTES:  # one very long word
                out[at] = int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little")
                at = to
                continue
            part = part.astype(np.uint64) + np.uint64(1)
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            both = []
            for prime, base in PRIMES:
                up, down = prime_powers(prime, base, len(part) + 1)
                total = sums(part * up[:len(part)])
                both.append((total[e] - total[s]) % np.uint64(prime) * down[s] % np.uint64(prime))
            out[at:to] = (both[0] << np.uint64(31)) | both[1]
            at = to
        return mixed(out)

    def buckets(self) -> np.ndarray:
        """A quick 64-bit polynomial over each word's bytes.  Unequal words can be found that share one."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):  # blocks of words, so that the power tables stay small
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES)))
            part = self.data[low:self.ends[to - 1]].astype(np.uint64) + np.uint64(1)
            up, down = powers(BYTE_BASE, len(part) + 1)
            total = sums(part * up[:len(part)])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (total[e] - total[s]) * down[s]
            at = to
        return mixed(out)

    def window_ends_inside(self, length: int) -> np.ndarray:
        """For each word, whether a window of `length` words from it stays in its text."""
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self)) + length <= last


def doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows of 2 * length words, from those of `length` words."""
    step = np.uint64(pow(WORD_BASE, length, 1 << 64))
    return h[:-length] + step * h[length:] if len(h) > length else h[:0]


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` words (unmixed; windows may cross texts)."""
    if len(h) < length:
        return h[:0]
    up, down = powers(WORD_BASE, len(h) + 1)
    total = sums(h * up[:len(h)])
    return (total[length:] - total[:-length]) * down[:len(h) - length + 1]


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; NULL counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, body = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset:]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    data = raw[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    if lower:
        data = LOWER[data]
    n = len(data)
    word = ~BLANK[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    inner = bounds[bounds < n]
    before[inner] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    closing = bounds[bounds > 0]
    after[closing - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def slices(batches: Iterator[pa.RecordBatch], *columns: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices whose texts are about `size` bytes long together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(sum(
            pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def binaries(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in `data`."""
    body = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int32)), pa.py_buffer(body)])


def per_text(values: np.ndarray, first: np.ndarray, what=np.add) -> np.ndarray:
    """Reduce values of words (or of any parts) text by text; 0 for a text without any."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = what.reduceat(values, first[:-1][full])
    return out
