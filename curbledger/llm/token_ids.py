"""Ids of whole texts by the tokenizers library, with a memory for segments seen before.

Texts are cut only where the tokenizer's own pre-tokenizer must cut too, whatever stands around; the
segments' ids, one after the other, are then the ids of the text.  The distinct segments of a slice
of texts are looked up, new ones are encoded, and arrays of ids are put together from them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from curbledger.llm import words as W

KEEP = 700_000    # segments in each of a memory's two generations: about 140 MB
SLICE = 8 << 20    # bytes of text that share a look-up
GROUP = 100       # new segments that are encoded in one call
SHORT = 64        # bytes; longer segments are encoded alone and not remembered

_open: dict[tuple, "Encoder"] = W.memory({})


class Encoder:
    """Encodes texts to unsigned 16-bit ids."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        if len(self.vocabulary) > 1 << 16 or self.vocabulary[-1][1] != len(self.vocabulary) - 1:
            raise ValueError("ids must be those from 0 on that fit 16 bits")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def cuts(self, w: W.Words) -> np.ndarray:
        """Byte positions where segments begin, inside texts."""
        raise NotImplementedError

    def learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new segments."""
        raise NotImplementedError

    def _looked_up(self, segments: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, segments))
        new = [s for s, f in zip(segments, found) if f is None]
        fresh = {s: self.old[s] for s in new if s in self.old} if self.old else {}
        fresh |= self.learn([s for s in new if s not in fresh] if fresh else new)
        if len(self.known) >= KEEP:  # what is asked for again moves to the new generation
            self.old, self.known = self.known, {}
        self.known |= fresh
        for s in new:
            if len(s) > SHORT:
                del self.known[s]
        if len(new) == len(segments):
            return list(map(fresh.__getitem__, segments))
        return [fresh[s] if f is None else f for s, f in zip(segments, found)]

    def texts(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (NULL: empty), one after the other, and the texts' bounds among them.

        `end` is put behind the ids of each text.
        """
        w = W.split(texts)
        begins = np.zeros(len(w.data) + 1, bool)
        begins[self.cuts(w)] = True
        begins[w.bounds] = True
        starts = np.flatnonzero(begins[:-1])
        offsets = np.append(starts, len(w.data)).astype(np.int64)
        if len(starts):
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(w.data.tobytes())])
            coded = pieces.dictionary_encode()
            parts = pa.array(self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
            _, ends, body = parts.buffers()
            upto = np.frombuffer(ends, np.int64, len(parts) + 1) // 2
            ids = np.frombuffer(body, np.uint16, upto[-1]) if upto[-1] else np.zeros(0, np.uint16)
        else:
            upto, ids = np.zeros(1, np.int64), np.zeros(0, np.uint16)
        bounds = upto[np.searchsorted(starts, w.bounds)]
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.uint16(end)), bounds + np.arange(len(bounds))


_SAFE = np.zeros(256, bool)  # first bytes of characters that are surely no white space
_SAFE[0x21:0x7F] = _SAFE[0xC3:0xF5] = True
_SAFE[[0xE1, 0xE2, 0xE3]] = False
_SPACED = re.compile(rb" [^ \t-\r]").match  # segments that begin with one space and a word
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True


class ByteEncoder(Encoder):
    """For byte-level BPE, where a space goes with the word after it.

    Cuts are before a space that a word follows, and behind a single line end between characters.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.lengths = np.array([len(name) for name, _ in self.vocabulary])  # a character stands for a byte

    def cuts(self, w: W.Words) -> np.ndarray:
        d, first = w.data, np.zeros(len(w.data) + 2, bool)
        first[w.bounds] = True  # where texts begin or end
        safe = _SAFE[d]
        before_word = np.flatnonzero((d[:-1] == 0x20) & safe[1:] & ~first[1:len(d)])
        behind_line = np.flatnonzero((d[1:-1] == 0x0A) & _PRINTED[d[:-2]] & safe[2:] & ~first[1:len(d) - 1] & ~first[2:len(d)]) + 2
        return np.concatenate([before_word, behind_line])

    def learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """New words with a space are encoded as one text, which has the same cuts, and parted by their bytes."""
        alone = [s for s in segments if not _SPACED(s) or len(s) > SHORT]
        out = {s: self.plain(s.decode()).tobytes() for s in alone}
        rest = [s for s in segments if s not in out] if out else segments
        for at in range(0, len(rest), GROUP):
            part = rest[at:at + GROUP]
            ids = self.plain(b"".join(part).decode())
            ends = np.cumsum(list(map(len, part)))
            reach = np.cumsum(self.lengths[ids])
            upto = np.minimum(np.searchsorted(reach, ends), len(reach) - 1)
            if not np.array_equal(reach[upto], ends):
                raise AssertionError("segments do not part at their cuts")
            data, cuts = ids.tobytes(), (2 * upto + 2).tolist()
            out.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts))))
        return out


class WordEncoder(Encoder):
    """For BPE whose pre-tokenizer drops white space: words, with the white space behind, are independent."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.last = np.array([name.endswith("</w>") for name, _ in self.vocabulary])

    def cuts(self, w: W.Words) -> np.ndarray:
        return w.starts

    def learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """New words are encoded as one text: letters are one unit each, as are closing marks behind them.

        Each unit has one id that ends a word.  If there are more of these, some letter was not one,
        and the words are encoded one by one.
        """
        out: dict[bytes, bytes] = {}
        plain = [(s, text, 1 + (core != text)) for s in segments
                 if len(s) <= SHORT and (core := (text := s.decode().rstrip(" \n")).rstrip(".,!?")).isalpha()]
        for at in range(0, len(plain), GROUP):
            part = plain[at:at + GROUP]
            ids = self.plain(" ".join([text for _, text, _ in part]))
            ends = np.flatnonzero(self.last[ids]) + 1
            units = np.cumsum([n for _, _, n in part])
            if len(ends) != units[-1] or ends[-1] != len(ids):
                continue
            data, begin = ids.tobytes(), 0
            for (s, _, _), end in zip(part, (2 * ends[units - 1]).tolist()):
                out[s] = data[begin:end]
                begin = end
        return out | {s: self.plain(s.decode()).tobytes() for s in segments if s not in out}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One encoder for each worker process."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]


def crcs(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """crc32 of each range of ids as little-endian unsigned 32-bit integers."""
    data, at = memoryview(ids.astype("<u4").tobytes()), (4 * bounds).tolist()
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
