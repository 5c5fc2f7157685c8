"""SentencePiece merge segmentation with seeded dropout, and lossless decoding.

Merging works on an agenda: of all neighbouring symbols whose concatenation is a piece, the pair with
the best score (the leftmost of equals) is merged, and its new neighbours join the agenda.  A
candidate is skipped for good if a keyed hash of (seed, document, place of the segment, place and split in
the segment, the piece) falls below the dropout rate; so each occurrence of a word is drawn by itself,
and always the same.

Pieces never cross from a word to the next, so a text is cut into segments (spaces and the word behind
them; line ends).  Within a block of text, the merges that a distinct segment takes are worked out for
each set of skipped candidates (a path), the empty set first.  An occurrence follows a path if none of its
merges is skipped in that occurrence; else the skipped ones join the set, and the next path is looked at.
The last path is what the agenda gives with all draws of the occurrence: at each step the best candidate that
is not skipped.  Segments, paths and ids are flat arrays; new paths are merged together as rows of one matrix,
one step of every agenda at a time.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from curbledger.llm import words as W
from curbledger.llm.token_ids import crcs

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 1
SPACE = "▁"
LONG = 40          # characters; longer segments are merged one by one
SLICE = 8 << 20    # bytes of text whose segments are looked at together
ROWS = 20_000      # paths that are merged together
DRAWS = 200_000    # occurrences that are drawn at a time
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")
_NONE = -1
_open: dict[tuple, "Pieces"] = W.memory({})


class Pieces:
    """The vocabulary: characters, merges by pair of symbols, and bytes of every id."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        special = [i for i in range(self.size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        hidden = set(special)
        names = {i: model.id_to_piece(i) for i in range(self.size) if i not in hidden}
        if any(SPACE in name.lstrip(SPACE) or "\n" in name for name in names.values()):
            raise ValueError("a piece crosses words")
        ids = {name: i for i, name in names.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not model.is_byte(i) for i in self.byte):
            raise ValueError("the model has no byte pieces")
        # characters of pieces that are no pieces themselves get numbers above the ids
        self.char = {c: ids[c] for c in set("".join(names.values())) if c in ids}
        for c in sorted(set("".join(names.values())) - set(self.char)):
            self.char[c] = self.size + len(self.char)
        self.width = max([self.size, *self.char.values()]) + 2
        self.other = self.width - 1  # any other character
        numbers = {**self.char, **ids}
        self.of_char = {" " if c == SPACE else c: i for c, i in self.char.items()}
        pairs, merged, score = [], [], []
        for name, i in ids.items():
            for cut in range(1, len(name)):
                a, b = numbers.get(name[:cut]), numbers.get(name[cut:])
                if a is not None and b is not None:
                    pairs.append(a * self.width + b)
                    merged.append(i)
                    score.append(model.get_score(i))
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.merged = np.array(pairs, np.int64)[order], np.array(merged, np.int64)[order]
        rank = np.unique(np.array(score), return_inverse=True)[1]  # equal scores stay equal
        self.rank = rank[order].astype(np.int64)
        self.lookup = dict(zip(self.pairs.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        if self.width >= 1 << 18:
            raise ValueError("too many pieces")
        self.of_point = np.full(0x110000, self.other, np.int32)
        for c, i in self.of_char.items():
            self.of_point[ord(c)] = i
        self._hash()
        self.bytes = [names[i].replace(SPACE, " ").encode() if i in names else b"" for i in range(self.size)]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.body, self.sizes, self.begin = np.frombuffer(b"".join(self.bytes), np.uint8), sizes, np.cumsum(sizes) - sizes

    def _hash(self) -> None:
        """An open-addressed table of the pairs."""
        self.slots = np.full(1 << max(10, (4 * len(self.pairs)).bit_length()), -1, np.int64)
        self.shift, self.entry = np.uint64(64 - (len(self.slots).bit_length() - 1)), np.zeros(len(self.slots), np.int32)
        left, self.probes = np.arange(len(self.pairs)), 0
        spot = self._spots(self.pairs)
        while len(left):
            free = self.slots[spot] < 0
            at, who = np.unique(spot[free], return_index=True)
            self.slots[at], self.entry[at] = self.pairs[left[free][who]], left[free][who]
            rest = self.slots[spot] != self.pairs[left]
            left, spot = left[rest], spot[rest] + 1 & len(self.slots) - 1
            self.probes += 1

    def _spots(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def found(self, codes: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        spot = self._spots(codes)
        have = self.slots[spot]
        out = np.where(have == codes, self.entry[spot], -1)
        open_ = np.flatnonzero((have != codes) & (have >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = spot[open_] + k & len(self.slots) - 1
            have, mine = self.slots[at], codes[open_]
            out[open_] = np.where(have == mine, self.entry[at], -1)
            open_ = open_[(have != mine) & (have >= 0)]
        return out

    def symbols(self, segment: str) -> list[int]:
        return [self.of_char.get(c, self.other) for c in segment]

    def written(self, symbols: list[int], starts: list[int], segment: str) -> bytes:
        """Ids, with the bytes of characters that are no pieces."""
        if max(symbols) < self.size:
            return np.array(symbols, np.uint16).tobytes()
        out: list[int] = []
        for s, at in zip(symbols, starts):
            out += [s] if s < self.size else [self.byte[b] for b in segment[at].encode()]
        return np.array(out, np.uint16).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The text (UTF-8) of 16-bit ids of a text that was encoded with a space before it."""
        ids = np.frombuffer(ids, np.uint16)
        return self.body[W.ranges(self.begin[ids], self.sizes[ids])].tobytes()[1:]


def pieces(path: str) -> Pieces:
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def _keys(seed: int, segments: list[tuple[str, int]]) -> np.ndarray:
    """A key for each (segment, variant): mixed remainders of its bytes, with seed and variant."""
    low, prime = (1 << 64) - 1, (1 << 61) - 1
    values = [int.from_bytes(s.encode(), "big") % prime * 1024 + k & low for s, k in segments]
    return W.mixed(np.array(values, np.uint64) + np.uint64(seed * W.WORD_BASE & low))


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, dropout: float, split: np.ndarray | int = 1) -> np.ndarray:
    if dropout <= 0:
        return np.zeros(len(place), bool)
    return _drawn(key, _codes(place, split, piece), dropout)


def _codes(place: np.ndarray, split: np.ndarray | int, piece: np.ndarray) -> np.ndarray:
    """A candidate: where it begins, the characters of its left part, and what it makes."""
    return (place.astype(np.int64) << 32 | np.asarray(split, np.int64) << 20 | piece).astype(np.uint64)


def _drawn(key: np.ndarray, codes: np.ndarray, dropout: float) -> np.ndarray:
    h = W.mixed(key ^ W.mixed(codes))
    return (h >> np.uint64(11)).astype(np.float64) < dropout * 2.0 ** 53


def merge_one(p: Pieces, segment: str, key: int, dropout: float) -> bytes:
    """The agenda of one segment as a heap."""
    symbols = p.symbols(segment)
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive, agenda = [True] * n, []

    def offer(left: int) -> None:
        right = after[left]
        got = p.lookup.get(symbols[left] * p.width + symbols[right]) if right >= 0 else None
        if got and not _skipped(np.array([key], np.uint64), np.array([left]), np.array([got[1]]), dropout, right - left)[0]:
            heapq.heappush(agenda, (-got[0], left, right, symbols[left], symbols[right], got[1]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, left, right, a, b, merged = heapq.heappop(agenda)
        if not (alive[left] and alive[right] and after[left] == right and symbols[left] == a and symbols[right] == b):
            continue
        symbols[left], alive[right], after[left] = merged, False, after[right]
        if after[left] >= 0:
            before[after[left]] = left
            offer(left)
        if before[left] >= 0:
            offer(before[left])
    rest = [i for i in range(n) if alive[i]]
    return p.written([symbols[i] for i in rest], rest, segment)


def merge_many(p: Pieces, segments: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
    """The agendas of many segments of similar length, side by side."""
    points = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in segments]
    sizes = np.array([len(x) for x in points])
    out = _merged(p, np.concatenate(points), np.cumsum(sizes) - sizes, sizes,
                  lambda rows, place, split, piece: _skipped(keys[rows], place, piece, dropout, split))[0]
    return [out.values[a:b].tobytes() for a, b in zip(out.bounds[:-1], out.bounds[1:])]


@dataclass
class Lists:
    """Lists of numbers, one after the other."""

    values: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def take(self, which: np.ndarray) -> Lists:
        sizes = self.sizes[which]
        return Lists(self.values[W.ranges(self.bounds[:-1][which], sizes)], W.sums(sizes))

    @classmethod
    def of(cls, owner: np.ndarray, values: np.ndarray, n: int) -> Lists:
        """Values by their owners, in the order given."""
        order = np.argsort(owner, kind="stable")
        return cls(values[order], W.sums(np.bincount(owner, minlength=n)))

    @classmethod
    def joined(cls, parts: list[Lists]) -> Lists:
        if len(parts) == 1:
            return parts[0]
        return cls(np.concatenate([x.values for x in parts]), W.sums(np.concatenate([x.sizes for x in parts])))


def _merged(p: Pieces, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, skip) -> tuple[Lists, Lists]:
    """Ids and taken merges (`_codes`) of segments; skip(rows, places, splits, pieces) tells what is left out.

    `points` has the code points of the segments, `begin` where each starts.  Every step merges the best
    pair of every row, so the matrices lose a column; rows without a pair left go.
    """
    n, width = len(begin), int(sizes.max())
    steps = np.arange(width + 1, dtype=np.int32)
    inside = steps < sizes[:, None]
    symbols = np.full((n, width + 1), -1, np.int32)
    symbols[inside] = p.of_point[points[W.ranges(begin, sizes)]]
    starts = np.tile(steps, (n, 1))
    # for the pair that begins at each symbol: rank (or _NONE) and merged piece
    rank, merged = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)

    def look(rows: np.ndarray, at: np.ndarray) -> None:
        a, b = symbols[rows, at].astype(np.int64), symbols[rows, at + 1]
        pair = p.found(np.where((a >= 0) & (b >= 0), a * p.width + b, 0))
        hit = np.flatnonzero((pair >= 0) & (a >= 0) & (b >= 0))
        rank[rows, at] = _NONE
        if len(hit):
            pair, r, c = pair[hit], rows[hit], at[hit]
            place = starts[r, c]
            good = ~skip(number[r], place, starts[r, c + 1] - place, p.merged[pair])
            rank[r, c] = np.where(good, p.rank[pair], _NONE)
            merged[r, c] = p.merged[pair]

    number = np.arange(n)
    r, c = np.nonzero(inside[:, 1:])
    look(r, c)
    done, odd, taken = [], [], [(number[:0], np.zeros(0, np.uint64))]
    while len(number):
        best = rank.argmax(axis=1) if rank.shape[1] else np.zeros(len(number), np.int64)
        rows = np.arange(len(number))
        go = rank[rows, best] > _NONE if rank.shape[1] else np.zeros(len(number), bool)
        if not go.all():
            last, who = symbols[~go], number[~go]
            plain = last.max(axis=1) < p.size
            for row, at, i in zip(last[~plain], starts[~go][~plain], who[~plain]):
                m = int((row >= 0).sum())
                segment = "".join(map(chr, points[begin[i]:begin[i] + sizes[i]]))
                odd.append((i, np.frombuffer(p.written(row[:m].tolist(), at[:m].tolist(), segment), np.uint16)))
            last = last[plain]
            real = last >= 0
            done.append((np.repeat(who[plain], real.sum(axis=1)), last[real].astype(np.uint16)))
            symbols, starts, rank, merged, number, best = (x[go] for x in (symbols, starts, rank, merged, number, best))
            rows = np.arange(len(number))
            if not len(number):
                break
        new, place = merged[rows, best], starts[rows, best]
        taken.append((number, _codes(place, starts[rows, best + 1] - place, new)))
        symbols[rows, best] = new
        # the right symbol of each best pair goes, and the pair that began with it
        stay = np.ones(symbols.shape, bool)
        stay[rows, best + 1] = False
        symbols, starts = symbols[stay].reshape(len(rows), -1), starts[stay].reshape(len(rows), -1)
        stay = np.ones(rank.shape, bool)
        stay[rows, np.minimum(best + 1, rank.shape[1] - 1)] = False
        rank, merged = rank[stay].reshape(len(rows), -1), merged[stay].reshape(len(rows), -1)
        right = np.flatnonzero(best < rank.shape[1])
        look(right, best[right])
        left = np.flatnonzero(best > 0)
        look(left, best[left] - 1)
    for i, ids in odd:
        done.append((np.full(len(ids), i), ids))
    ids = Lists.of(*(np.concatenate(x) for x in zip(*done)), n)
    return ids, Lists.of(*(np.concatenate(x) for x in zip(*taken)), n)


class _Paths:
    """Paths of the distinct segments of a block: segment, skipped merges, taken merges, ids."""

    def __init__(self, p: Pieces, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces, self.points, self.begin, self.sizes = p, points, begin, sizes
        none = Lists(np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.segment, self.skipped, self.taken, self.ids = np.zeros(0, np.int64), none, none, Lists(np.zeros(0, np.uint16), np.zeros(1, np.int64))

    def add(self, segment: np.ndarray, skipped: Lists) -> np.ndarray:
        """Numbers of new paths."""
        n = len(segment)
        if not n:
            return np.zeros(0, np.int64)
        sizes = self.sizes[segment]
        order = np.argsort(sizes, kind="stable")
        ids, taken, at = [], [], 0
        while at < n:
            to = min(n, at + ROWS, int(np.searchsorted(sizes[order], sizes[order[at]] + 1, "right")))
            part = order[at:to]
            out = skipped.take(part)
            code = out.values.astype(np.int64)
            # row, place, split and piece in one number
            packed = lambda row, place, split, piece: row << 30 | place.astype(np.int64) << 24 | split.astype(np.int64) << 18 | piece
            left_out = np.sort(packed(np.repeat(np.arange(len(part)), out.sizes), code >> 32, code >> 20 & 0xFFF, code & 0xFFFFF))

            def skip(row: np.ndarray, place: np.ndarray, split: np.ndarray, piece: np.ndarray) -> np.ndarray:
                if not len(left_out):
                    return np.zeros(len(row), bool)
                wanted = packed(row, place, split, piece)
                return left_out[np.minimum(np.searchsorted(left_out, wanted), len(left_out) - 1)] == wanted

            done = _merged(self.pieces, self.points, self.begin[segment[part]], sizes[part], skip)
            ids.append(done[0])
            taken.append(done[1])
            at = to
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        numbers = len(self.segment) + np.arange(n)
        self.segment = np.concatenate([self.segment, segment])
        self.skipped = Lists.joined([self.skipped, skipped])
        self.taken = Lists.joined([self.taken, Lists.joined(taken).take(back)])
        self.ids = Lists.joined([self.ids, Lists.joined(ids).take(back)])
        return numbers

    def follow(self, path: np.ndarray, keys: np.ndarray, dropout: float) -> None:
        """Moves every occurrence on to the path that its draws leave."""
        open_ = np.flatnonzero(path >= 0)
        while len(open_):
            masks = np.zeros(len(open_), np.uint64)  # a segment of LONG characters has fewer than 64 merges
            for at in range(0, len(open_), DRAWS):
                some = open_[at:at + DRAWS]
                taken = self.taken.take(path[some])
                mine = np.repeat(np.arange(len(some)), taken.sizes)
                gone = _drawn(keys[some][mine], taken.values, dropout)
                inner = (np.arange(len(mine)) - taken.bounds[mine])[gone].astype(np.uint64)
                np.bitwise_or.at(masks, at + mine[gone], np.uint64(1) << inner)
            hit = np.flatnonzero(masks)
            open_, masks = open_[hit], masks[hit]
            order = np.lexsort((masks, path[open_]))
            open_, masks = open_[order], masks[order]
            new = np.ones(len(open_), bool)
            new[1:] = (masks[1:] != masks[:-1]) | (path[open_][1:] != path[open_][:-1])
            old, mask = path[open_][new], masks[new]
            had, taken = self.skipped.take(old), self.taken.take(old)
            mine = np.repeat(np.arange(len(old)), taken.sizes)
            bit = (mask[mine] >> (np.arange(len(mine)) - taken.bounds[mine]).astype(np.uint64) & np.uint64(1)).astype(bool)
            skipped = Lists.of(np.concatenate([np.repeat(np.arange(len(old)), had.sizes), mine[bit]]), np.concatenate([had.values, taken.values[bit]]), len(old))
            path[open_] = self.add(self.segment[old], skipped)[np.cumsum(new) - 1]


class Encoder:
    """Encodes texts, a block of about `SLICE` bytes of segments at a time."""

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        self.pieces, self.dropout, self.seed = pieces(path), dropout, seed

    def texts(self, texts: list[str], documents: np.ndarray) -> list[bytes]:
        bodies = [b" " + t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
        del bodies
        begins = np.zeros(len(data), bool)
        line, blank = data == 0x0A, data == 0x20
        begins |= line
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        begins[first[first < ends]] = True
        starts = np.flatnonzero(begins)
        upto = np.searchsorted(starts, np.concatenate([first, ends[-1:]]))  # segments before each text
        owner = np.repeat(np.arange(len(texts)), np.diff(upto))
        documents = documents.astype(np.int64).view(np.uint64)
        out, size_of = [np.zeros(0, np.uint16)], np.zeros(len(starts), np.int64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
            offsets = np.append(starts[at:to], starts[to] if to < len(starts) else len(data))
            places = (np.arange(at, to) - upto[owner[at:to]]).astype(np.uint64)
            keys = W.mixed(W.mixed(documents[owner[at:to]] + np.uint64(self.seed)) + places)
            ids = self._block(data[offsets[0]:offsets[-1]], offsets - offsets[0], keys)
            out.append(ids.values)
            size_of[at:to] = ids.sizes
            at = to
        body = np.concatenate(out).tobytes()
        at = (2 * W.sums(size_of)[upto]).tolist()
        return [body[a:b] for a, b in zip(at[:-1], at[1:])]

    def _block(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> Lists:
        """Ids of the segments between the offsets."""
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
        which, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
        body = distinct.buffers()[2].to_pybytes()[:bounds[-1]]
        points = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32)
        begin = W.sums(((np.frombuffer(body, np.uint8) & 0xC0) != 0x80).astype(np.int64))[bounds]
        sizes = np.diff(begin)
        paths = _Paths(self.pieces, points, begin[:-1], sizes)
        short = np.flatnonzero(sizes <= LONG)
        first = np.full(len(distinct), -1, np.int64)
        first[short] = paths.add(short, Lists(np.zeros(0, np.uint64), np.zeros(len(short) + 1, np.int64)))
        path = first[which]
        if self.dropout > 0:
            paths.follow(path, keys, self.dropout)
        long = np.flatnonzero(path < 0)
        if len(long):
            one = [np.frombuffer(merge_one(self.pieces, distinct[which[i]].as_py().decode(), int(keys[i]), self.dropout), np.uint16) for i in long.tolist()]
            path[long] = len(paths.segment) + np.arange(len(long))
            paths.ids = Lists.joined([paths.ids, Lists(np.concatenate(one), W.sums(np.array([len(x) for x in one])))])
        return paths.ids.take(path)


def _encode(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (path, dropout, seed)
        if name not in _open:
            _open[name] = Encoder(*name)
        encoder = _open[name]
        for part in W.slices(batches, "text", size=SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = encoder.texts(texts, part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False))
            same = [encoder.pieces.decode(v) == t.encode() for v, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(v) // 2 for v in ids], pa.int64()), crcs(np.frombuffer(b"".join(ids), np.uint16), np.cumsum([0] + [len(v) // 2 for v in ids])), pa.array(same), pa.array(ids, pa.binary()),
            ], ["doc_id", "n_tokens", "ids_crc32", "lossless", "ids"])

    return run


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless (the ids decode to the text), ids (16 bits each, little-endian).

    A NULL or empty text has no ids.  Rows of one id and text get the same ids.  Characters without a piece,
    the space mark among them, are written as their bytes.  Other columns are not read.
    """
    path = model or public_tokenizers.path(MODEL)
    return docs.select("doc_id", "text").mapInArrow(
        _encode(path, dropout, seed), "doc_id long, n_tokens long, ids_crc32 long, lossless boolean, ids binary")


def op5_merge_dropout(docs: DataFrame) -> DataFrame:
    return encode(docs).drop("ids")
