"""Counts of whole texts that quality rules and labellers look at."""

from __future__ import annotations

import numpy as np

from curbledger.llm import words as W

SYMBOLS = b"#*$%&|<>"
REPEAT = 5  # words in a window

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[0xC3:] = True  # first bytes of letters beyond ASCII, mostly
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = W.sums(flags.astype(np.int64))
    return total[bounds[1:]] - total[bounds[:-1]]


def word_chars(w: W.Words) -> np.ndarray:
    """Code points in words."""
    return _sums(_FIRST_BYTE[w.data] & ~W.BLANK[w.data], w.bounds)


def symbols(w: W.Words) -> np.ndarray:
    return _sums(_IS_SYMBOL[w.data], w.bounds)


def upper_letters(w: W.Words) -> np.ndarray:
    return _sums(_IS_UPPER[w.data], w.bounds)


def letters(w: W.Words) -> np.ndarray:
    return _sums(_IS_LETTER[w.data], w.bounds)


def lines(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line of their text."""
    body = w.data.tobytes()
    n, twice = np.zeros(len(w.bounds) - 1, np.int64), np.zeros(len(w.bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
        full = [line for line in body[a:b].split(b"\n") if line.strip()]
        n[i], twice[i] = len(full), len(full) - len(set(full))
    return n, twice


def repeated_words(w: W.Words, hashes: np.ndarray) -> np.ndarray:
    """Words in 5-word windows that are found twice or more in their text, first ones included."""
    full = W.windows(hashes, REPEAT)
    at = np.flatnonzero(w.window_ends_inside(REPEAT)[:len(full)])
    text = w.text_of()
    key, owner = W.mixed(full[at]), text[at]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + REPEAT, -1)
    return _sums(np.cumsum(cover[:-1]) > 0, w.first)
