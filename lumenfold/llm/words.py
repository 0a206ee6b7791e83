"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

#: Bytes of ASCII white space, as a table.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are neither ASCII letters or digits nor part of a character beyond ASCII.
PUNCTUATION = np.array([x < 0x80 and not chr(x).isalnum() for x in range(256)])
#: A-Z in lower case, other bytes unchanged.
LOWER = np.array([x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)], np.uint8)
#: Bytes of a word that its key holds as they are, at most.
SHORT = 15
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SALT = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    text: np.ndarray  # the number of the text of each word
    first: np.ndarray  # for each text, its first word; one more entry at the end


def find_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes other than those in the table `between`; no word crosses from one text to the next."""
    inside = ~between[data]
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the word (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers of 64 bits for each word that stand for the word itself.

    Words of up to SHORT bytes are written into them as they are, with their size in the topmost
    byte; longer ones are stood for by 120 bits of BLAKE2b, and 255 there. So keys of different
    words differ, but for collisions of a cryptographic hash.
    """
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    low = eight[starts] & _MASKS[np.minimum(sizes, 8)]
    high = eight[starts + np.minimum(sizes, 8)] & _MASKS[np.clip(sizes - 8, 0, 7)] | sizes.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        whole = data.tobytes()
        digests = b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist()))
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long], high[long] = pairs[:, 0], pairs[:, 1] | np.uint64(255 << 56)
    return low, high


def fold_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of word keys: it spreads and sorts words, and never stands for them."""
    return mix(low + mix(high ^ np.uint64(_SALT)))


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal words everywhere; compare `word_keys` where equality matters."""
    return fold_keys(*word_keys(data, words.starts, words.ends))


def pair_names(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal exactly where both numbers of a pair are; one and two are below 2**31."""
    if not len(one):
        return np.zeros(0, np.int64)
    return np.unique(one.astype(np.int64) << 31 | two, return_inverse=True)[1]


def word_names(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal exactly where word keys are."""
    return pair_names(*(np.unique(x, return_inverse=True)[1] for x in (low, high)))


def run_names(names: np.ndarray, size: int) -> np.ndarray:
    """Numbers that are equal exactly where the `size` names from there on are; runs of twice the length are named from pairs."""
    width = 1
    while width < size:
        step = min(width, size - width)
        names = pair_names(names[: max(len(names) - step, 0)], names[step:])
        width += step
    return names
