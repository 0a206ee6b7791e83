"""License scans: winnowed fingerprints of templates pick candidates, in-order matches in a bounded span decide.

The inverted index holds the templates' fingerprints only, so its size doesn't depend on the corpus
and every document is scanned where it is read, without a shuffle.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts_of
from .words import LOWER, PUNCTUATION, find_words, fold_keys, mix, word_keys

#: Words in a fingerprint; fingerprints in a winnowing window; words that a passage may have more than its template, at least; least coverage.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

#: Notices by which well-known licenses are named.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "reserved": "All rights reserved.",
}


def whole_texts() -> dict[str, str]:
    """Whole licenses (-text) and the headers that they ask for (-header), read by the driver from beside this module."""
    return {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}



class Index(NamedTuple):
    names: list[str]
    words: list[np.ndarray]
    known: tuple[np.ndarray, np.ndarray, np.ndarray]  # all templates' words, in the order of their hashes: (hash, both parts of the key)
    grams: np.ndarray  # sorted
    places: list[list[int]]  # of each gram: the templates that have it
    masks: list[_Masks]


def _grams(hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : len(hashes) - n + 1 + i])
    return out


def _word_hashes(data: np.ndarray, offsets: np.ndarray, known: tuple | None = None):
    """(words, a hash of each); with the words that templates have, the hash of any other is 0: it matches none."""
    words = find_words(data, offsets, PUNCTUATION)
    low, high = word_keys(LOWER[data], words.starts, words.ends)
    hashes = fold_keys(low, high)
    if known is not None:
        at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
        hashes[(known[1][at] != low) | (known[2][at] != high)] = 0
    return words, hashes


def _known(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    words = find_words(data, np.array([0, len(data)]), PUNCTUATION)
    low, high = word_keys(LOWER[data], words.starts, words.ends)
    hashes, at = np.unique(fold_keys(low, high), return_index=True)
    return hashes, low[at], high[at]


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the least gram of each window, the rightmost of equal ones; all grams if they are fewer."""
    if len(grams) <= window:
        return list(range(len(grams)))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return sorted({i + window - 1 - int(np.argmin(v[::-1])) for i, v in enumerate(views)})


def build_index(templates: dict[str, str]) -> Index:
    """Templates of under GRAM words are refused: they have no fingerprint."""
    places: dict[int, set[int]] = defaultdict(set)
    words = []
    for t, (name, text) in enumerate(templates.items()):
        data = np.frombuffer(text.encode(), np.uint8)
        words.append(_word_hashes(data, np.array([0, len(data)]))[1])
        if len(words[-1]) < GRAM:
            raise ValueError(f"template {name!r} has under {GRAM} words")
        grams = _grams(words[-1])
        for at in winnow(grams):
            places[int(grams[at])].add(t)
    found = sorted(places)
    return Index(list(templates), words, _known(list(templates.values())), np.array(found, np.uint64), [sorted(places[g]) for g in found], [_Masks(w) for w in words])


def _reach(masks: list[int], full: int, need: int, at: int = 0) -> int:
    """The first word up to which `need` template words match in order from word `at` on, or -1; masks: the template positions of each text word, as bits.

    A row of the longest common subsequence is one integer, whose zero bits mark where it grows.
    """
    v, n = full, full.bit_length()
    for j in range(at, len(masks)):
        u = v & masks[j]
        if u:
            v = ((v + u) | (v - u)) & full
            if n - v.bit_count() >= need:
                return j
    return -1


def _extend(masks: list[int], full: int, need: int) -> tuple[int, int]:
    """(matched words, last word) of the passage from the first word on that has most matches over words without one, at least `need`."""
    v, n, matched, best = full, full.bit_length(), 0, (0, 0, 0)
    for j, mask in enumerate(masks):
        u = v & mask
        if u:
            v = ((v + u) | (v - u)) & full
            now = n - v.bit_count()
            if now > matched:
                matched = now
                if matched >= need and (not best[0] or 2 * matched - j > best[2]):
                    best = (matched, j, 2 * matched - j)
            if matched == n:
                break
    return best[0], best[1]


class _Masks:
    """The positions of each word of a template, as bits from either end, and how often it has the word."""

    def __init__(self, words: np.ndarray):
        self.size, self.full = len(words), (1 << len(words)) - 1
        self.words, self.counts = np.unique(words, return_counts=True)
        at: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words.tolist()):
            at[word].append(i)
        self.forward = [sum(1 << i for i in at[int(w)]) for w in self.words] + [0]
        self.backward = [sum(1 << (self.size - 1 - i) for i in at[int(w)]) for w in self.words] + [0]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in `words`; len(words) for others."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def most(self, numbers: np.ndarray) -> int:
        """How many words may match at most, whatever their order."""
        return int(np.minimum(np.bincount(numbers, minlength=len(self.counts) + 1)[:-1], self.counts).sum())


def slack_of(size: int) -> int:
    """Words that a passage may have more than its template."""
    return max(BAND, size // 8)


def passages(masks: _Masks, hashes: np.ndarray, hits: list[int], coverage: float = COVERAGE) -> Iterator[tuple[int, int, int]]:
    """(matched words, first word, last word) of every passage of a text, from left to right.

    hits: where the text has a fingerprint of the template; a passage holds one of them. The passage
    that is complete first comes first. It begins as late as it can, and goes on while that gives
    more matches than words without one.
    """
    need = max(1, math.ceil(coverage * masks.size))
    limit = masks.size + slack_of(masks.size)
    if len(hashes) < need:
        return
    places = np.array(sorted(hits))
    begins, ends = np.maximum(places + GRAM - limit, 0), np.minimum(places + limit, len(hashes))
    cut = np.flatnonzero(begins[1:] > ends[:-1]) + 1
    for lo, hi in zip(begins[np.append(0, cut)].tolist(), ends[np.append(cut, len(places)) - 1].tolist()):
        numbers = masks.numbers(hashes[lo:hi])
        if masks.most(numbers) < need:
            continue
        forward, backward = ([m[i] for i in numbers.tolist()] for m in (masks.forward, masks.backward))
        at = 0
        while at + need <= hi - lo:
            end = _reach(forward, masks.full, need, at)
            if end < 0:
                break
            first = end - _reach(backward[at : end + 1][::-1], masks.full, need)
            if end - first >= limit:
                at = max(at + 1, end + 2 - limit)
                continue
            matched, size = _extend(forward[first : min(first + limit, hi - lo)], masks.full, need)
            last = first + size
            one = np.searchsorted(places, lo + first)
            if one < len(places) and places[one] + GRAM - 1 <= lo + last:
                yield matched, lo + first, lo + last
                at = last + 1
            else:
                at = first + 1


def _matches(index: Index, hashes: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(template, matched, first word, last word) of a text; hits: (position, number of the gram)."""
    places: dict[int, list[int]] = defaultdict(list)
    for position, gram in hits:
        for t in index.places[gram]:
            places[t].append(position)
    for t, own in sorted(places.items()):
        for matched, first, last in passages(index.masks[t], hashes, own, coverage):
            yield t, matched, first, last


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per passage that covers a template: doc_id, license, coverage, matched_words, start_char, end_char.

    Words are runs of letters and digits, A-Z in lower case. A passage counts if at least `coverage`
    of the template's words match in order, within BAND words (or an eighth, if more) above the
    template's size, and if it holds one of the template's fingerprints. Passages of one template in
    one document don't overlap and are found from left to right; those of different templates may.
    Spans are characters of the whole text, the end excluded. Null and empty texts, and those
    without any such passage, give no rows; repeated rows are scanned one by one.
    """
    index = build_index(templates or TEMPLATES | whole_texts())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for a, b in steps(offsets):
                part, base = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, hashes = _word_hashes(part, base, index.known)
                grams = _grams(hashes)
                at = np.minimum(np.searchsorted(index.grams, grams), len(index.grams) - 1)
                hit = np.flatnonzero(index.grams[at] == grams)
                hit = hit[words.text[hit] == words.text[hit + GRAM - 1]] if len(hit) else hit
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80))) if len(hit) else base  # characters before each byte
                for doc, own in _by_text(words.text[hit], hit):
                    first, last = words.first[doc], words.first[doc + 1]
                    begin = base[doc]
                    for t, matched, one, two in _matches(index, hashes[first:last], [(int(i - first), int(at[i])) for i in own], coverage):
                        start, end = (int(chars[x] - chars[begin]) for x in (words.starts[first + one], words.ends[first + two]))
                        out.append((ids[a + doc], index.names[t], matched / len(index.words[t]), matched, start, end))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "coverage", "matched_words", "start_char", "end_char"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, "doc_id long, license string, coverage double, matched_words int, start_char long, end_char long")


def _by_text(texts: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(texts):
        cuts = np.flatnonzero(np.diff(texts)) + 1
        for own in np.split(np.arange(len(texts)), cuts):
            yield int(texts[own[0]]), positions[own]
