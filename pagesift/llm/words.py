"""Words of texts and hashes of word runs, over whole Arrow batches at once."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
INLINE_TAG = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|tt|u|wbr)\b[^<>]*>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^<>]*>", re.S)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters or digits, lower-cased; tags count as text."""
    return WORD.findall(text.lower())


def plain(text: str) -> str:
    """Text without tags, entities and invisible characters.

    A tag that is set within a line (b, i, a, span, ...) disappears without a trace,
    so a word it cuts stays one word; any other tag parts words.
    """
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = TAG.sub(" ", INLINE_TAG.sub("", text))
    return INVISIBLE.sub("", text)


class _Hashes(dict):
    """64-bit hashes of words; emptied before it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def word_hashes(texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, number of words of each text)."""
    counts, flat = [], []
    get = _known.__getitem__
    for words in texts:
        counts.append(len(words))
        flat.extend(map(get, words))
    return np.array(flat, np.uint64), np.array(counts, np.int64)


_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``width`` consecutive words, with repeats."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = owner[: len(owner) - width + 1] == owner[width - 1 :]
    value = np.zeros(len(whole), np.uint64)
    for i in range(width):
        value = mix(value * _M[0] + hashes[i : i + len(whole)])
    return owner[: len(whole)][whole], value[whole]


def distinct_runs(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``runs``, sorted by text and hash, each run once per text."""
    owner, value = runs(hashes, counts, width)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[first], value[first]
