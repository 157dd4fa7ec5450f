"""Word-shingle sets of whole texts, computed over Arrow columns with numpy.

Words are maximal runs of bytes outside space and 9 to 13, with A-Z lower-cased. In UTF-8 no byte of a longer
character is one of these, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_SEGMENT = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_folded = np.arange(256, dtype=np.uint64)
_folded[65:91] += np.uint64(32)
_LETTER = mix(_folded + np.uint64(1))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _SEGMENT)
        _powers["up"] = np.cumprod(np.full(size, _MULTIPLIER))
        _powers["down"] = np.cumprod(np.full(size, _INVERSE))
    return _powers["up"][:n], _powers["down"][:n]


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in ``data``; ``first`` marks bytes that begin a text."""
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | first))
    ends = np.flatnonzero(~blank & np.r_[blank[1:] | first[1:], True]) + 1
    up, down = _power(len(data))
    total = np.r_[np.uint64(0), np.cumsum(_LETTER[data] * up)]
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _long_words(data: np.ndarray) -> np.ndarray:
    """The same for one long text, a bounded segment at a time; segments end at blanks."""
    found, at = [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data):
            cut = np.flatnonzero(_BLANK[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            end = min(end + _SEGMENT, len(data))
        first = np.zeros(end - at, bool)
        first[0] = True
        found.append(_words(data[at:end], first)[0])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def text_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text; null and empty texts have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SEGMENT, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        if to == at + 1 and high - low > _SEGMENT:
            yield _long_words(data[low:high])
        elif high == low:
            for _ in range(at, to):
                yield np.empty(0, np.uint64)
        else:
            begins = offsets[at : to + 1] - low
            first = np.zeros(high - low, bool)
            first[begins[:-1][begins[:-1] < high - low]] = True
            hashes, starts = _words(data[low:high], first)
            cuts = np.searchsorted(starts, begins)
            for i in range(to - at):
                yield hashes[cuts[i] : cuts[i + 1]]
        at = to


def windows(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for every window of ``width`` words; a shorter text is one window."""
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total * _MULTIPLIER + words[k : len(words) - n + 1 + k])
    return total


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for words in text_words(texts):
        yield np.unique(windows(words))
