"""Similarity by insertions and deletions for whole columns of string pairs.

The longest common subsequence of every pair advances one character of the right string per step, for all pairs at once: 64
positions of the left string are the bits of a word, longer strings are several words with a carry. No loop runs over pairs.
"""

from __future__ import annotations

import numpy as np

#: Pairs, and bytes of position masks, that are worked on at once.
PAIRS, MASK_BYTES = 1 << 18, 1 << 25


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each text ends."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum([len(t) for t in texts], dtype=np.int64)


def letter_overlap(lefts: list[str], rights: list[str]) -> np.ndarray:
    """How many letters each left and right text share, counted with repeats: no common subsequence is longer.

    The k-th occurrence of a letter is a feature of its own, so the count is one matrix product of zeros and ones.
    """
    sides, tops = [], 1
    for texts in (lefts, rights):
        flat, ends = codes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        order = np.lexsort((flat, owner))
        flat, owner = flat[order].astype(np.int64), owner[order]
        new = np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))[: len(flat)]
        turn = np.arange(len(flat)) - np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
        tops = max(tops, int(turn.max(initial=0)) + 1)
        sides.append((owner, flat, turn))
    keys = [flat * tops + turn for _, flat, turn in sides]
    both = np.intersect1d(*keys)
    features = []
    for (owner, _, _), key, texts in zip(sides, keys, (lefts, rights)):
        at = np.searchsorted(both, key)
        known = at < len(both)
        known[known] = both[at[known]] == key[known]
        matrix = np.zeros((len(texts), len(both)), np.float32)
        matrix[owner[known], at[known]] = 1
        features.append(matrix)
    return features[0] @ features[1].T


def _advance(row: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One step of the bit-parallel recurrence; the last axis holds a string's words, lowest first."""
    hit, kept = row & mask, row & ~mask
    if row.shape[1] == 1:
        return (row + hit) | kept
    out, carry = np.empty_like(row), np.zeros(len(row), np.uint64)
    for w in range(row.shape[1]):
        part = row[:, w] + hit[:, w]
        whole = part + carry
        carry = ((part < hit[:, w]) | (whole < part)).astype(np.uint64)
        out[:, w] = whole
    return out | kept


def _same_width(left_flat, left_ends, left_size, right_flat, right_ends, right_size, i, j, words: int) -> np.ndarray:
    """Pairs whose left strings all fit into ``words`` words."""
    used, local = np.unique(i, return_inverse=True)
    owner = np.repeat(np.arange(len(used)), left_size[used])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(left_size[used]) - left_size[used], left_size[used])
    letters = left_flat[np.repeat(left_ends[used] - left_size[used], left_size[used]) + place]
    alphabet, letter = np.unique(letters, return_inverse=True)
    masks = np.zeros((len(used), len(alphabet) + 1, words), np.uint64)
    bit = np.uint64(1) << (place % 64).astype(np.uint64)
    np.bitwise_or.at(masks, (owner, letter, place // 64), bit)
    full = np.zeros((len(used), words), np.uint64)
    np.bitwise_or.at(full, (owner, place // 64), bit)
    at = np.searchsorted(alphabet, right_flat)
    known = at < len(alphabet)
    known[known] = alphabet[at[known]] == right_flat[known]
    code = np.where(known, at, len(alphabet))
    # Longest first: who still has characters is always a leading run.
    order = np.argsort(-right_size[j], kind="stable")
    local, j = local[order], j[order]
    size = right_size[j]
    start = right_ends[j] - size
    row = np.full((len(j), words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for t in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -t, side="left"))
        row[:n] = _advance(row[:n], masks[local[:n], code[start[:n] + t]])
    out = np.empty(len(j), np.int64)
    out[order] = np.bitwise_count(~row & full[local]).sum(1)
    return out


def common_lengths(lefts: list[str], rights: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequence of lefts[i] and rights[j], for arrays i and j."""
    left_flat, left_ends = codes(lefts)
    right_flat, right_ends = codes(rights)
    left_size, right_size = np.diff(left_ends, prepend=0), np.diff(right_ends, prepend=0)
    out = np.zeros(len(i), np.int64)
    words = np.maximum(-(-left_size // 64), 1)
    # Strings of similar length share a width, so one long string does not widen the masks of all.
    width = 1 << np.ceil(np.log2(words)).astype(np.int64)
    letters = max(len(np.unique(left_flat)), 1)
    for w in np.unique(width[i]):
        mine = np.flatnonzero(width[i] == w)
        mine = mine[np.argsort(i[mine], kind="stable")]
        most = max(MASK_BYTES // (8 * (letters + 1) * int(w)), 1)
        rank = np.cumsum(np.append(True, np.diff(i[mine]) > 0)) - 1
        at = 0
        while at < len(mine):
            to = min(at + max(PAIRS // int(w), 1), int(np.searchsorted(rank, rank[at] + most)))
            part = mine[at:to]
            out[part] = _same_width(left_flat, left_ends, left_size, right_flat, right_ends, right_size, i[part], j[part], int(w))
            at = to
    return out


def indel_ratios(lefts: list[str], rights: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """200 * common length / both lengths; 100 for two empty strings."""
    left_size, right_size = np.array([len(t) for t in lefts], np.int64), np.array([len(t) for t in rights], np.int64)
    size = left_size[i] + right_size[j]
    return np.where(size > 0, 200.0 * common_lengths(lefts, rights, i, j) / np.maximum(size, 1), 100.0)
