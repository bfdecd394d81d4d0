"""Ids of a text's words by looking up each distinct word once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import eight_bytes, word_hashes


def look_up(data: np.ndarray, start: np.ndarray, length: np.ndarray, ids_of: Callable[[list[bytes]], list[bytes]], hashes: Callable = word_hashes) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and the ids one after another. ``ids_of`` gives those of distinct words as little-endian uint32.

    Words are told apart by their hashes; those with one hash are compared byte by byte.
    """
    if not len(start):
        return length, np.zeros(0, "<u4")
    _, first, which = np.unique(hashes(data, start, length), return_index=True, return_inverse=True)
    raw, lanes, twin = data.tobytes(), eight_bytes(data), first[which]
    same = length == length[twin]
    same &= (lanes[start] ^ lanes[start[twin]]) << (64 - 8 * np.minimum(length, 8)).astype(np.uint64) == 0
    long = np.flatnonzero(length > 8)
    same[long] &= (lanes[start[long] + 8] ^ lanes[start[twin[long]] + 8]) << (64 - 8 * np.minimum(length[long] - 8, 8)).astype(np.uint64) == 0
    longer = np.flatnonzero(length > 16)
    spans = zip(start[longer].tolist(), start[twin[longer]].tolist(), length[longer].tolist(), strict=True)
    same[longer] &= np.array([raw[a + 16 : a + n] == raw[b + 16 : b + n] for a, b, n in spans], bool)
    if not same.all():  # two words with one hash: all words by themselves
        first = which = np.arange(len(start))
    ids = ids_of([raw[a : a + n] for a, n in zip(start[first].tolist(), length[first].tolist(), strict=True)])
    sizes = np.array(list(map(len, ids)), np.int64) // 4
    counts = sizes[which]
    return counts, gather(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[which], counts)


def gather(items: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` items from each of the places ``at``, one after another."""
    before = np.cumsum(counts) - counts
    return items[np.repeat(at - before, counts) + np.arange(int(counts.sum()))]
