"""Hashed word shingles and MinHash over UTF-8 bytes, vectorised in numpy.

A word is a maximal run of bytes other than x20 and x09-x0D, which in UTF-8 is the
same as a run of code points other than those. All hashes are fixed functions of the
bytes, so executors agree on them. A word's hash takes its bytes eight at a time through a bijective mixer, so that
no family of words collides by construction, as families do under polynomials modulo 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are cut into words at once.
PIECE_BYTES = 1 << 19
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Masks of the lowest 0 to 8 bytes of a lane.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places: chained over lanes of eight bytes, from the length."""
    lanes = eight_bytes(data)
    out = mix(length.astype(np.uint64) * _SEED + np.uint64(1))
    rest, at, short = length.copy(), start.copy(), np.flatnonzero(length <= LONG_WORD)
    while len(short):
        value = lanes[at[short]] & _LANE[np.minimum(rest[short], 8)]
        out[short] = mix(mix(out[short] ^ value) + _SEED)
        at[short] += 8
        rest[short] -= 8
        short = short[rest[short] > 0]
    for k in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[k] : start[k] + length[k]].data, digest_size=8).digest()
        out[k] = np.frombuffer(digest, "<u8")[0]
    return out


def word_places(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of a piece; none reaches across a cut."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    start, end = step[:-1] == 1, step[1:] == -1
    joined = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    start[joined], end[joined - 1] = True, True
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end) + 1 - start


def pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that end at white space, or where one does after a longer word."""
    n, begin = len(data), 0
    while begin < n:
        stop = min(n, begin + most)
        if stop < n:
            space = np.flatnonzero(_SPACE[data[begin:stop]])
            if len(space):
                stop = begin + int(space[-1]) + 1
            else:
                while stop < n and not (space := np.flatnonzero(_SPACE[data[stop : stop + most]])).size:
                    stop = min(n, stop + most)
                stop = stop + int(space[0]) + 1 if stop < n else n
        yield begin, stop
        begin = stop


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the n + 1 offsets of each text's words.

    Texts are gone through in pieces, so memory beyond the result, 16 bytes a word, doesn't grow with a text.
    """
    offsets = offsets - offsets[0]
    starts, hashes = [], []
    for begin, stop in pieces(data, PIECE_BYTES):
        a, b = np.searchsorted(offsets, (begin + 1, stop), "left")
        piece = _LOWER[data[begin:stop]] if lower else data[begin:stop]
        at, length = word_places(piece, offsets[a:b] - begin)
        starts.append(at + begin)
        hashes.append(word_hashes(piece, at, length))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets, "left").astype(np.int64)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, with offsets; a text of fewer words, but one at least, has all its words as one."""
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), out_at
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled + np.uint64(k + 1)) + hashes[k : k + len(rolled)] if k else hashes[: len(rolled)].copy()
    rolled = mix(rolled)
    out = np.empty(int(out_at[-1]), np.uint64)
    full = counts >= width
    take = np.repeat((at[:-1] - out_at[:-1])[full], sizes[full]) + np.flatnonzero(np.repeat(full, sizes))
    out[np.repeat(full, sizes)] = rolled[take]
    few = np.flatnonzero(~full & (counts > 0))  # chained from the count, a word at a time
    whole = mix(counts[few].astype(np.uint64) * _SEED)
    for k in range(width - 1):
        more = counts[few] > k
        whole[more] = mix((whole[more] + _SEED) ^ hashes[at[few[more]] + k])
    out[out_at[few]] = whole
    return out, out_at


class MinHash:
    """``size`` universal multiply-add hashes (mod 2**64, upper 32 bits kept) of a set of 64-bit items."""

    def __init__(self, size: int, seed: int = 1):
        random = np.random.Generator(np.random.PCG64(seed))
        self.size = size
        self.times = (random.integers(0, 1 << 63, size, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self.plus = random.integers(0, 1 << 63, size, np.uint64)[:, None]
        self.buffer = np.empty((size, 1024), np.uint64)

    def of(self, items: np.ndarray) -> np.ndarray:
        """The signature, uint32; all ones for the empty set."""
        least = np.full(self.size, (1 << 64) - 1, np.uint64)
        for k in range(0, len(items), 1024):
            part = items[k : k + 1024]
            out = self.buffer[:, : len(part)]
            np.multiply(self.times, part[None, :], out=out)
            out += self.plus
            np.minimum(least, out.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)
