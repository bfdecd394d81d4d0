"""Packing token streams into fixed windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they lie and cut into full windows plus a remainder; remainders are cut into
pieces of at most ``max_piece``. Groups of pieces of a partition are packed together: every piece starts as a partial
partition of k windows, and the two partial partitions with the largest imbalance are merged, the fullest
windows of one onto the emptiest of the other, until one is left, whose windows are nearly equal. If
the fullest exceeds the capacity, the group is packed again with one window more.

There is no exchange: a partition's windows depend on that partition alone.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, map_arrow, table, utf8_parts
from .lookup import look_up
from .shingles import pieces, word_hashes, word_places

CAPACITY = 4096
#: A longer remainder is cut, so that a window holds several pieces and sums can be balanced.
MAX_PIECE = 1024
#: Tokens in a group that is packed together; bounds memory and the differencing's work.
GROUP_TOKENS = 1 << 19
END_ID = 2
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 500_000
#: Bytes of text that are encoded at once.
PIECE_BYTES = 1 << 21
_TAIL = np.zeros(256, bool)
_TAIL[list(b"!#$%&*,./:;?|")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def karmarkar_karp(sizes: list[int], k: int) -> tuple[list[int], int]:
    """The window (0 to k - 1) of each size, and the largest sum."""
    if not sizes:
        return [], 0
    n = len(sizes)
    left, right = [], []  # merged nodes above n: their two parts
    count = itertools.count()
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, next(count), sums, nodes))  # sums descend
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums_a, nodes_a = heapq.heappop(heap)
        _, _, sums_b, nodes_b = heapq.heappop(heap)
        sums, nodes_b = sums_a + sums_b[::-1], nodes_b[::-1]
        nodes = np.where(nodes_a < 0, nodes_b, nodes_a)
        for i in np.flatnonzero((nodes_a >= 0) & (nodes_b >= 0)).tolist():
            left.append(int(nodes_a[i]))
            right.append(int(nodes_b[i]))
            nodes[i] = n + len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(count), sums, nodes))
    _, _, sums, nodes = heap[0]
    window = [0] * n
    for w, node in enumerate(nodes.tolist()):
        below = [node] if node >= 0 else []
        while below:
            x = below.pop()
            if x < n:
                window[x] = w
            else:
                below += (left[x - n], right[x - n])
    return window, int(sums[0])


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The window of each size; every window holds ``capacity`` at most. A size above the capacity is an error."""
    if sizes and max(sizes) > capacity:
        raise ValueError("a piece is larger than a window")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, most = karmarkar_karp(sizes, k)
        if most <= capacity:
            return window
        k += 1


def _byte_letters() -> str:
    """Byte-level tokenizers' letter of each byte: itself if printable in Latin-1, else from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class WordEncoder:
    """Token ids of texts, word by word, with a bounded memory of words.

    For a byte-level tokenizer that lower-cases, drops white space, marks a word's end and never joins across it or
    across the end of a run of letters, a text's ids are those of its words in order, and a word's those of what stands before
    the ASCII punctuation that follows its last letter or digit, and of that tail. Only ASCII white space splits here. The words of a
    piece of text are told apart by their hashes, and equal hashes are compared byte by byte; each distinct word is looked up
    once, and the ids are gathered with numpy. Plain Latin-1 words go to the tokenizer's model without its normaliser and pattern, which
    wouldn't change them; all else goes to the whole tokenizer. New words are encoded many at a time: the end mark, or a
    special token, tells them apart.
    """

    _PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    _LETTERS = _byte_letters()

    def __init__(self, path: str, separator: str = "<|startoftext|>", end: str = "</w>", most: int = CACHE_WORDS, piece_bytes: int = PIECE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.most, self.separator, self.piece_bytes = Tokenizer.from_file(path), {}, most, separator, piece_bytes
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True
        self.separator_id = self.tokenizer.token_to_id(separator)

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """By the whole tokenizer."""
        out = {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words if "<|" in w}
        words = [w for w in words if "<|" not in w]
        groups = [words[k : k + 1024] for k in range(0, len(words), 1024)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([self.separator.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cut = np.flatnonzero(ids == self.separator_id)
            raw, starts, ends = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
            out.update((w, raw[a:b]) for w, a, b in zip(group, starts, ends, strict=True))
        return out

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Words of Latin-1 letters."""
        letters = [w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(self._LETTERS) for w in words]
        out = []
        for got in self.plain.encode_batch_fast([" ".join(letters[k : k + 1024]) for k in range(0, len(letters), 1024)], add_special_tokens=False):
            ids = np.array(got.ids, "<u4")
            raw, cut = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return out

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words as little-endian uint32."""
        ids = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            new = b"\n".join([words[k] for k in missing]).decode().split("\n")
            plain = list(map(bool, map(self._PLAIN.fullmatch, new)))
            easy = iter(self._encode_plain(list(itertools.compress(new, plain))))
            hard = self._encode([w for w, p in zip(new, plain, strict=True) if not p])
            found = [next(easy) if p else hard[w] for w, p in zip(new, plain, strict=True)]
            for k, x in zip(missing, found, strict=True):
                ids[k] = x
            if len(self.known) + len(found) > self.most:
                self.known = dict(itertools.islice(self.known.items(), len(self.known) // 2, None))  # the newer half stays
            self.known.update(zip([words[k] for k in missing], found, strict=True))
        return ids

    @staticmethod
    def _with_tails(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words, cut before the punctuation that follows a last letter or digit."""
        end = start + length
        last = np.maximum.accumulate(np.where(_TAIL[data], 0, np.arange(len(data))))[end - 1]  # the last byte that is no such punctuation
        here, before = data[last], data[np.maximum(last, 1) - 1]
        letter = _ALNUM[here] | ((before == 0xC3) & (here >= 0x80) & (here != 0x97) & (here != 0xB7) & (last > start))
        cut = np.flatnonzero((last >= start) & (last < end - 1) & letter)
        tail = last[cut] + 1
        length[cut] = tail - start[cut]
        order = np.argsort(np.concatenate([start, tail]), kind="stable")
        return np.concatenate([start, tail])[order], np.concatenate([length, end[cut] - tail])[order]

    def _piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words of a piece, the number of ids of each, and the ids."""
        start, length = self._with_tails(data, *word_places(data, cuts))
        return start, *look_up(data, start, length, self._ids_of, word_hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and n + 1 offsets) one after another, and the n + 1 offsets of each text's ids; with ``end_id`` after each text."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|": such texts keep their case
        data, kept = _LOWER[data], data
        for k in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
            data[offsets[k] : offsets[k + 1]] = kept[offsets[k] : offsets[k + 1]]
        starts, counts, ids = [], [], []
        for begin, stop in pieces(data, self.piece_bytes):
            a, b = np.searchsorted(offsets, (begin + 1, stop), "left")
            at, n, found = self._piece(data[begin:stop], offsets[a:b] - begin)
            starts.append(at + begin)
            counts.append(n)
            ids.append(found)
        none = np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(np.concatenate([none, *counts]))])
        at = sums[np.searchsorted(np.concatenate([none, *starts]), offsets, "left")]
        ids = np.concatenate([np.zeros(0, "<u4"), *ids])
        if end_id is None:
            return ids, at
        out = np.full(len(ids) + len(offsets) - 1, end_id, "<u4")
        at = at + np.arange(len(at))
        own = np.ones(len(out), bool)
        own[at[1:] - 1] = False
        out[own] = ids
        return out, at


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and ``end_id``, so every document has a piece. Repeated rows
    are documents of their own; extra columns are ignored; an empty table gives an empty one. ``sequence_id`` is
    unique, not gapless. A task that is run again gives the same windows if its partition has the same rows
    in the same order, as those of files have.
    """
    max_piece = min(max_piece, capacity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core; idle threads of the library would only spin
        encoder = _encoder(tokenizer_path)
        base, sequences = TaskContext.get().partitionId() << 32, itertools.count()
        done, waiting, tokens = [], [], 0  # rows for the result; pieces not packed yet
        id_type = None

        def close() -> None:
            nonlocal tokens
            window, at, ids = pack_sizes([p[2] for p in waiting], capacity), {}, {}
            for piece, w in zip(waiting, window, strict=True):
                if w not in ids:
                    ids[w], at[w] = base + next(sequences), 0
                done.append((*piece, ids[w], at[w]))
                at[w] += piece[2]
            waiting.clear()
            tokens = 0

        def rows() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 7
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)
            done.clear()
            return made

        for batch in batches:
            id_type = batch.schema.field(0).type
            names_of = batch.column(0).to_pylist()
            data, offsets = utf8_parts(batch.column(1))
            for first, last in chunks(offsets, PIECE_BYTES):
                ids, ids_at = encoder.encode(data, offsets[first : last + 1], end_id)
                raw = ids.tobytes()
                for doc, begin, stop in zip(names_of[first:last], ids_at[:-1].tolist(), ids_at[1:].tolist(), strict=True):
                    n = stop - begin
                    full = n // capacity * capacity
                    for a in range(0, full, capacity):
                        done.append((doc, a, capacity, raw[4 * (begin + a) : 4 * (begin + a + capacity)], n, base + next(sequences), 0))
                    rest = n - full
                    parts = -(-rest // max_piece)
                    for k in range(parts):
                        a, b = full + rest * k // parts, full + rest * (k + 1) // parts
                        waiting.append((doc, a, b - a, raw[4 * (begin + a) : 4 * (begin + b)], n))
                    tokens += rest
                    if tokens >= group_tokens:
                        close()
                yield rows()
        if id_type is not None:
            close()
            yield rows()

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("__text")), pack, schema)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces_digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
