"""SentencePiece encoding and decoding through the tokenizers library.

The model file's protobuf is read field by field; normaliser, dummy prefix, white-space mark, unigram scores or
BPE merges and byte fallback are rebuilt as a tokenizers pipeline. Batches are encoded multithreaded.

A text is encoded word by word where the vocabulary allows it (no piece has the white-space mark after
another character, none holds a line feed): then no piece reaches across a word's start or a line feed, and the ids
of the words, in order, are those of the text. Distinct words of a piece of text are looked up once and remembered up to a bound, and ids are gathered with numpy.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, chunks, map_arrow, table, utf8_parts
from .lookup import gather, look_up

MARK = "▁"
CACHE_WORDS = 250_000
#: Bytes of text that are encoded at once.
PIECE_BYTES = 1 << 21
#: Threads of the tokenizers library in a Python worker.
THREADS = 2
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the model format.
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protobuf message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True
    space_suffix: bool = False

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> PieceModel:
    m = PieceModel()
    for number, _, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | {n: v for n, _, v in _fields(value)}
            m.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = {n: v for n, _, v in _fields(value)}
            m.model_type, m.byte_fallback, m.space_suffix = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        elif number == 3:
            spec = {n: v for n, _, v in _fields(value)}
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.strip_spaces, m.escape_spaces = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    return m


def bpe_merges(m: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which the model would merge them: by score of what they make."""
    known = {p: (score, i) for i, (p, score, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, (score, _) in known.items():
        parts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in known and piece[k:] in known]
        parts.sort(key=lambda p: (known[p[0]][1], known[p[1]][1]))
        found += [(score, p) for p in parts]
    found.sort(key=lambda x: -x[0])  # stable
    return [p for _, p in found]


def build_tokenizer(m: PieceModel, whole: bool = True):
    """A tokenizers pipeline that encodes whole texts, or with ``whole`` false normalised words, and decodes ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if m.space_suffix or not m.escape_spaces:
        raise ValueError("a white-space mark before words is asked for")
    unknown = m.pieces[m.unknown_id][0]
    if m.model_type == UNIGRAM:
        scores = [(p, score if kind in (NORMAL, USER_DEFINED, UNKNOWN) else -1e9) for p, score, kind in m.pieces]
        model = models.Unigram(scores, unk_id=m.unknown_id, byte_fallback=m.byte_fallback)
    elif m.model_type == BPE:
        model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=bpe_merges(m), unk_token=unknown, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
    else:
        raise ValueError(f"model type {m.model_type}")
    t = Tokenizer(model)
    t.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, kind in m.pieces if kind == USER_DEFINED])
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if m.dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)]
    if whole:
        t.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


class PieceCodec:
    """Encodes texts to ids and back; one for a worker."""

    def __init__(self, data: bytes, most: int = CACHE_WORDS):
        from tokenizers import pre_tokenizers

        self.model = m = parse_model(data)
        self.whole, self.words = build_tokenizer(m), build_tokenizer(m, whole=False)
        pieces = [p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)]
        self.by_word = (
            m.byte_fallback and m.dummy_prefix and not m.charsmap and not m.strip_spaces
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and all(kind != USER_DEFINED for _, _, kind in m.pieces)
        )
        self.words.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")  # a line feed's byte tells words apart
        self.known, self.most = {}, most
        if self.by_word:
            self.line_feed = self.words.token_to_id("<0x0A>")
            self.known[b"\n"] = np.array([self.line_feed], "<u4").tobytes()
        decoded = [self._bytes(i) for i in range(len(m.pieces))]
        self.sizes, self.letters = np.array(list(map(len, decoded)), np.int64), np.frombuffer(b"".join(decoded), np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes

    def _bytes(self, i: int) -> bytes:
        """What the rebuilt decoder makes of a piece inside a text."""
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        inside = next(k for k, p in enumerate(self.model.pieces) if p[2] == NORMAL and MARK not in p[0])
        return self.words.decode([inside, i], skip_special_tokens=False)[len(self.model.pieces[inside][0]) :].encode()

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        groups = ["\n".join(words[k : k + 1024]) for k in range(0, len(words), 1024)]
        for got in self.words.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(got.ids, "<u4")
            cut = np.flatnonzero(ids == self.line_feed)
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), len(raw)], strict=True))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, in which spaces stand for the mark."""
        ids = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            new = [words[k] for k in missing]
            found = list(self._encode_words([w.decode().replace(" ", MARK) for w in new]))
            for k, x in zip(missing, found, strict=True):
                ids[k] = x
            if len(self.known) + len(found) > self.most:
                self.known = dict(itertools.islice(self.known.items(), len(self.known) // 2, None)) | {b"\n": self.known[b"\n"]}
            self.known.update(zip(new, found, strict=True))
        return ids

    def encode_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and n + 1 offsets) one after another, and the n + 1 offsets of each text's ids."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        sizes = np.diff(offsets)
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else []
        if not self.by_word or len(marks):  # or a text has the mark itself
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids = [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])
        at = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])  # with a space before each text that isn't empty
        spaced = np.full(at[-1], 32, np.uint8)
        own = np.ones(len(spaced), bool)
        own[at[:-1][sizes > 0]] = False
        spaced[own] = data
        starts, counts, ids = [], [], []
        begin, n = 0, len(spaced)
        while begin < n:
            stop, most = n, PIECE_BYTES
            while begin + most < n:  # a piece ends where a word begins
                window = spaced[begin : begin + most]
                edge = np.flatnonzero((window[1:] == 32) & (window[:-1] != 32))
                if len(edge):
                    stop = begin + int(edge[-1]) + 1
                    break
                most *= 2
            piece, cuts = spaced[begin:stop], at[(at > begin) & (at < stop)] - begin
            space, feed = piece == 32, piece == 10
            first = feed.copy()
            first[1:] |= (space[1:] & ~space[:-1]) | (~space[1:] & feed[:-1])
            first[0] = first[cuts] = True
            start = np.flatnonzero(first)
            number, found = look_up(piece, start, np.diff(np.append(start, len(piece))), self._ids_of)
            starts.append(start + begin)
            counts.append(number)
            ids.append(found)
            begin = stop
        none = np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(np.concatenate([none, *counts]))])
        return np.concatenate([np.zeros(0, "<u4"), *ids]), sums[np.searchsorted(np.concatenate([none, *starts]), at, "left")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        raw = [t.encode() for t in texts]
        ids, at = self.encode_parts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """By the decoder's bytes of each piece; ids whose bytes are no UTF-8 go through the decoder itself."""
        numbers = np.frombuffer(b"".join(ids), "<u4")
        sizes = self.sizes[numbers]
        whole = gather(self.letters, self.places[numbers], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        out = []
        for x, a, b in zip(ids, ends[:-1], ends[1:], strict=True):
            try:
                text = whole[a:b].decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.words.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False))
        return out


@functools.lru_cache(maxsize=2)
def _codec(data: bytes) -> PieceCodec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return PieceCodec(data)


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """All columns of docs with ``ids`` (binary, little-endian uint32; replaces a column of that name) of every whole text. A null text gives null, an empty one no ids."""
    carry = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        codec = _codec(model)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = utf8_parts(column)
            there = column.is_valid().to_pylist()
            for a, b in chunks(offsets, PIECE_BYTES):
                ids, at = codec.encode_parts(data, offsets[a : b + 1])
                raw, at = ids.tobytes(), (4 * at).tolist()
                found = [raw[x:y] if t else None for x, y, t in zip(at[:-1], at[1:], there[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(found, pa.binary())], [*carry, "ids"])

    return map_arrow(docs.select(*carry, F.col(text).alias("__text")), run, docs.select(*carry).schema.add("ids", "binary"))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """All columns with ``decoded``, the text of ``ids`` (replaces a column of that name). Null ids give null."""
    carry = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches_of(batches, 64):
            ids = batch.column(batch.num_columns - 1).to_pylist()
            texts = [x if i is not None else None for x, i in zip(codec.decode([i or b"" for i in ids]), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*carry, "decoded"])

    return map_arrow(encoded.select(*carry, F.col("ids").alias("__ids")), run, encoded.select(*carry).schema.add("decoded", "string"))


def parity(texts: list[str], path: str) -> list[int]:
    """Places of the texts whose ids differ from the sentencepiece library's."""
    import sentencepiece

    with open(path, "rb") as f:
        codec = PieceCodec(f.read())
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    got = codec.encode(texts)
    return [k for k, (a, b) in enumerate(zip(got, want, strict=True)) if np.frombuffer(a, "<u4").tolist() != b]


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:  # on the driver; the bytes go with the tasks
        model = f.read()
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return both.select(
        "doc_id",
        (F.coalesce(F.octet_length("ids"), F.lit(0)) / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
