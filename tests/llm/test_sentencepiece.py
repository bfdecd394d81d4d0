import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tarn.llm import sentencepiece_io as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "  ", "\n", "a", "the", "é", "中", "😀", "▁", "<s>", "<unk>", "<0x0A>", "\t", "　", "x" * 30, "ing", "1", "\x00", "ﬁ", "é", "The"]


def random_texts(seed, n=500):
    rnd = random.Random(seed)
    return [None, "", " ", "\n", "▁"] + ["".join(rnd.choices(ALPHABET, k=rnd.randrange(12))) for _ in range(n)] + ["word " * 30_000, "y" * 20_000]


def model_bytes(pieces, model_type, byte_fallback=False):
    """A small model file, so that the other model type is covered without training one."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def part(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    out = b"".join(part(1, part(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces)
    trainer = b"\x18" + bytes([model_type]) + varint(35 << 3) + bytes([byte_fallback])
    return out + part(2, trainer) + part(3, part(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_the_librarys(seed):
    assert sp.parity([t or "" for t in random_texts(seed)], PATH) == []


@pytest.mark.parametrize("piece", [8, 100])
def test_pieces_of_a_text_end_where_words_begin(monkeypatch, piece):
    monkeypatch.setattr(sp, "PIECE_BYTES", piece)
    rnd = random.Random(piece)
    letters = [x for x in ALPHABET if "▁" not in x]
    assert sp.parity(["".join(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(300)], PATH) == []


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_model(fallback):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    rnd = random.Random(9)
    words = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "▁ba", "c", "abc", "▁c", "bc", "é"]
    pieces += [(w, -rnd.uniform(1, 9), 1) for w in words]
    data = model_bytes(pieces, sp.UNIGRAM, fallback)
    codec, ours = sp.PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["".join(rnd.choices(["a", "b", "c", " ", "é", "abc"] + ["z"] * fallback, k=rnd.randrange(12))) for _ in range(300)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ours.encode(text), text
    assert codec.decode(codec.encode(texts)) == [t if t.strip(" ") or not t else t for t in texts]


def test_query_round_trip_and_edges(spark, tmp_path):
    texts = random_texts(5, 200)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", None), (0, "again", None)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sp.op9_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in got:
        if r.doc_id in (None, 0):
            continue
        text = texts[r.doc_id]
        ids = np.array(processor.encode(text), "<u4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r.round_trip == ("▁" not in text)
        assert not r.round_trip or r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_null_text_extra_columns_and_empty_table(spark):
    model = open(PATH, "rb").read()
    df = spark.createDataFrame([(None, 3.5, "b")], "text string, decoded double, tag string")
    row = sp.decode(sp.encode(df, model), model).first()
    assert row.ids is None and row.decoded is None and row.tag == "b"
    assert sp.encode(df.limit(0), model).collect() == []


def test_invalid_bytes_are_decoded_like_the_library():
    codec = sp.PieceCodec(open(PATH, "rb").read())
    ids = np.array([codec.words.token_to_id("<0xE4>"), codec.words.token_to_id("▁a")], "<u4").tobytes()
    assert "�" in codec.decode([ids])[0]
