import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tarn.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [".", ",", "#", "<|ENDOFTEXT|>", "a", "B", "é", "é", " ", "\n", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|endof", "'s", "'", "1", "中", "Σ", "ς", "́", "!", "\x0b", "İ", "ﬁ", "﻿", "<|startoftext|>", "word", "Word.", "Être", "straße,", "Ñ", "ÿ!", "×", "÷", "ª", "ñu"]


@pytest.mark.parametrize(("seed", "piece"), [(0, 1 << 21), (1, 64), (2, 300), (3, 1 << 21)])
def test_word_ids_are_those_of_the_whole_text(seed, piece):
    encoder, rnd = packing.WordEncoder(PATH, most=40, piece_bytes=piece), random.Random(seed)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randrange(40))) for _ in range(400)]
    for k in range(0, 400, 20):
        raw = [t.encode() for t in texts[k : k + 20]]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        ids, at = encoder.encode(data, offsets)
        ended, ended_at = encoder.encode(data, offsets, end_id=2)
        for i, text in enumerate(texts[k : k + 20]):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[at[i] : at[i + 1]].tolist() == want, text
            assert ended[ended_at[i] : ended_at[i + 1]].tolist() == [*want, 2]


def test_words_with_one_hash_are_kept_apart(monkeypatch):
    monkeypatch.setattr(packing, "word_hashes", lambda data, start, length: np.zeros(len(start), np.uint64))
    encoder, text = packing.WordEncoder(PATH), "some words, and someotherwords with a commonstartingpart commonstartinghalf."
    ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randrange(1, 1025) for _ in range(rnd.randrange(1, 900))]
    window, most = packing.karmarkar_karp(sizes, 7)
    sums = [0] * 7
    for s, w in zip(sizes, window, strict=True):
        sums[w] += s
    assert max(sums) == most and (len(sizes) < 100 or max(sums) - min(sums) <= 30)
    packed, sums = packing.pack_sizes(sizes), defaultdict(int)
    for s, w in zip(sizes, packed, strict=True):
        sums[w] += s
    assert max(sums.values()) <= 4096 and len(sums) <= -(-sum(sizes) // 4096) * 1.05 + 1


def test_sizes_that_do_not_fit_raise_the_window_count():
    assert len(set(packing.pack_sizes([3000, 3000, 3000]))) == 3
    with pytest.raises(ValueError):
        packing.pack_sizes([5000])


def test_every_id_in_exactly_one_piece(spark, tmp_path):
    rnd = random.Random(3)
    texts = [None, "", " \n", "z" * 9000, "1 " * 4095, "1 " * 4096, "<|endoftext|>"] + [" ".join(rnd.choices(["alpha", "Beta,", "été", "中文", "x1"], k=rnd.randrange(5000))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "null id", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = packing.op4_packing(spark, str(tmp_path)).collect()
    tokenizer = packing.WordEncoder(PATH).tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, text in [(r[0], r[1]) for r in rows]:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted(by_doc[doc], key=lambda p: p.start)
        mine = mine[::2] if doc == 3 else mine
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
        assert all(p.doc_tokens == len(ids) for p in mine) and sum(p.length for p in mine) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
    for inside in by_sequence.values():
        inside.sort(key=lambda p: p.offset)
        assert [p.offset for p in inside] == [sum(q.length for q in inside[:k]) for k in range(len(inside))]
        assert sum(p.length for p in inside) <= 4096


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
