import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tarn.llm import fingerprints as fp
from .test_near_dedup import shingle_set

SCHEMA = "doc_id long, text string, range string, tie long"


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 5)))
    texts = [None, "", " ", "a", "w " * 50_000] + [" ".join(word() for _ in range(rnd.randrange(200))) for _ in range(n)]
    texts[20] = texts[21]
    ids = rnd.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "range_rows"), [(1, 2000), (2, 7), (3, 40)])
def test_edited_texts_and_likeness(spark, tmp_path, monkeypatch, seed, range_rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    rows = sorted(rows_of(seed), key=lambda r: -r[0])
    spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fp.op3_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    errors, prints = [], {}
    for (doc, text), (next_doc, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, after, r = text or "", after or "", got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (shingle_set(x, 5) for x in (text, edited, after))
        errors += [r.near_edited - (len(a & b) / len(a | b) if a | b else 1), r.near_next - (len(a & c) / len(a | c) if a | c else 1)]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        places = lambda x: np.frombuffer(bytes.fromhex(x), ">u2")
        assert r.near_edited == fp.likeness(places(r.fingerprint), places(r.edited_fingerprint))
        assert r.near_next == fp.likeness(places(r.fingerprint), places(got[next_doc].fingerprint))
    assert max(map(abs, errors)) < 0.25 and abs(np.mean(errors)) < 0.01


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    ids = [*range(500), *(10**9 + 7 * k for k in range(300)), 2**62, -(2**40), None, None, *[42] * 30]
    rows = fp.with_next(spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")).collect()
    sizes = {}
    for r in rows:
        sizes[r.range] = sizes.get(r.range, 0) + 1 - r.after
    assert sum(sizes.values()) == len(ids) and len(sizes) > 50 and max(sizes.values()) <= 31 + 20
    order = [r.doc_id for k in sorted(sizes) for r in rows if r.range == k and not r.after]
    assert order == sorted((i for i in ids if i is not None), reverse=True) + [None, None]


def test_ties_nulls_lone_and_empty(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fp.compare_with_edits(df([])).collect() == []
    lone = fp.compare_with_edits(df([(5, "abcd")])).collect()
    assert len(lone) == 1 and lone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone[0].near_next == 1
    many = fp.compare_with_edits(df([(5, "x"), (5, "x"), (5, "y"), (None, "n"), (None, None)])).collect()
    assert len(many) == 5
    assert len(fp.compare_with_edits(df([(None, "n"), (None, None)])).collect()) == 2


def test_matches_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(25):
        base = [f"w{rnd.randrange(500)}" for _ in range(60)]
        for _ in range(6):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                own[rnd.randrange(60)] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r.jaccard for r in fp.near_matches(docs.where(F.col("doc_id") % 5 == 0), docs).collect()}
    want = {}
    for q, x in rows:
        for d, y in rows:
            a, b = shingle_set(x, 5), shingle_set(y, 5)
            if q is not None and d is not None and q % 5 == 0 and q != d and a and b and len(a & b) >= 0.8 * len(a | b):
                want[q, d] = len(a & b) / len(a | b)
    assert got == pytest.approx(want)
