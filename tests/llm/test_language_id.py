import random

import numpy as np
from pyspark.sql import functions as F
from tarn.llm import language_id as li

SYLLABLES = {"en": "the ing er th on re".split(), "de": "der sch ung ch ü ei".split(), "fr": "é eau que ment la ou".split()}


def prose(lang, rnd, n=60):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 4))) for _ in range(n))


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 5, 9, 30):
        code = li.codewords(n)
        gaps = [int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)]
        assert len(code) == n and min(gaps) >= 1 and (n < 4 or min(gaps) >= code.shape[1] // 4)


def test_features_are_of_the_whole_text():
    text = np.frombuffer(("a" * 200_000 + "zq").encode(), np.uint8)
    assert abs(float((li.features(text) ** 2).sum()) - 1) < 1e-4
    assert not np.array_equal(li.features(text), li.features(text[:-2]))
    assert li.features(text[:0]).any()  # only the boundary


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, prose(lang, rnd), lang if i % 7 else None, "lang clash") for i in range(600) for lang in [["en", "de", "fr"][i % 3]]]
    odd = [(9000, None, "en", "x"), (9001, "", "en", "x"), (9002, " 12 %% \n", "de", "x"), (None, prose("de", rnd), "de", "x"), (9003, prose("fr", rnd, 30_000), None, "x"), (9003, "q", None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = li.op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (9000, 9001, 9002))
    truth = {i: ["en", "de", "fr"][i % 3] for i in range(600)}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 80 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    again = li.op7_language_id(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table_one_language_and_no_labels(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert li.identify(empty, li.train(empty, F.lit(True)), ["doc_id"]).collect() == []
    none = spark.createDataFrame([(1, "abc", None)], schema)
    assert li.identify(none, li.train(none, F.lit(True)), ["doc_id"]).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc", "en"), (2, "zzz", None)], schema)
    assert {r.lang_pred for r in li.identify(one, li.train(one, F.lit(True)), ["doc_id"]).collect()} == {"en"}


def test_training_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('the ', id) text", "if(id % 2 = 0, 'en', 'de') lang")
    counts = []
    fit = li.fit
    try:
        li.fit = lambda x, y, langs: counts.append(len(y)) or fit(x, y, langs, rounds=2)
        li.train(docs, F.lit(True), most=300)
    finally:
        li.fit = fit
    assert 200 < counts[0] < 400


def plain_prediction(text, model):
    """Features, bit margins and loss-weighted decoding with plain loops."""
    import math

    raw = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    raw = [32 if c < 32 or 48 <= c <= 57 or chr(c) in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~" else c for c in raw]
    folded = [32, *(c for k, c in enumerate(raw) if k == 0 or c != 32 or raw[k - 1] != 32), 32]
    counts = [0] * li.FEATURES
    for n in range(1, 5):
        for at in range(len(folded) - n + 1):
            code = folded[at] + 1
            for c in folded[at + 1 : at + n]:
                code = (code * 257 + c) % 2**32
            counts[(code * 2654435761) % 2**32 >> 20] += 1
    size = math.sqrt(sum(counts))
    used = [(k, math.sqrt(c) / size) for k, c in enumerate(counts) if c]
    margins = [sum(x * float(model.weights[k, j]) for k, x in used) + float(model.bias[j]) for j in range(model.code.shape[1])]
    loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margins, strict=True)) for word in model.code.tolist()]
    best = min(range(len(loss)), key=lambda k: loss[k])
    return model.languages[best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def test_predictions_against_plain_loops(spark):
    rnd = random.Random(3)
    sounds = {"en": "the ing er th on re and".split(), "de": "der sch ung ich ü ei ß".split(), "fr": "é eau que ment la ou ç".split(), "es": "ción ñ los que el ado".split()}
    text = lambda lang: " ".join("".join(rnd.choices(sounds[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 30)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rnd.choices(list(sounds), k=200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs, ~li.held_out())
    for r in li.identify(docs.where("doc_id < 60"), model, ["doc_id", "text"]).collect():
        lang, score = plain_prediction(r.text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3
