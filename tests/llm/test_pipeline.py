import random
from collections import Counter

import corpus_pipeline as cp

from .test_near_dedup import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the ing er th on re".split(), "de": "der sch ung ch ü ei".split(), "fr": "é eau que ment la ou".split()}


def corpus(n=240):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        words = ["".join(rnd.choices(SYLLABLES[lang], k=rnd.randrange(1, 5))) for _ in range(80)]
        if i % 12 == 1:
            words = rows[-1][1].split()
            words[rnd.randrange(80)] = "changed"
            lang = rows[-1][2]
        if i % 15 == 2:
            words.insert(40, 'token = "' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + '"')
        if i % 20 == 4:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), lang, f"src{i % 2}"))
    rows += [(1000, None, "en", "src0"), (1001, "", None, None), (1002, "12 34 %%", "en", "src0"), (1003, "short text", "en", "src0")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def test_stages_one_by_one(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    after = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
    ids = lambda name: {r.doc_id for r in after[name].collect()}
    text = {r[0]: r[1] for r in rows}
    assert ids("language_id") == set(text) - {1000, 1001, 1002}
    junk = {i for i in range(240) if i % 20 == 4 and i % 12 != 1}
    assert ids("quality_rules") >= {i for i in range(240) if "***" not in text[i]} and not ids("quality_rules") & junk and 1003 not in ids("quality_rules")
    left = sorted(ids("quality_rules"))
    sets = {i: shingle_set(text[i], 5) for i in left}
    for i in left:
        twins = [j for j in left if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert (i in ids("near_dedup")) == (i == min(twins))
    clean = {r.doc_id: r for r in after["secret_scan"].collect()}
    assert set(clean) == ids("near_dedup")
    for i, r in clean.items():
        assert r.n_chars == len(r.text) and ("[SECRET]" in r.text) == ("token =" in text[i])
    tokens = Counter()
    for r in after["packing"].collect():
        tokens[r.doc_id] += r.length
        assert r.offset + r.length <= 4096
    assert set(tokens) == set(clean) and tokens == {r.doc_id: r.doc_tokens for r in after["packing"].collect()}


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(corpus(60), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 30
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").collect() == []


def test_quality_stage_judges_rows_of_one_id_each_and_without_id(spark):
    rows = [r for r in corpus() if r[0] < 240 and r[0] % 20 != 4]
    good, junk = rows[0][1], " ".join(w + "***" for w in rows[0][1].split())
    rows += [(i, t, "en", "src0", len(t)) for i in (5000, None) for t in (good, junk, "short text")]
    left = cp.by_quality(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [r.text for r in left if r.doc_id in (5000, None)] == [good, good]


def test_near_duplicates_without_ids_with_one_id_and_repeated(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (None, a + " tail"), (5, b), (5, b + " tail"), (5, b), (5, c), (6, c), (6, c), (None, c), (7, None), (7, None), (8, ""), (9, "lone words stand here alone")]
    docs = spark.createDataFrame([(*r, None, "x", 1, "more") for r in rows], SCHEMA + ", extra string")
    got = cp.without_near_duplicates(spark, docs, "")
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert got.columns == list(cp.COLUMNS)
    one_a = [t for i, t in left if i is None]
    assert len(one_a) == 1 and one_a[0] in (a, a + " tail")
    fives = [t for i, t in left if i == 5]
    assert sorted(t[:2] for t in fives) == ["b0", "c0"]
    assert sorted(i for i, _ in left if i is not None) == [5, 5, 7, 7, 8, 9]


def test_stages_with_nulls_in_every_column(spark):
    rows = [r for r in corpus() if r[0] < 120 and r[0] % 20 != 4]
    rows += [(None, None, None, None, None), (3, rows[0][1], None, None, None), (None, rows[1][1], None, "src0", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES:
        got = stage(spark, docs, "").collect()
        assert got and (name == "packing" or all(r.text is not None for r in got) or name in ("near_dedup", "secret_scan")), name
    masked = cp.without_secrets(spark, docs, "").where("text is null").collect()
    assert [(r.text, r.n_chars) for r in masked] == [(None, None)]
