import random
import re

import pytest
from pyspark.sql import functions as F
from tarn.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, windows = set(), {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            seen |= {i + k for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(seen))


TEXTS = [None, "", " ", "\n\n", "a", "für die\x0bKatz\n für die", "#a #b\n#a #b\n\n#a #b", "x\x85y z w  q", "one two three four five six seven eight " * 4, "z" * 50_000, "w " * 40_000]


@pytest.mark.parametrize("seed", range(3))
def test_counts_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = TEXTS + ["".join(rnd.choice(["a", "b", "ü", " ", "\n", "|", "\t"]) for _ in range(rnd.randrange(400))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.text_counts(docs, ["doc_id"]).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def corpus(n=600):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(60)]
        if i % 10 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "src0" if i % 2 else None, "extra"))
    return rows


def test_verdicts_keep_clean_and_drop_outliers(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, kept string")
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == 600 and all(r.kept == (r.doc_id % 10 != 0) for r in got)


def test_cut_offs_cover_every_row_and_merge(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, kept string")
    cuts = quality.cut_offs(quality._with_ratios(quality.text_counts(docs, ["doc_id", "lang", "source"]))).collect()
    by = {lvl: sum(r.n for r in cuts if r.level == lvl) for lvl in (0, 1, 2)}
    assert by == {0: 600, 1: 600, 2: 600}


def test_cut_offs_differ_between_groups_and_follow_the_data(spark):
    rnd = random.Random(8)
    text = lambda n, marks: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) + "#" * (rnd.random() < marks) for _ in range(n))
    rows = [(i, text(80, 0.0), "en", "plain") for i in range(300)] + [(1000 + i, text(80, 0.15), "en", "marked") for i in range(300)] + [(2000 + i, text(300, 0.02), "de", "long") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cuts = {r.source: r for r in quality.cut_offs(quality._with_ratios(quality.text_counts(docs, ["lang", "source"]))).where("level = 0").collect()}
    for name in quality.RATIOS:
        if name != "dup_line_share":  # a single line each
            assert len({round(getattr(c, f"cut_{name}"), 6) for c in cuts.values()}) >= 2, name
    assert cuts["plain"].cut_symbols_per_word < cuts["long"].cut_symbols_per_word < cuts["marked"].cut_symbols_per_word


def test_empty_table_and_query(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    empty = spark.createDataFrame([], schema)
    assert quality.quality_verdicts(empty).collect() == []
    spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "a b", "en", "x")], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op5_quality(spark, str(tmp_path)).collect()
    assert len(got) == 3 and not any(r.kept for r in got) and all(r.base_failed for r in got)


def skewed():
    """A clean source, one with 40 % junk, one document with some symbols; symbol-free words otherwise."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "clean") for i in range(600)]
    rows += [(1000 + i, " ".join(word() + "***" * (i % 5 < 2) for _ in range(60)), "en", "junk") for i in range(150)]
    return rows + [(2000, " ".join(word() + "#" * (i % 5 == 0) for i in range(60)), "en", "clean")]


def test_adaptive_cut_offs_decide_and_are_bounded(spark):
    import corpus_pipeline as cp

    rows = skewed()
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert kept == {r[0] for r in rows if "*" not in r[1] and "#" not in r[1]}
    assert {r.doc_id for r in cp.by_quality(spark, docs, "").collect()} == kept


def test_adaptive_words_of_a_language_stay_its_own(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(n + rnd.randrange(-1, 2))) for _ in range(60))
    rows = [(i, text(4), "en", "x") for i in range(500)] + [(500 + i, text(14), "fi", "x") for i in range(110)] + [(900, text(30), "fi", "x"), (901, text(14), "en", "x")]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not kept").collect()
    assert {r.doc_id for r in got} == {900, 901}


def test_rows_are_kept_whole_with_clashing_columns_nulls_and_repeats(spark):
    rows = [(*r[:4], 1.5, "k", [1]) for r in corpus() if r[0] % 10] + [(None, corpus()[1][1], None, None, 1.0, None, None), (7, None, "en", "x", 1.0, "k", None), (7, "", "en", "x", 1.0, "k", None)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words double, kept string, row array<int>")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(repr(r) for r in docs.collect() if r.text)
    same = docs.withColumns({"base_failed": F.lit("x"), "cut_repeat_share": F.lit(0), "__lang": F.lit(1), "level": F.lit("y")})
    assert quality.quality_verdicts(same).where("kept").count() == got.count()
    assert quality.keep_good(docs.where("false")).collect() == []
