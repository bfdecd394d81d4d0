import random

import pytest
import regex
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from tarn.llm import secret_scan as ss


@pytest.fixture(scope="module")
def model(spark):
    return ss.train(ss.labelled_findings(spark))


def test_held_out_findings(spark):
    rows = ss.labelled_findings(spark, 6000).withColumn("fold", F.pmod(F.xxhash64("value"), F.lit(5)))
    model = ss.train(rows.where("fold <> 0").drop("fold"))
    judged = ss.judge(rows.where("fold = 0"), model).select("label", "probability").collect()
    right = sum(r.label == (r.probability >= 0.5) for r in judged) / len(judged)
    assert len(judged) > 800 and right > 0.97


@pytest.mark.parametrize("kinds", [(1, 13), (3, 12)])
def test_whole_kinds_held_out(spark, kinds):
    """A kind of secrets and a kind of other findings that the forest has seen nothing of."""
    rows = ss.labelled_findings(spark)
    held = F.col("kind").isin(*kinds)
    judged = ss.judge(rows.where(held), ss.train(rows.where(~held))).collect()
    assert sum(r.label == (r.probability >= 0.5) for r in judged) / len(judged) > 0.8


def test_trees_as_expressions_give_the_forest_s_probabilities(spark, model):
    rows = ss.judge(ss.labelled_findings(spark, 900), model).withColumnRenamed("probability", "ours")
    vector = ss._vector(F.col("value"), F.col("before"), F.col("after"), F.col("path"), model.words)
    both = model.forest.transform(rows.withColumn("features", array_to_vector(vector))).select("ours", vector_to_array("probability")[1].alias("theirs")).collect()
    assert len(both) > 800 and all(abs(r.ours - r.theirs) < 1e-5 for r in both)


def test_no_findings_or_one_label(spark):
    none = ss.labelled_findings(spark).where("false")
    docs = spark.createDataFrame([(1, 'token = "4f3c2b1a4f3c2b1a4f3c2b1a"', None)], "doc_id long, text string, source string")
    assert [r.is_secret for r in ss.scan(docs, ss.train(none)).collect()] == [False]
    assert [r.is_secret for r in ss.scan(docs, ss.train(ss.labelled_findings(spark).where("label = 1"))).collect()] == [True]
    odd = spark.createDataFrame([(None, None, None, None, 1.0), ("abc123", None, None, None, None)], "value string, before string, after string, path string, label double")
    assert ss.train(odd.unionByName(ss.labelled_findings(spark).drop("kind"))).trees


def test_dictionary_of_the_corpus(spark):
    docs = spark.createDataFrame([("wald wald wald Baum",), ("wald baum x1 ab",), (None,), ("",)], "text string")
    assert set(ss.dictionary(docs, 1)) - set(ss.USUAL_WORDS) == {"wald"}
    assert set(ss.dictionary(docs)) - set(ss.USUAL_WORDS) == {"wald", "baum"}
    assert set(ss.dictionary(docs.where("false"))) == set(ss.USUAL_WORDS)


def test_assigned_values_are_found_whole(spark, model):
    docs = spark.createDataFrame([(1, "login with password=Sup3rSecret2024!x$9 and go.", "web"), (2, 'pwd = "q7#Lm2$vX9!r".', "web"), (3, "the password: your_password_here.", "web")], "doc_id long, text string, source string")
    assert [r.text for r in ss.redact(docs, model).orderBy("doc_id").collect()] == ["login with password=[SECRET] and go.", 'pwd = "[SECRET]".', "the password: your_password_here."]


def hexes(rnd, n):
    return "".join(rnd.choice("0123456789abcdef") for _ in range(n))


def test_secrets_are_found_and_lookalikes_are_not(spark, model):
    rnd = random.Random(4)
    secrets, rows = {}, []
    for i in range(60):
        value = [hexes(rnd, 40), "ghp_" + hexes(rnd, 36), "AKIA" + hexes(rnd, 16).upper()][i % 3]
        before = ['token = "', "secret: ", "access_key="][i % 3]
        rows.append((i, f"Words of prose ä {before}{value}\" go on.", None))
        secrets[i] = value
    rows += [(100 + i, f"Words of prose {b} go on, 98079157628044{i:02} and more", "src0") for i, b in enumerate(["commit " + hexes(rnd, 40), "sha256:" + hexes(rnd, 64), 'password = "changeme123456"', "see src/main/report2/index4"] * 5)]
    rows += [(200, None, None), (201, "", None), (202, "x1" * 40_000, None), (0, rows[0][1], None), (None, rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("start", F.lit("clash"))
    got = ss.scan(docs, model).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert text[r.doc_id][r.start : r.end] == r.value
    hits = {(r.doc_id, r.value) for r in got if r.is_secret}
    assert {(i, v) for i, v in secrets.items()} <= hits and len([r for r in got if r.doc_id == 0 and r.is_secret]) == 2
    assert not [h for h in hits if h[0] is not None and 100 <= h[0] < 200]
    clean = {r.doc_id: r for r in ss.redact(docs, model).collect()}
    assert set(clean) == set(text) and all(ss.MASK in clean[i].text and v not in clean[i].text for i, v in secrets.items())
    assert all(clean[d].text == text[d] for d in text if d is not None and 100 <= d <= 201) and clean[7].start == "clash"


def test_redaction_of_several_spans(spark, model):
    a, b = hexes(random.Random(1), 40), hexes(random.Random(2), 40)
    docs = spark.createDataFrame([(1, f'token = "{a}" ü token = "{b}".', "src1")], "doc_id long, text string, source string")
    assert ss.redact(docs, model).first().text == 'token = "[SECRET]" ü token = "[SECRET]".'


def test_empty_table(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert ss.scan(empty, model).collect() == [] and ss.redact(empty, model).collect() == []


def test_training_is_repeatable(spark, model):
    again = ss.train(ss.labelled_findings(spark))
    assert again.trees == model.trees


def plain_features(value, before, after, path, words):
    """The features one by one, in their order."""
    import itertools

    n = len(value)
    share = lambda test: sum(map(test, value)) / n
    kind = lambda c: "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-"
    parts = regex.findall("[A-Z]?[a-z]+|[A-Z]+", value)
    near = (before[-30:] + " " + after[:15]).lower()
    return [
        min(n, 200), share(lambda c: c in "0123456789"), share(lambda c: "A" <= c <= "Z"), share(lambda c: kind(c) == "-"), len(set(value)) / n,
        len(list(itertools.groupby(value, kind))) / n, share(lambda c: c in "aeiouAEIOU"), bool(regex.fullmatch("[0-9a-f]+|[0-9A-F]+", value)), sum(len(p) for p in parts if p.lower() in words) / n,
        value.count("/"), bool(regex.match("AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[abp]-|AIza|eyJ", value)), bool(regex.search("[=:]\\s{0,3}[\"']?$", before)), bool(regex.search("[\"'`]$", before)),
        bool(regex.search(f"(?:^|[^a-z])(?:[a-z_]*_)?(?:{ss.FOR})s?(?![a-z])", near)), bool(regex.search(f"(?:^|[^a-z])(?:{ss.AGAINST})(?![a-z])", near)), bool(regex.search("test|example|sample|fixture|mock|docs?/", path.lower())),
    ]


def plain_scan(text, path, model):
    out, at = [], 0
    found = list(regex.finditer(ss.CANDIDATE, text))
    for k, m in enumerate(found):
        before = text[at : m.start()][-80:]
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][:40]
        x = plain_features(m[0], before, after, path, set(model.words))
        votes = []
        for tree in model.trees:
            node = tree[0]
            while len(node) > 1:
                node = tree[node[2] if x[node[0]] <= node[1] else node[3]]
            votes.append(node[0])
        out.append((m.start(), m.end(), m[0], round(sum(votes) / len(votes), 6)))
        at = m.end()
    return out


def test_scan_against_a_plain_version(spark, model):
    findings = ss.labelled_findings(spark, 720).collect()
    rnd = random.Random(12)
    rows = []
    for i in range(0, len(findings), 3):
        part = findings[i : i + 3]
        rows.append((i, " ü, then ".join(f.before + f.value + f.after for f in part) + rnd.choice(["", ".", "!!", "\n"]), rnd.choice(["src0", "tests/a.py", None])))
    got = {}
    for r in ss.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), model).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.value, r.probability))
    for doc, text, path in rows:
        want = plain_scan(text, path or "", model)
        mine = sorted(got.get(doc, []))
        assert [w[:3] for w in want] == [m[:3] for m in mine] and all(abs(w[3] - m[3]) < 2e-6 for w, m in zip(want, mine, strict=True)), text
