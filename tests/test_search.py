import itertools
import random

import pytest
from pyspark.sql import functions as F
from tarn.operators import postings as P
from tarn.operators import query as Q
from tarn.operators.index import Index, build_index

B1 = [(1, "red fox jumps"), (2, "red dog")]
B2 = [(10, "is dead. so"), (11, "nac anac banana engineering prefix")]


@pytest.fixture(scope="module")
def built(spark):
    make = lambda rows: build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    return {"b1": make(B1), "b2": make(B2)}


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_stats(built):
    s = built["b1"].stats.first()
    assert (s.total_docs, s.avg_doc_length) == (2, 2.5)
    assert {r.term: r.tf for r in built["b1"].doc_terms.where("doc_id = 1").collect()} == {"red": 1, "fox": 1, "jump": 1}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("red", {1, 2}), ('"red fox"', {1}), ("red AND fox", {1}), ("fox OR dog", {1, 2}), ('"red fox" AND jumps', {1}), ('"red fox jumps"', {1}), ('"red jumps"', set()),
        ('"red fox" OR "red dog"', {1, 2}), ("red fox AND jumps", {1}), ('f*x AND "red fox"', {1}), ("NOT dog", {1}), ("NOT NOT dog", {2}), ("red NOT fox", {2}), ("(fox OR dog) AND NOT jumps", {2}),
        ("", set()), ("fox AND", set()), ("AND fox", set()), ("the AND fox", set()), ("( the )", set()), ('"red fox', set()), ("fox)", set()), ("zebra", set()), ("NOT zebra", {1, 2}), ("r* -,; fox", {1}), ("*", {1, 2}),
    ],
)
def test_queries(built, query, want):
    assert ids(Q.matching_documents(built["b1"], query)) == want


@pytest.mark.parametrize(("query", "want"), [('"dead so"', set()), ("*nac*", {11}), ("en*ering", {11}), ("ban*", {11}), ("*ana", {11}), ("pre*fix", {11}), ('"the cat"', set()), ('"is dead"', {10}), ('"nac an*"', {11}), ('"nac *x"', set())])
def test_wildcards_and_sentences(built, query, want):
    assert ids(Q.matching_documents(built["b2"], query)) == want


@pytest.mark.parametrize(("pattern", "want"), [("ca*", "car card care cat"), ("car*", "car card care"), ("*ar", "car"), ("*at", "cat"), ("*ple", "apple"), ("xyz*", ""), ("c*r", "car"), ("aba*ba", ""), ("*a*", "aba apple car card care cat"), ("c*a*d", "card"), ("a1*", "a1b"), ("*", "a1b aba apple car card care cat dog")])
def test_expansion(spark, pattern, want):
    index = build_index(spark.createDataFrame([(1, "car card care cat dog apple aba a1b")], "doc_id long, text string"))
    assert sorted(r.term for r in Q.expand(index, pattern).collect()) == want.split()
    if pattern == "aba*ba":
        assert [r.term for r in Q.expand(index, pattern, overlap=True).collect()] == ["aba"]


def test_parse_errors_and_stopwords():
    assert Q.parse("a OR").error and Q.parse('"x').error and Q.parse("the of and").stopwords_only and not Q.parse("").stopwords_only
    assert Q.parse("x or y").terms == ("x", "y") and Q.parse("not x").terms == ("not", "x") and Q.parse("x x NOT z").terms == ("x", "x", "z")


def random_query(rnd, depth=3):
    if depth == 0 or rnd.random() < 0.3:
        return rnd.choice(["ka", "lo", "mi", "nu", '"ka lo"', '"lo mi ka"', "k*", "*u", "zz"])
    a, b = random_query(rnd, depth - 1), random_query(rnd, depth - 1)
    return rnd.choice([f"({a} AND {b})", f"({a} OR {b})", f"NOT {a}", f"({a} {b})", f"({a} NOT {b})"])


def test_flag_form_is_the_join_form(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choices(["ka", "lo", "mi", "nu", "the", "."], k=rnd.randrange(9)))) for i in range(60)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    words = {i: set(t.replace(".", " ").split()) - {"the"} for i, t in docs}
    for _ in range(8):
        query = random_query(rnd)
        assert ids(Q.matching_documents(index, query)) == ids(Q.matching_documents_by_joins(index, query)), query
    assert ids(Q.matching_documents(index, "(ka OR NOT lo) mi")) == {i for i, w in words.items() if ("ka" in w or "lo" not in w) and "mi" in w}


def test_phrases_against_plain_python(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices(["ka", "lo", "the", "x.", "!", "lo,"], k=rnd.randrange(14)))) for i in range(120)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    import re

    for phrase in ("ka lo", "lo lo", "the ka", "ka the lo", "lo"):
        want = {i for i, t in docs if any(re.search(rf"(?:^| ){phrase}(?: |$)", " ".join(re.findall("[a-z]+", s))) for s in re.split("[.!?]", t))}
        assert ids(Q.matching_documents(index, f'"{phrase}"')) == want


def test_postings_algebra(spark):
    rnd = random.Random(1729)
    make = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "doc_id long, tf int, positions array<int>")
    a, b = {2: (5, [1, 3, 5, 7, 9]), 4: (2, [10, 20])}, {2: (1, [99]), 6: (3, [100, 200, 300])}
    rows = lambda df: {r.doc_id: (r.tf, r.positions) for r in df.collect()}
    assert rows(P.intersect(make(a), make(b))) == {2: a[2]} and rows(P.difference(make(a), make(b))) == {4: a[4]}
    for f in (P.union, P.union_with_skips, P.intersect_with_skips, P.intersect_with_exponential_skips, lambda x, y: P.intersect_with_fixed_skips(x, y, 3)):
        assert rows(f(make(a), make(b))) == {6: b[6], 2: a[2], 4: a[4]}
    for density in (0.1, 0.95):
        x, y = ({i for i in range(200) if rnd.random() < density} for _ in range(2))
        fx, fy = (spark.createDataFrame([(i,) for i in s], "doc_id long") for s in (x, y))
        assert ids(P.union(fx, fy)) == x | y and ids(P.intersect(fx, fy)) == x & y and ids(P.difference(fx, fy)) == x - y
    assert ids(P.extract_doc_ids(make(a))) == {2, 4}


def test_index_edges_and_saved_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, ["Alpha", "beta"]), (2, "", "Title words", None), (3, "x. y", None, None)], "doc_id long, text string, title string, tokens array<string>")
    index = build_index(docs)
    assert ids(Q.matching_documents(index, "alpha")) == {1} and ids(Q.matching_documents(index, "title")) == set()
    assert ids(Q.matching_documents(build_index(docs, index_title=True), "title")) == {2}
    assert {r.doc_id: r.doc_len for r in index.doc_stats.collect()} == {1: 2, 2: 0, 3: 2}
    index.save(f"{tmp_path}/index")
    again = Index.open(spark, f"{tmp_path}/index")
    assert again.stats.first() == index.stats.first() and ids(Q.matching_documents(again, "x OR alpha")) == {1, 3}
    assert index.stats.first().version != build_index(docs.where("doc_id < 3")).stats.first().version
    empty = build_index(docs.limit(0))
    assert tuple(empty.stats.first())[:2] == (0, 0.0) and ids(Q.matching_documents(empty, "NOT x")) == set()


def test_candidates(spark):
    rows = [(0, "apple banana cherry apple"), (1, "banana cherry date"), (2, "cherry date elderberry"), (3, "apricot application apply")]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    found, df = Q.candidates(index, "apple OR cherry")
    assert {(r.doc_id, r.term, r.tf) for r in found.collect()} == {(0, "apple", 2), (0, "cherry", 1), (1, "cherry", 1), (2, "cherry", 1)}
    assert {r.term: r.df for r in df.collect()} == {"apple": 1, "cherry": 3}
    found, _ = Q.candidates(index, "NOT apple")
    assert all(r.term is None for r in found.collect()) and len(list(itertools.chain(found.collect()))) == 3
    assert {r.term: r.qtf for r in Q.query_terms(index, "apple apple app*").collect()} == {"apple": 2, "application": 1, "apply": 1}
    assert Q.query_terms(index, "zz").where(F.col("df") > 0).isEmpty()
