import json
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tarn.functions.sql import register_functions
from tarn.functions.text import lemma_of
from tarn.functions.words import STOPWORD_NOTICE
from tarn.operators import ranking, simple
from tarn.operators.index import build_index
from tarn.operators.query import query_terms
from tarn.plans import catalog, measure
from tarn.plans.cache import CacheManager, LRUCache, SQLiteCache, cache_key
from tarn.plans.engine import Feedback, SearchEngine
from tarn.sources import corpus
from tarn.tables import shared_dir
from tarn.web import answer, marked

DOCS = [
    (0, "Intro", "http://a/0", "machine learning introduction and machine methods"), (1, "Deep", "http://a/1", "deep machine learning with networks"), (2, "Data", "http://a/2", "databases store rows"),
    (3, "Nets", "http://a/3", "neural networks learn weights"), (4, "Food", "http://a/4", "cooking pasta and rice"), (5, "Learn", "http://a/5", "learning to learn languages"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("engine"))
    built = build_index(spark.createDataFrame(DOCS, "doc_id long, title string, url string, text string"))
    built.save(f"{path}/index")
    return type(built).open(spark, f"{path}/index")


@pytest.fixture
def engine(index):
    return SearchEngine(index)


def test_search_and_cache(engine):
    first = engine.search("machine learning", k=3)
    assert [r["doc_id"] for r in first] == [0, 1] and [r["rank"] for r in first] == [1, 2] and first.rows[0]["title"] == "Intro" and "machine" in first.rows[0]["snippet"]
    assert engine.search("machine   learning", k=3).rows == first.rows and engine.stats()["cache_hits"] == 1
    assert len(engine.search("machine OR cooking")) == 3 and len(engine.search("machine or cooking")) == 0
    assert len(engine.search("", k=3)) == len(engine.search("machine", k=0)) == 0
    for mode in ("tfidf", "vector", "idf_sum"):
        assert [r["doc_id"] for r in engine.search("machine learning", mode=mode)] == [0, 1]
    with pytest.raises(ValueError):
        engine.search("machine", mode="x")


def test_not_only_and_stopwords(engine):
    assert [(r["doc_id"], r["score"]) for r in engine.search("NOT machine")] == [(2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0)]
    found = engine.search("the of and", k=4)
    assert found.notice == STOPWORD_NOTICE and [r["doc_id"] for r in found] == [0, 1, 2, 3] and len(engine.cache) == 1


def test_mmr_and_strict(engine):
    found = engine.search("learning OR networks", k=2, use_mmr=True)
    assert len(found) == 2 and found.rows[0]["score"] >= found.rows[1]["score"]
    assert {r.score for r in engine.plan("learning", strict_parity=True).collect()} == {0.0} and engine.plan("learning").first().score > 0


def test_feedback(engine):
    session = engine.open_session()
    plain = engine.search("learning OR networks", session).rows
    assert engine.mark_relevant(session, 3) and not engine.mark_relevant(session, 77) and engine.feedback_of(session).boosts
    entries = len(engine.cache)
    personal = engine.search("learning OR networks", session).rows
    assert personal[0]["doc_id"] == 3 and {r["doc_id"] for r in personal} == {r["doc_id"] for r in plain} and len(engine.cache) == entries
    engine.reset_feedback(session)
    assert engine.search("learning OR networks", session).rows == plain
    with pytest.raises(ValueError):
        engine.mark_relevant(" ", 1)


def test_service(engine):
    status, body = answer(engine, "GET", "/api/search?q=machine&k=900", {})
    assert status == 200 and len(body["results"]) == 2 and "<mark>machine</mark>" in body["results"][0]["snippet"] and json.dumps(body)
    assert answer(engine, "POST", "/api/feedback", {"session": "s", "doc_id": 0}) == (200, {"ok": True}) and answer(engine, "POST", "/api/reset", {"session": "s"})[0] == 200
    assert answer(engine, "GET", "/api/stats", {})[1]["total_docs"] == 6 and answer(engine, "GET", "/x", {})[0] == 404 and answer(engine, "GET", "/api/search?q=a1&mode=zz", {})[0] == 400
    assert marked("<b> cat concat", ["cat"]) == "&lt;b&gt; <mark>cat</mark> concat"


def test_lru():
    cache = LRUCache(2)
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and len(cache) == 2 and "b" in cache
    cache.get("b")
    cache.put("d", 1)
    assert "c" not in cache and cache.remove("b") and not cache.remove("b")
    with pytest.raises(ValueError):
        LRUCache(0)
    threads = [threading.Thread(target=lambda i=i: [cache.put((i, k), k) for k in range(200)]) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(cache) == 2


def test_durable_cache(tmp_path):
    path = f"{tmp_path}/c.db"
    key = cache_key("a  b", "bm25", 3, False, "v1")
    CacheManager(2, path, "v1").put(key, [{"doc_id": 1}])
    fresh = CacheManager(2, path, "v1")
    assert fresh.get(key) == [{"doc_id": 1}] and key in fresh.near and SQLiteCache(path, "v2").get(key) is None
    assert fresh.remove(key) and not fresh.remove(key) and fresh.get(key) is None
    with open(path, "wb") as f:
        f.write(b"no database at all" * 100)
    broken = SQLiteCache(path, "v1")
    broken.put(key, [])
    assert broken.get(key) is None and not broken.remove(key)
    assert cache_key("a OR b", "x", 1, False, "v") != cache_key("a or b", "x", 1, False, "v")


def test_feedback_of_sessions(engine):
    one, other = engine.open_session(), engine.open_session()
    assert engine.feedback_of(one) == engine.feedback_of("unknown") == engine.feedback_of(None) == Feedback()
    assert engine.mark_relevant(one, 3) and engine.mark_relevant(one, 5)
    assert engine.feedback_of(one).marked == {3, 5} and all(b > 0 for b in engine.feedback_of(one).boosts.values()) and not engine.feedback_of(other).marked
    engine.reset_feedback(one)
    engine.reset_feedback("never seen")
    assert engine.feedback_of(one) == Feedback() and engine.close_session(one) and not engine.close_session(one)


def test_parts_can_be_replaced(index):
    kept, asked = {}, []

    def score(index, found, terms, mode, **options):
        asked.append(mode)
        return found.select("query_id", "doc_id", F.col("doc_id").cast("double").alias("score"))

    engine = SearchEngine(index, feedback=kept, score=score, rerank=lambda pool, docs, query, k, trade_off: pool.orderBy("doc_id").limit(k), make_result=lambda row: row["doc_id"])
    assert list(engine.search("learning OR networks")) == [5, 3, 1, 0] and list(engine.search("learning OR networks")) == [5, 3, 1, 0] and asked == ["bm25"]
    assert sorted(engine.search("learning OR networks", k=2, use_mmr=True)) == [0, 1]
    assert engine.open_session() in kept and engine.document_frequency("machine") == 2 and engine.document_frequency("none") == 0


def test_index_questions(index):
    assert index.has_term("machine") and not index.has_term("zebra") and index.has_document(4) and not index.has_document(77)
    listed = index.dump(5).collect()
    assert [(r.term, r.doc_id) for r in listed] == sorted((r.term, r.doc_id) for r in listed) and len(listed) == 5
    terms = query_terms(index, "machine")
    whole = {r.doc_id: r.score for r in ranking.score(index, index.doc_stats.selectExpr("0L query_id", "doc_id"), terms.selectExpr("0L query_id", "*")).collect()}
    for doc in (0, 1, 4, 77):
        assert ranking.score_document(index, doc, terms) == pytest.approx(whole.get(doc, 0.0))


def test_saved_index_is_built_once_for_the_same_files(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "red fox")], "doc_id long, text string").write.parquet(path)
    first = catalog.index_of(spark, path)
    assert catalog.index_of(spark, path).documents.inputFiles() == first.documents.inputFiles()
    spark.createDataFrame([(2, "blue fox")], "doc_id long, text string").write.mode("append").parquet(path)
    assert catalog.index_of(spark, path).stats.first().total_docs == 2


def test_measurement(spark, index, tmp_path):
    make = lambda path: SearchEngine(index, cache_path=path)
    m = measure.Measurement(make, [("machine learning", {0, 1}), ("pasta", {4})], repeats=1, sessions=2, k=5)
    rows = m.run(("bm25", "tfidf"))
    assert [r["mode"] for r in rows] == ["bm25", "tfidf"]
    for r in rows:
        assert r["mrr"] == 1 and r["map"] == 1 and r["recall_at_5"] == 1 and r["restart_from_disk"] == 2 and r["together_inconsistent"] == 0 and r["together_requests"] == 4 and r["hit_mean"] < r["miss_mean"]
    measure.save_report(rows, f"{tmp_path}/r.json", f"{tmp_path}/r.txt")
    with open(f"{tmp_path}/r.json", encoding="utf-8") as f:
        assert json.load(f) == rows
    with open(f"{tmp_path}/r.txt", encoding="utf-8") as f:
        assert f.read().startswith("mode")
    asked = spark.createDataFrame([(0, "machine learning"), (1, "pasta"), (2, "zebra")], "query_id long, query string")
    judged = spark.createDataFrame([(0, 0), (0, 1), (1, 4), (2, 4)], "query_id long, doc_id long")
    means = {r["mode"]: r for r in measure.compare_modes(index, asked, judged).collect()}
    assert set(means) == {"tfidf", "bm25", "vector"} and all(r.mrr == 1 for r in means.values())
    assert measure.best_against_sort(spark, 1000, 5, 1)["k"] == 5


def test_simple_grammar(spark):
    docs = spark.createDataFrame([(1, "red fox", "old"), (2, "red dog", ""), (3, "the cat", "foxes"), (4, None, None)], "doc_id long, text string, title string")
    terms = simple.simple_terms(docs)
    found = lambda q: sorted(r.doc_id for r in simple.simple_matches(terms, q).collect())
    assert found("red") == [1, 2] and found("red and fox") == [1] and found("red not fox") == [2] and found("dog cat") == [2, 3] and found("fox*") == [1, 3] and found("NOT red") == [1, 2]
    assert found("red and the fox") == [1] and found("cat red") == [1, 2, 3] and found("the of") == [] == found("*") and found("old") == [1]
    rows, df = simple.simple_candidates(terms, "red fox*")
    assert {(r.doc_id, r.term, r.tf) for r in rows.collect()} == {(1, "red", 1), (1, "fox", 1), (2, "red", 1), (3, None, None)} and {(r.term, r.df) for r in df.collect()} == {("red", 2), ("fox", 1)}
    assert [r.doc_id for r in simple.simple_candidates(terms, "the of")[0].collect()] == [1, 2, 3]


def test_sql_functions(spark):
    register_functions(spark)
    for word in ("was", "children", "stories", "running", "hopped", "boxes", "dogs", "glass", "thing*", "sing", "ab"):
        assert spark.sql(f"SELECT tarn_lemma('{word}')").first()[0] == lemma_of(word), word
    one = spark.range(1)
    cols = [F.lit(float(v)) for v in (3, 7, 100, 40, 55)]
    want = one.select(ranking.bm25(cols[0], cols[1], cols[2], cols[3], cols[4]), ranking.tfidf(*cols[:3])).first()
    got = spark.sql("SELECT tarn_bm25(3, 7, 100, 40, 55), tarn_tfidf(3, 7, 100), tarn_tokens('The Red*fox'), tarn_is_stopword('THE')").first()
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1]) and got[2] == ["the", "red*fox"] and got[3]


def test_checked_backends(spark, monkeypatch):
    docs = spark.createDataFrame([("5", "a", None)], "doc_id string, text string, title string")
    assert corpus.checked(docs).collect() == [Row(doc_id=5, title="", url="", text="a")]
    for bad in (None, docs.drop("text"), docs.withColumn("text", F.array("text"))):
        with pytest.raises(corpus.BackendError):
            corpus.checked(bad)
    with pytest.raises(corpus.BackendError):
        corpus.corpus_from(spark, backend="no_such_module_here")


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
