import math
import random
from collections import Counter

import pytest
from tarn.plans import registry

WORDS = "kato milu bora zuni felo gari hopu jaki lomo nupa piro quta rovo sami tuva wilo".split()


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Queries of 14 words, the first six of which no document has."""
    rnd, folder = random.Random(4), str(tmp_path_factory.mktemp("whole"))
    docs = [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(5, 40)))) for i in range(40)]
    asked = [(i, "xa xo xu xi xe xy " + " ".join(rnd.choices(WORDS, k=8))) for i in range(5)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(40 + i, 1, 0) for i in range(5)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", asked, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, asked


def brute(docs, asked, mode):
    tfs = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tfs.values() for w in c)
    n, avg = len(docs), sum(sum(c.values()) for c in tfs.values()) / len(docs)
    top = {}
    for q, text in asked:
        scores = {}
        for i, c in tfs.items():
            parts = [(c[w], df[w], k) for w, k in Counter(text.split()).items() if c[w]]
            if parts and mode == "tfidf":
                scores[i] = sum(k * tf * max(0, math.log10(n / d)) for tf, d, k in parts)
            elif parts:
                scores[i] = sum(k * max(0, math.log10((n - d + 0.5) / (d + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for tf, d, k in parts)
        top[q] = sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
    return top


@pytest.mark.parametrize("mode", ["bm25", "tfidf"])
def test_whole_texts_are_ranked(spark, data, mode):
    folder, docs, asked = data
    want = brute(docs, asked, mode)
    got = registry.QUERIES[f"batch_{mode}_topk"](spark, folder).collect()
    assert len(got) == sum(map(len, want.values())) == 50
    for r in got:
        score, doc = want[r.query_id][r.rank - 1]
        assert r.doc_id == doc and r.score == pytest.approx(score, abs=2e-6)


def test_metrics_of_whole_texts(spark, data):
    folder, docs, asked = data
    top = brute(docs, asked, "bm25")
    relevant = {q: {i for i in range(45) if (i % 2 if i < 40 else 1) and i % 40 == q % 40} for q, _ in asked}
    rr, ap = {}, {}
    for q, found in top.items():
        at = [k for k, (_, i) in enumerate(found, 1) if i in relevant[q]]
        rr[q] = 1 / at[0] if at else 0.0
        ap[q] = sum(j / k for j, k in enumerate(at, 1)) / len(relevant[q]) if relevant[q] else 0.0
    got = {r.query_id: r for r in registry.QUERIES["rr_ap_per_query"](spark, folder).collect()}
    assert {q: (pytest.approx(rr[q], abs=2e-6), pytest.approx(ap[q], abs=2e-6)) for q in rr} == {q: (r.reciprocal_rank, r.average_precision) for q, r in got.items()}
    for r in registry.QUERIES["precision_recall_at_k"](spark, folder).collect():
        hits = sum(i in relevant[r.query_id] for _, i in top[r.query_id])
        assert r.precision_at_10 == pytest.approx(hits / 10) and r.recall_at_10 == pytest.approx(hits / len(relevant[r.query_id]) if relevant[r.query_id] else 0.0)
    means = {r["mode"]: r for r in registry.QUERIES["metrics_by_mode"](spark, folder).collect()}
    assert means["bm25"].mrr == pytest.approx(sum(rr.values()) / 5, abs=2e-6) and set(means) == {"bm25", "tfidf"}
