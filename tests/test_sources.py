import io
import json

import pytest
from pyspark.sql import functions as F
from tarn import cli
from tarn.operators import crawl as C
from tarn.operators.index import Index, build_index, keep_first
from tarn.plans.engine import SearchEngine
from tarn.sources import corpus as S
from tarn.streaming import ingest

DOC = {"doc_id": "000001", "url": "http://a/", "title": "T", "text": "x\x01 y", "tokens": ["x"], "token_segments": [["x"]], "meta": {"crawled_at": "2026-09-10T00:00:00Z", "content_length": "12", "status": "ok", "depth": 1}}


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("layout", ["lines", "array", "objects"])
def test_layouts(spark, tmp_path, layout):
    docs = [DOC, {"doc_id": 2, "text": "no title"}, {"doc_id": "-1", "text": "left out"}, {"doc_id": "junk", "text": "left out"}, {"doc_id": 1, "text": "zz later"}]
    text = {"lines": "\n".join(map(json.dumps, docs)), "array": json.dumps(docs), "objects": "\n".join(json.dumps(d, indent=1) for d in docs)}[layout]
    got = {r.doc_id: r for r in S.read_documents(spark, write(tmp_path / "c.json", text), layout).collect()}
    assert set(got) == {1, 2} and got[1].text == "x  y" and got[1].meta.content_length == 12 and got[1].meta.depth == 1 and got[2].title == "" and got[2].tokens == []
    with pytest.raises(ValueError):
        S.read_documents(spark, "x", "odd")


def test_records_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "u", "t", 'a "q"\x00b   ü', ["a"])], "doc_id long, url string, title string, text string, tokens array<string>")
    S.write_documents(docs, f"{tmp_path}/out")
    S.write_documents(docs.withColumn("doc_id", F.lit(1234567).cast("long")), f"{tmp_path}/out")
    got = {r.doc_id: r.text for r in S.read_documents(spark, f"{tmp_path}/out").collect()}
    assert got == {1: 'a "q" b   ü', 1234567: 'a "q" b   ü'}
    assert '"doc_id":"000001"' in S.to_records(docs).first().value


def test_small_files(spark, tmp_path):
    assert [r.url for r in S.load_seeds(spark, write(tmp_path / "s.txt", "# all\nhttp://a/ # b\n\n http://c/\n")).collect()] == ["http://a/", "http://c/"]
    simple = [{"id": 3, "title": "t", "url": "u", "text": "x"}, {"id": 4, "text": "y"}]
    for k, body in enumerate((simple, {"documents": simple})):
        assert [tuple(r) for r in S.read_simple_corpus(spark, write(tmp_path / f"d{k}.json", json.dumps(body))).collect()] == [(3, "t", "u", "x"), (4, "", "", "y")]
    queries = S.load_queries(spark, write(tmp_path / "q.json", json.dumps({"queries": [{"query": "A b", "relevant_docs": [1]}]})))
    assert S.query_by_text(queries, " a B ").count() == 1
    assert json.loads(S.result_json(spark.createDataFrame([(1, 1 / 3)], "doc_id long, score double")).first().value) == {"doc_id": 1, "score": 0.333333}


def test_synthetic_corpus_can_be_searched(spark):
    docs, queries = S.synthetic_corpus(spark)
    again, _ = S.synthetic_corpus(spark)
    assert docs.count() == 240 and queries.count() == 40 and docs.collect() == again.collect()
    q = queries.first()
    found = SearchEngine(build_index(docs)).search(" OR ".join(q.query.split()), k=6)
    assert len({r["doc_id"] for r in found} & set(q.relevant_docs)) >= 5


def test_backends(spark, monkeypatch):
    assert S.load_backend("math:pi") > 3 and S.corpus_from(spark).count() == 240
    monkeypatch.setenv("TARN_BACKEND", "json:dumps")
    with pytest.raises(TypeError):
        S.corpus_from(spark)
    with pytest.raises(AttributeError):
        S.load_backend("math")


def test_keep_first(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    assert sorted(map(tuple, keep_first(rows, F.col("text")).collect())) == [(1, "a"), (2, "c")]


WEB = {
    "http://a.b/1": "<title>One</title><p>first page</p><a href='/2'>x</a><a href='/3#f'>y</a><a href='/4'>z</a>", "http://a.b/2": "<p>two</p><a href='/3'>x</a><a href='/5'>y</a><a href='http://other.c/'>o</a>",
    "http://a.b/3": "<p>three</p><a href='/1'>back</a><a href='/6'>n</a>", "http://a.b/5": "<p>five</p>", "http://a.b/6": "<p>six</p>", "http://other.c/": "<p>away</p>",
}


def plain_crawl(seeds, max_pages, max_depth, max_links, hosts=None):
    import re
    from urllib.parse import urldefrag, urljoin, urlsplit

    queue, seen, out = list(seeds), dict.fromkeys(seeds, 0), []
    while queue and len(out) < max_pages:
        url = queue.pop(0)
        if url not in WEB:
            continue
        out.append((url, seen[url]))
        if max_depth is not None and seen[url] >= max_depth:
            continue
        added = 0
        for href in re.findall("href='([^']+)'", WEB[url]):
            if max_links is not None and added >= max_links:
                break
            to = urldefrag(urljoin(url, href))[0]
            if to not in seen and (hosts is None or urlsplit(to).netloc in hosts):
                seen[to], added = seen[url] + 1, added + 1
                queue.append(to)
    return out


@pytest.mark.parametrize(("max_pages", "max_depth", "max_links", "hosts"), [(9, None, None, None), (9, None, 1, None), (3, None, None, None), (9, 1, None, None), (9, None, 2, ["a.b"]), (9, 0, None, None)])
def test_crawl_order(spark, max_pages, max_depth, max_links, hosts):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(WEB.items())], "page_id long, url string, html string")
    got = sorted(C.crawl(pages, ["http://A.b:80/1/"], max_pages, max_depth, max_links, hosts).collect(), key=lambda r: r.doc_id)
    assert [(r.url, r.depth) for r in got] == plain_crawl(["http://a.b/1"], max_pages, max_depth, max_links, hosts)
    assert [r.doc_id for r in got] == [f"{k + 1:06d}" for k in range(len(got))] and got[0].title == "One"


def test_links_and_fetch(spark):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(WEB.items())], "page_id long, url string, html string")
    assert ("http://a.b/1", "http://a.b/3", 1) in {tuple(r) for r in C.link_graph(pages).collect()}
    asked = []

    class Answer(io.BytesIO):
        pass

    def opener(request, timeout):
        asked.append(request.full_url)
        if request.full_url.endswith("robots.txt"):
            return Answer(b"User-agent: *\nDisallow: /no")
        if request.full_url.endswith("/bad"):
            raise OSError("down")
        return Answer(b"<p>ok</p>")

    urls = spark.createDataFrame([("http://h/a",), ("http://h/no/b",), ("http://h/bad",)], "url string")
    got = {r.url: r.html for r in C.fetch(urls, wait=0.0, opener=opener, sleep=lambda s: None).collect()}
    assert got == {"http://h/a": "<p>ok</p>", "http://h/no/b": None, "http://h/bad": None} and C.is_retriable(503) and not C.is_retriable(404)


def test_streamed_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, mark = f"{tmp_path}/index", f"{tmp_path}/mark"
    for k, text in enumerate(("red fox", "red dog")):
        write(tmp_path / "in" / f"{k}.json", json.dumps({"doc_id": k + 1, "text": text}))
        ingest.index_stream(ingest.stream_documents(spark, f"{tmp_path}/in"), path, mark).awaitTermination()
    assert {r.term: r.df for r in ingest.streamed_vocab(spark, path).collect()} == {"red": 2, "fox": 1, "dog": 1}


def test_event_windows(spark):
    rows = spark.createDataFrame([("2026-01-01 00:01:00", "a", 1.0), ("2026-01-01 00:09:00", "a", 2.0), ("2026-01-01 00:11:00", "a", 4.0)], "ts string, event_type string, value double")
    got = ingest.event_counts(rows.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy("window_start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0), (1, 4.0)]


def test_prompt(spark):
    engine = SearchEngine(build_index(spark.createDataFrame([(1, "red fox"), (2, "red dog")], "doc_id long, text string")))
    state, out = {"mode": "bm25", "k": 10, "mmr": False, "session": "s"}, io.StringIO()
    for line in (":mode tfidf", ":k 1", ":mmr on", ":rel 1", ":stats", ":reset", ":mode x", ":help", ":k z"):
        assert cli.command(engine, state, line, out)
    assert state["mode"] == "tfidf" and state["k"] == 1 and state["mmr"] and not cli.command(engine, state, ":quit", out)
    cli.show(engine.search("fox"), ["fox"], out)
    cli.show(engine.search("zebra"), ["zebra"], out)
    assert "\033[1;33mfox\033[0m" in out.getvalue() and "no results" in out.getvalue() and "noted" in out.getvalue()
    assert cli.main(["-q", "x", "--mode", "zz"]) == 2


def test_index_type(spark):
    assert isinstance(build_index(spark.createDataFrame([(1, "x")], "doc_id long, text string")), Index)


def test_crawl_command(spark, tmp_path):
    from tarn import crawl_cli

    (tmp_path / "seeds.txt").write_text("# start\nhttp://a.b/1\n")
    (tmp_path / "none.txt").write_text("# nothing\n")
    pages = spark.createDataFrame([(1, "http://a.b/1", '<title>One</title><body><a href="/2">two</a> red fox</body>'), (2, "http://a.b/2", "<title>Two</title><body>blue</body>")], "page_id long, url string, html string")
    run = lambda *more: crawl_cli.main(["--seeds", f"{tmp_path}/seeds.txt", "--corpus", f"{tmp_path}/corpus", "--log", f"{tmp_path}/log", *more], C.from_table(pages))
    assert run() == 0 and run("--clear-corpus", "--max-depth", "0") == 0 and crawl_cli.main(["--seeds", f"{tmp_path}/none.txt", "--corpus", "x"]) == 1
    docs = S.read_documents(spark, f"{tmp_path}/corpus").collect()
    assert [(d.doc_id, d.title, d.url, d.meta.depth) for d in docs] == [(1, "One", "http://a.b/1", 0)] and "fox" in docs[0].text


def test_reachable_pages(spark):
    html = lambda *links: "<body>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body>"
    pages = spark.createDataFrame([(1, "http://a.b/1", html("/2", "/3")), (2, "http://a.b/2", html("/1", "/4")), (3, "http://a.b/3", html("/4")), (4, "http://a.b/4", html("/5", "/gone")), (5, "http://a.b/5", None), (6, "http://c.d/", html())], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://a.b/1",), ("http://no.where/",)], "url string")
    assert {(r.url, r.depth) for r in C.reachable(pages, seeds).collect()} == {("http://a.b/1", 0), ("http://a.b/2", 1), ("http://a.b/3", 1), ("http://a.b/4", 2)}
    assert {r.url for r in C.reachable(pages, seeds, max_depth=1).collect()} == {f"http://a.b/{k}" for k in (1, 2, 3)}
    assert C.reachable(pages, seeds.where("false")).collect() == []
