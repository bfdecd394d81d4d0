import pytest
from pyspark.sql import functions as F
from tarn.functions import text as T
from tarn.functions.html import parse_page
from tarn.functions.urls import allowed_host, host_of, normalise_url

LEMMAS = {
    "running": "run", "runs": "run", "ran": "run", "run": "run", "children": "child", "child": "child", "better": "good", "best": "good", "mice": "mouse",
    "searching": "search", "searched": "search", "searches": "search", "studies": "study", "classes": "class", "houses": "hous", "seeing": "se", "falling": "fal",
    "speed": "spe", "this": "thi", "string": "str", "status": "statu", "databases": "databas", "buildings": "building", "a": "a", "ss": "ss", "glass": "glass", "run*s": "run*s",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lemmas(spark):
    rows = spark.createDataFrame(list(LEMMAS.items()), "w string, want string").select("w", "want", T.lemma(F.col("w")).alias("got"), T.lemma_once(F.col("w")).alias("once")).collect()
    assert all(r.got == r.want == r.once == T.lemma_of(r.w) for r in rows)


def test_analysers(spark):
    text = "The state-of-the-art Multi_threading* in 3.14, für Büro."
    assert one(spark, T.index_tokens(F.lit(text))) == ["the", "state", "of", "the", "art", "multi_threading*", "in", "3", "14", "f", "r", "b", "ro"]
    assert one(spark, T.process_text(F.lit("The cats are running"))) == ["cat", "run"]
    assert one(spark, T.score_terms(F.lit('"Machine, Learning!" AND data'))) == ["machine", "learning", "data"] == T.score_terms_of('"Machine, Learning!" AND data')
    assert one(spark, T.crawl_segments(F.lit("state-of-the-art multi-threading\x00the of\x001984 2001 2026 42"))) == [["state", "art", "multi", "threading"], ["1984", "2001", "2026", "42"]]


def snippet(text, terms, width=200):
    flat = " ".join(text.split())
    hits = [p for p in (flat.lower().find(t) for t in terms) if p >= 0]
    if len(flat) <= width:
        return flat
    if not hits:
        return flat[:width].rstrip() + "..."
    end = min(len(flat), max(0, min(hits) - width // 4) + width)
    start = max(0, end - width)
    return ("..." if start else "") + flat[start:end].strip() + ("..." if end < len(flat) else "")


@pytest.mark.parametrize("terms", [["needle"], ["zzz"], [], ["word", "needle"], ["Ä"]])
@pytest.mark.parametrize("text", ["", "short needle", "word " * 100 + "needle " + "tail " * 90, "x" * 500, "needle " + "word " * 80, "word " * 80 + " needle"])
def test_snippets(spark, text, terms):
    assert one(spark, T.snippet(F.lit(text), terms)) == snippet(text, terms)


def test_highlight(spark):
    assert one(spark, T.highlight(F.lit("cat concat Cat caté"), ["cat"], "[", "]")) == "[cat] concat [Cat] caté"
    assert one(spark, T.highlight(F.lit("new york city"), ["new", "new york"], "<$1>", "")) == "<$1>new york city"
    assert one(spark, T.highlight(F.lit("x"), [])) == "x"


def test_titles_and_control_characters(spark):
    assert one(spark, T.clean_control(F.lit("a\x01b\tc"))) == "a b\tc"
    assert one(spark, T.display_title(F.lit(" "), F.lit("http://h.org/x"))) == "h.org" and one(spark, T.display_title(F.lit(""), F.lit(""))) == "(untitled)"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://example.com:80/path#section", "http://example.com/path"), ("https://example.com//", "https://example.com/"), ("HTTPS://EXAMPLE.com:443", "https://example.com/"),
        ("http://example.com:443/a/", "http://example.com:443/a"), ("ftp://example.com", None), ("", None), (None, None), ("not a url", None), (" http://a.b/c?q=1#f ", "http://a.b/c?q=1"), ("http://a.b?x", "http://a.b/?x"),
    ],
)
def test_urls(spark, url, want):
    assert one(spark, normalise_url(F.lit(url).cast("string"))) == want


def test_hosts(spark):
    assert one(spark, host_of(F.lit("http://a.b:8080/c"))) == "a.b:8080"
    assert one(spark, allowed_host(F.lit("http://a.b/c"), ["A.B"])) and not one(spark, allowed_host(F.lit("http://x.b/c"), ["a.b"]))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div>Contact</div><div>Support SEP</div>", "Contact\x00Support SEP"), ("<p>Contact <b>Support</b> here</p>", "Contact Support here"), ("<h1>A</h1><p>b</p>", "A\x00b"),
        ("<ul><li>a</li><li>b</li></ul>", "a\x00b"), ("<tr><td>a</td><td>b</td></tr>", "a\x00b"), ("a<script>x</script> b<style>y</style><noscript>z</noscript>", "a b"), ("a<br>b<br/>c", "a\x00b\x00c"), ("&amp; &lt;x&gt;", "& <x>"),
        ("<html><head><title>T</title><body>b", "b"),
    ],
)
def test_visible_text(html, text):
    assert parse_page(html, "http://a.b/")[1] == text


def test_page_parts():
    page = "<html><head><title> A \n title </title></head><body><a href='/x'>x</a><a href=''>e</a><a>n</a><a href='http://c.d/#f'>y</a></body></html>"
    assert parse_page(page, "http://a.b/dir/") == ("A title", "xeny", ["http://a.b/x", "http://c.d/#f"])
    assert parse_page(None, "x") == ("", "", []) and parse_page("", None) == ("", "", [])


def plain_snippet(text, terms, width=180):
    """The rule of the terminal's snippets, character by character."""
    if len(text) <= width:
        return text
    places = [p for p in (text.lower().find(t) for t in terms) if p >= 0]
    start = max(0, min(places, default=0) - 80)
    if start > 0 and 0 <= (space := text.find(" ", start)) < start + 20:
        start = space + 1
    end = min(len(text), start + width)
    if end < len(text) and (space := text.rfind(" ", 0, end + 1)) > end - 20:
        end = space
    return ("…" if start else "") + text[start:end] + ("…" if end < len(text) else "")


def test_relevant_snippet(spark):
    import random

    rnd = random.Random(2)
    texts = ["", "short", "x" * 400] + ["".join(rnd.choices(["ab", "cde", " ", "  ", "fox", "longerword" * 3], k=rnd.randrange(20, 200))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for terms in (["fox"], ["zzz", "cde"], ["none"], []):
        got = {r.i: r.s for r in rows.select("i", T.relevant_snippet(F.col("text"), terms).alias("s")).collect()}
        assert all(got[i] == plain_snippet(t, terms) for i, t in enumerate(texts)), terms


def test_wrapped_and_now(spark):
    assert T.wrapped("") == "" and T.wrapped("a b", 80) == "a b"
    text = "word " * 60
    lines = T.wrapped(text.strip(), 40).split("\n")
    assert all(len(x) <= 40 for x in lines) and " ".join(x.strip() for x in lines).split() == text.split() and T.wrapped("x" * 100, 40).split("\n") == ["x" * 40, "x" * 40, "x" * 20]
    assert __import__("re").fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", spark.range(1).select(T.now_iso()).first()[0])
