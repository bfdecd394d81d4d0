"""Registered queries of the search engine, each with a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions import urls as U
from tarn.functions.words import BLOCK_TAGS, CRAWL_STOPWORDS, INDEX_STOPWORDS, IRREGULAR, ROCCHIO, SECTION_BREAK, SIMPLE_STOPWORDS
from tarn.operators import crawl as C
from tarn.operators import evaluate as E
from tarn.operators import feedback as B
from tarn.operators import index as X
from tarn.operators import postings as P
from tarn.operators import query as Q
from tarn.operators import ranking as R
from tarn.operators.diversify import mmr_rerank
from tarn.operators.simple import simple_matches, simple_terms
from tarn.plans.catalog import index_of
from tarn.sources import corpus as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The words, phrases and patterns that the queries ask for.
RANKED, TERMS = "th er nd", ("er", "nd", "th")
BOOLEAN = {
    "bool_term": ("th", "th"),
    "bool_and": ("th AND nd", "th AND nd"),
    "bool_or": ("sch OR que", "sch OR que"),
    "bool_not": ("NOT th", "NOT th"),
    "bool_and_not": ("th AND NOT er", "th AND NOT er"),
    "bool_nested": ("(th OR sch) AND NOT (nd OR ung)", "(th OR sch) AND NOT (nd OR ung)"),
    "implicit_and": ("th er nd", "th AND er AND nd"),
}
PHRASES = {"phrase2": ("nd", "the"), "phrase3": ("the", "nd", "of")}
PATTERNS = {"prefix": ("thing*", "thing%"), "suffix": ("*heit", "%heit"), "prefix_suffix": ("th*ing", "th%ing"), "infix": ("*keit*", "%keit%"), "glob_multi": ("e*ng*en", "e%ng%en")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spread(table(spark, sf_dir, "documents"))


def index(spark: SparkSession, sf_dir: str) -> X.Index:
    """The saved index of all documents; built on the first call for these files."""
    return index_of(spark, f"{sf_dir}/documents.parquet")


def registered(sql: str | None = None, name: str | None = None, recursive: bool = False):
    """Registers a query, with the SQL of its twin after the shared tables."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            whole = (PRELUDE + sql) if "WITH" not in sql[:12] else sql
            ORACLES[key] = whole.replace("WITH docs", "WITH RECURSIVE docs", 1) if recursive else whole
        return f

    return keep


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def lemma_sql(w: str) -> str:
    irregular = " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    undouble = lambda s: f"CASE WHEN length({s}) > 2 AND {s}[-1] = {s}[-2] THEN {s}[:-2] ELSE {s} END"
    return (
        f"CASE WHEN contains({w}, '*') THEN {w} {irregular} WHEN length({w}) > 5 AND {w} LIKE '%ies' THEN {w}[:-4] || 'y' "
        f"WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN {undouble(f'{w}[:-4]')} WHEN length({w}) > 4 AND {w} LIKE '%ed' THEN {undouble(f'{w}[:-3]')} "
        f"WHEN length({w}) > 4 AND {w} LIKE '%es' THEN {w}[:-3] WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE {w} END"
    )


PRELUDE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_*]+'))) AS w FROM docs),
dt AS (SELECT doc_id, {lemma_sql('w')} AS term, count(*) AS tf FROM words WHERE w NOT IN ({_quoted(INDEX_STOPWORDS)}) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
lengths AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS doc_len FROM docs d LEFT JOIN dt USING (doc_id) GROUP BY d.doc_id),
stats AS (SELECT count(*) AS total, coalesce(avg(doc_len), 0) AS avgdl FROM lengths),
sentences AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]')) AS s, unnest(range(len(regexp_split_to_array(text, '[.!?]')))) AS i FROM docs),
counted AS (SELECT doc_id, i, regexp_extract_all(s, '[A-Za-z0-9_*]+') AS ws FROM sentences),
placed AS (SELECT doc_id, ws, coalesce(sum(len(ws) + (len(ws) > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM counted),
raw_occ AS (SELECT doc_id, start + unnest(range(len(ws))) AS pos, lower(unnest(ws)) AS w FROM placed),
occ AS (SELECT doc_id, pos, w AS surface, CASE WHEN w IN ({_quoted(INDEX_STOPWORDS)}) THEN w ELSE {lemma_sql('w')} END AS term FROM raw_occ)
"""

# --- analysers and index ---------------------------------------------------------------------------------------------


@registered(f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+'), lambda w: lower(w)), lambda w: w NOT IN ({_quoted(CRAWL_STOPWORDS)})) AS ws FROM documents)
SELECT doc_id, CAST(len(ws) AS INT) AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM t""")
def tokenize_a1(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", T.crawl_tokens(F.coalesce("text", F.lit(""))).alias("ws"))
    return tokens.select("doc_id", F.size("ws").alias("n_tokens"), F.md5(F.array_join("ws", " ")).alias("tokens_md5"))


@registered("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_*]+'), lambda w: lower(w)) AS ws FROM documents)
SELECT doc_id, CAST(len(ws) AS INT) AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM t""")
def tokenize_a2(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", T.index_tokens(F.coalesce("text", F.lit(""))).alias("ws"))
    return tokens.select("doc_id", F.size("ws").alias("n_tokens"), F.md5(F.array_join("ws", " ")).alias("tokens_md5"))


@registered("""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('and', 'or', 'not')) AS ws FROM benchmark)
SELECT item_id, CAST(len(ws) AS INT) AS n_terms, md5(array_to_string(ws, ' ')) AS terms_md5 FROM t""")
def tokenize_query(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select("item_id", T.score_terms(F.col("text")).alias("ws"))
    return terms.select("item_id", F.size("ws").alias("n_terms"), F.md5(F.array_join("ws", " ")).alias("terms_md5"))


@registered("SELECT DISTINCT surface, term AS lemma FROM occ WHERE surface NOT IN (" + _quoted(INDEX_STOPWORDS) + ")")
def lemma_vocab(spark, sf_dir):
    return index(spark, sf_dir).surfaces


@registered(f"SELECT doc_id, count(*) FILTER (w IN ({_quoted(INDEX_STOPWORDS)})) AS n_stop, count(*) FILTER (w NOT IN ({_quoted(INDEX_STOPWORDS)})) AS n_other FROM words GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    words = index(spark, sf_dir).occurrences
    return words.groupBy("doc_id").agg(F.count_if("is_stop").alias("n_stop"), F.count_if(~F.col("is_stop")).alias("n_other"))


@registered("SELECT doc_id, CAST(pos AS INT) AS pos, surface, term FROM occ")
def sentence_positions(spark, sf_dir):
    return index(spark, sf_dir).occurrences.select("doc_id", "pos", "surface", "term")


@registered("SELECT doc_id, term, CAST(tf AS INT) AS tf FROM dt")
def doc_terms(spark, sf_dir):
    return index(spark, sf_dir).doc_terms


@registered("SELECT term, df FROM vocab")
def doc_freq(spark, sf_dir):
    return index(spark, sf_dir).vocab


@registered("SELECT doc_id, CAST(doc_len AS BIGINT) AS doc_len FROM lengths")
def doc_stats(spark, sf_dir):
    return index(spark, sf_dir).doc_stats


@registered("SELECT total AS total_docs, round(avgdl, 6) AS avg_doc_length FROM stats")
def corpus_stats(spark, sf_dir):
    return index(spark, sf_dir).stats.select("total_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))


@registered(f"SELECT term, doc_id, CAST(count(*) AS INT) AS tf, array_to_string(list_sort(list(CAST(pos AS INT))), ',') AS positions FROM occ WHERE term IN ({_quoted(TERMS)}) GROUP BY term, doc_id")
def postings_topterms(spark, sf_dir):
    rows = index(spark, sf_dir).postings.where(F.col("term").isin(*TERMS))
    return rows.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


@registered("SELECT term, doc_id, CAST(count(*) AS INT) AS tf, md5(array_to_string(list_sort(list(CAST(pos AS INT))), ',')) AS positions_md5 FROM occ GROUP BY term, doc_id")
def postings_all(spark, sf_dir):
    """The posting lists of all terms, stop words included; positions as a digest."""
    return index(spark, sf_dir).postings.select("term", "doc_id", "tf", F.md5(F.array_join("positions", ",")).alias("positions_md5"))


# --- Boolean, phrase and wildcard queries ----------------------------------------------------------------------------


def _boolean(name: str, query: str, condition: str) -> None:
    import re

    words = sorted(set(re.findall("[a-z]+", condition)))
    flags = ", ".join(f"coalesce(bool_or(term = '{w}'), false) AS {w}" for w in words)
    registered(f", flags AS (SELECT d.doc_id, {flags} FROM docs d LEFT JOIN dt USING (doc_id) GROUP BY d.doc_id) SELECT doc_id FROM flags WHERE {condition}", name)(
        lambda spark, sf_dir: Q.matching_documents(index(spark, sf_dir), query)
    )


for _name, (_query, _condition) in BOOLEAN.items():
    _boolean(_name, _query, _condition)


def _phrase(name: str, words: tuple[str, ...]) -> None:
    joins = " ".join(f"JOIN occ o{k} ON o{k}.doc_id = o0.doc_id AND o{k}.pos = o0.pos + {k} AND o{k}.term = '{w}'" for k, w in enumerate(words) if k)
    registered(f"SELECT DISTINCT o0.doc_id FROM occ o0 {joins} WHERE o0.term = '{words[0]}'", name)(lambda spark, sf_dir: Q.matching_documents(index(spark, sf_dir), f'"{" ".join(words)}"'))


for _name, _words in PHRASES.items():
    _phrase(_name, _words)


def _expansion_sql(like: str, length: int) -> str:
    fits = f"regexp_matches(%s, '^[a-z]+$') AND %s LIKE '{like}' AND length(%s) >= {length}"
    stop = _quoted(INDEX_STOPWORDS)
    return f", expanded AS (SELECT term FROM occ WHERE surface NOT IN ({stop}) AND {fits.replace('%s', 'surface')} UNION SELECT {lemma_sql('term')} FROM vocab WHERE {fits.replace('%s', 'term')})"


@registered(_expansion_sql("th%", 2) + "SELECT DISTINCT a.doc_id FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'the' AND b.term IN (SELECT term FROM expanded JOIN vocab USING (term))")
def phrase_wildcard(spark, sf_dir):
    return Q.matching_documents(index(spark, sf_dir), '"the th*"')


def _pattern(name: str, pattern: str, like: str) -> None:
    sql = _expansion_sql(like, len(pattern.replace("*", "")))
    registered(sql + "SELECT term, df FROM vocab WHERE term IN (SELECT term FROM expanded)", name)(lambda spark, sf_dir: (lambda x: x.vocab.join(Q.expand(x, pattern), "term", "left_semi"))(index(spark, sf_dir)))


for _name, (_pattern_text, _like) in PATTERNS.items():
    _pattern(_name, _pattern_text, _like)


def _lists(spark, sf_dir):
    x = index(spark, sf_dir)
    one = lambda term: x.doc_terms.where(F.col("term") == term).select("doc_id", "tf")
    return one("th"), one("nd")


_AB = ", a AS (SELECT doc_id, CAST(tf AS INT) AS tf FROM dt WHERE term = 'th'), b AS (SELECT doc_id, CAST(tf AS INT) AS tf FROM dt WHERE term = 'nd') "


@registered(_AB + "SELECT * FROM a WHERE doc_id IN (SELECT doc_id FROM b)")
def postings_intersect(spark, sf_dir):
    return P.intersect(*_lists(spark, sf_dir))


@registered(_AB + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def postings_union(spark, sf_dir):
    return P.union(*_lists(spark, sf_dir))


@registered(_AB + "SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def postings_difference(spark, sf_dir):
    return P.difference(*_lists(spark, sf_dir))


@registered(", first AS (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 10) SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id, CAST(0 AS DOUBLE) AS score FROM first")
def stopword_only(spark, sf_dir):
    from tarn.plans.engine import SearchEngine

    return SearchEngine(index(spark, sf_dir), cache_capacity=0).plan("the of and").select(F.col("rank").cast("long").alias("rank"), "doc_id", "score")


# --- ranking ---------------------------------------------------------------------------------------------------------


def _single(spark, sf_dir, mode, query=RANKED):
    """Scores of a query's candidates, rounded, so that copies tie whatever the order of summation."""
    x = index(spark, sf_dir)
    one = lambda df: df.select(F.lit(0).cast("long").alias("query_id"), "*")
    scores = R.score(x, one(Q.matching_documents(x, query)), one(Q.query_terms(x, query)), mode)
    return R.top_k_per_query(scores.withColumn("score", F.round("score", 6)), 10).select("rank", "doc_id", "score")


_MATCH = f", terms AS (SELECT term, df, 1 AS qtf FROM vocab WHERE term IN ({_quoted(TERMS)})), cand AS (SELECT doc_id FROM dt WHERE term IN ({_quoted(TERMS)}) GROUP BY doc_id HAVING count(*) = 3)"
_TOP = ", ranked AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored) SELECT CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10"
_BM25 = "greatest(0, log10((total - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl))"


def _scored(value: str) -> str:
    return _MATCH + f", scored AS (SELECT doc_id, round(sum({value}), 6) AS score FROM cand JOIN dt USING (doc_id) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY doc_id)" + _TOP


@registered(_scored("tf * greatest(0, log10(total / df))"))
def tfidf_topk(spark, sf_dir):
    return _single(spark, sf_dir, "tfidf")


@registered(_scored(_BM25))
def bm25_topk(spark, sf_dir):
    return _single(spark, sf_dir, "bm25")


@registered(_scored("ln(1 + (total - df + 0.5) / (df + 0.5)) * tf"))
def idf_sum_topk(spark, sf_dir):
    return _single(spark, sf_dir, "idf_sum")


_VECTORS = """, local AS (SELECT term, count(*) AS n FROM dt JOIN cand USING (doc_id) GROUP BY term),
known AS (SELECT l.term, coalesce(t.df, l.n) AS df FROM local l LEFT JOIN terms t USING (term)),
vec AS (SELECT doc_id, term, tf * greatest(0, log10(total / df)) AS w FROM dt JOIN cand USING (doc_id) JOIN known USING (term), stats),
qvec AS (SELECT term, greatest(0, log10(total / df)) AS q FROM terms, stats),
scored AS (SELECT doc_id, round(least(1, coalesce(sum(w * q) / nullif(sqrt(sum(w * w)) * (SELECT sqrt(sum(q * q)) FROM qvec), 0), 0)), 6) AS score FROM vec LEFT JOIN qvec USING (term) GROUP BY doc_id)"""


@registered(_MATCH + _VECTORS + _TOP)
def vector_topk(spark, sf_dir):
    return _single(spark, sf_dir, "vector")


@registered(_MATCH + "SELECT term, count(*) AS local_df FROM dt JOIN cand USING (doc_id) GROUP BY term")
def candidate_df(spark, sf_dir):
    x = index(spark, sf_dir)
    found = Q.matching_documents(x, RANKED)
    return x.doc_terms.join(found, "doc_id").groupBy("term").agg(F.count("*").alias("local_df"))


_ASKED = """, asked AS (SELECT item_id AS query_id, text AS q FROM benchmark),
qwords AS (SELECT query_id, lower(unnest(regexp_extract_all(q, '[A-Za-z0-9_*]+'))) AS w FROM asked),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, LEMMA AS term FROM qwords WHERE w NOT IN (STOP)) GROUP BY ALL),
found AS (SELECT DISTINCT query_id, doc_id FROM qterms JOIN dt USING (term)),
sums AS (SELECT query_id, doc_id, round(sum(VALUE * qtf), 6) AS score FROM qterms JOIN dt USING (term) JOIN vocab USING (term) JOIN lengths USING (doc_id), stats GROUP BY ALL),
best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sums),
top AS (SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM best WHERE rank <= 10)
""".replace("LEMMA", lemma_sql("w")).replace("STOP", _quoted(INDEX_STOPWORDS))


def _asked(spark, sf_dir):
    """The benchmark's whole texts as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _batch(spark, sf_dir, mode="bm25"):
    x = index(spark, sf_dir)
    terms = R.batch_terms(x, _asked(spark, sf_dir))
    found = x.doc_terms.join(terms.select("query_id", "term"), "term").select("query_id", "doc_id").distinct()
    return R.top_k_per_query(R.score(x, found, terms, mode).withColumn("score", F.round("score", 6)), 10)


@registered(_ASKED.replace("VALUE", _BM25) + "SELECT * FROM top")
def batch_bm25_topk(spark, sf_dir):
    return _batch(spark, sf_dir)


@registered(_ASKED.replace("VALUE", "tf * greatest(0, log10(total / df))") + "SELECT * FROM top")
def batch_tfidf_topk(spark, sf_dir):
    return _batch(spark, sf_dir, "tfidf")


#: Greedy choice from the best 20 by BM25, by recursion over the chosen ones.
_MMR = (
    f""", bm AS (SELECT doc_id, round(sum({_BM25}), 6) AS score FROM cand JOIN dt USING (doc_id) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY doc_id),
pool AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pool_rank FROM bm QUALIFY pool_rank <= 20),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM vec JOIN pool USING (doc_id) GROUP BY doc_id),
unit AS (SELECT doc_id, term, w / n AS w FROM vec JOIN norms USING (doc_id) WHERE w <> 0),
q_norm AS (SELECT sqrt(sum(q * q)) AS n FROM qvec),
rel AS (SELECT doc_id, round(least(1, sum(w * q / n)), 9) AS r FROM unit JOIN qvec USING (term), q_norm GROUP BY doc_id),
sims AS (SELECT a.doc_id AS a, b.doc_id AS b, round(least(1, sum(a.w * b.w)), 9) AS s FROM unit a JOIN unit b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
packed AS (SELECT (SELECT list({{'d': doc_id, 'r': coalesce(r, 0)}} ORDER BY pool_rank) FROM pool LEFT JOIN rel USING (doc_id)) AS items, (SELECT map(list(a || '-' || b), list(s)) FROM sims) AS near),
steps AS (SELECT 0 AS step, CAST([] AS BIGINT[]) AS chosen, CAST(0 AS DOUBLE) AS value
  UNION ALL SELECT step + 1, list_append(chosen, items[list_position(vals, list_max(vals))].d), list_max(vals) FROM (SELECT step, chosen, items, list_transform(items, lambda p: CASE WHEN list_contains(chosen, p.d) THEN -1e9
    ELSE 0.7 * p.r - (1 - 0.7) * coalesce(list_max(list_transform(chosen, lambda c: coalesce(near[p.d || '-' || c], 0))), 0) END) AS vals FROM steps, packed WHERE step < least(10, len(items))))
SELECT chosen[len(chosen)] AS doc_id, round(value, 6) AS mmr_score, step FROM steps WHERE step > 0"""
)


@registered((_MATCH + _VECTORS).partition(",\nscored AS")[0] + _MMR, recursive=True)
def mmr_rerank_pool(spark, sf_dir):
    x = index(spark, sf_dir)
    one = lambda df: df.select(F.lit(0).cast("long").alias("query_id"), "*")
    found, terms = one(Q.matching_documents(x, RANKED)), one(Q.query_terms(x, RANKED))
    pool = R.top_k_per_query(R.score(x, found, terms).withColumn("score", F.round("score", 6)), 20).withColumnRenamed("rank", "pool_rank")
    chosen = mmr_rerank(pool, R.document_vectors(x, found, terms), R.query_vectors(x, terms), 10)
    return chosen.select("doc_id", F.round("mmr_score", 6).alias("mmr_score"), "step")


#: A query of the stand-in grammar.
SIMPLE = "th nd NOT er OR ing* AND the"


@registered(f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents),
flags AS (SELECT doc_id, bool_or(w = 'th') AS th, bool_or(w = 'nd') AS nd, bool_or(w = 'er') AS er, bool_or(w LIKE 'ing%') AS ing FROM words WHERE w NOT IN ({_quoted(SIMPLE_STOPWORDS)}) GROUP BY doc_id)
SELECT doc_id FROM flags WHERE ((th OR nd) AND NOT er) OR ing""")
def simple_grammar(spark, sf_dir):
    """``the`` is a stop word, and with it goes its AND."""
    return simple_matches(simple_terms(table(spark, sf_dir, "documents").select("doc_id", "text")), SIMPLE)


# --- text helpers ----------------------------------------------------------------------------------------------------

_SNIPPET = """WITH flat AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
hits AS (SELECT doc_id, t, length(t) AS n, least(nullif(instr(lower(t), 'ung'), 0), nullif(instr(lower(t), 'tion'), 0)) - 1 AS hit FROM flat),
ends AS (SELECT *, least(n, greatest(0, hit - 50) + 200) AS e FROM hits), both_ends AS (SELECT *, greatest(0, e - 200) AS s FROM ends)
SELECT doc_id, CASE WHEN n <= 200 THEN t WHEN hit IS NULL THEN rtrim(substring(t, 1, 200)) || '...'
  ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || trim(substring(t, CAST(s + 1 AS INT), CAST(e - s AS INT))) || (CASE WHEN e < n THEN '...' ELSE '' END) END AS snippet FROM both_ends"""


@registered(_SNIPPET)
def snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), ["ung", "tion"]).alias("snippet"))


@registered(r"""WITH parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ps FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(ps, lambda p: CASE WHEN lower(p) IN ('th', 'ung', 'que') THEN '<mark>' || p || '</mark>' ELSE p END), '')) AS marked_md5 FROM parts""")
def highlight(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.highlight(F.coalesce("text", F.lit("")), ["th", "ung", "que"])).alias("marked_md5"))


# --- feedback --------------------------------------------------------------------------------------------------------

_MARKED = """, marked AS (SELECT DISTINCT doc_id % 50 AS session_id, doc_id FROM labels WHERE quality = 1),
ordered AS (SELECT session_id, doc_id, term, tf, row_number() OVER (PARTITION BY session_id, doc_id ORDER BY tf DESC, term) AS r FROM marked JOIN dt USING (doc_id)),
weighed AS (SELECT session_id, doc_id, term, tf * greatest(0, log10(total / df)) AS w FROM ordered JOIN vocab USING (term), stats WHERE r <= 25),
sizes AS (SELECT session_id, count(DISTINCT doc_id) AS n FROM weighed WHERE w <> 0 GROUP BY session_id),
boosts AS (SELECT session_id, term, sum(0.75 * w / n) AS weight FROM weighed JOIN sizes USING (session_id) WHERE w <> 0 GROUP BY ALL HAVING sum(0.75 * w / n) > 0)
"""


def _marked(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 50).alias("session_id"), "doc_id")


@registered(_MARKED + "SELECT session_id, term, round(weight, 6) AS weight FROM boosts")
def rocchio_terms(spark, sf_dir):
    return B.boosts(index(spark, sf_dir), _marked(spark, sf_dir)).select("session_id", "term", F.round("weight", 6).alias("weight"))


@registered(
    _MATCH
    + _MARKED
    + f""", rounded AS (SELECT session_id, term, round(weight, 9) AS weight FROM boosts WHERE term NOT IN ({_quoted(TERMS)})),
strongest AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, term) AS r, max(weight) OVER (PARTITION BY session_id) AS best FROM rounded),
asked AS (SELECT session_id, term, df, greatest(1, CAST(round_even(2 * weight / best, 0) AS INT)) AS qtf FROM strongest JOIN vocab USING (term) WHERE r <= 10
  UNION ALL SELECT session_id, term, df, qtf FROM (SELECT DISTINCT session_id FROM marked), terms),
sums AS (SELECT session_id AS query_id, doc_id, round(sum({_BM25} * qtf), 6) AS score FROM asked JOIN dt USING (term) JOIN cand USING (doc_id) JOIN lengths USING (doc_id), stats GROUP BY ALL),
best_of AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sums)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM best_of WHERE rank <= 10"""
)
def personalised_bm25(spark, sf_dir):
    x, marked = index(spark, sf_dir), _marked(spark, sf_dir)
    sessions = marked.select(F.col("session_id").alias("query_id")).distinct()
    terms = sessions.crossJoin(F.broadcast(Q.query_terms(x, RANKED)))  # the words of one query
    matched = replace(x, doc_terms=x.doc_terms.join(Q.matching_documents(x, RANKED), "doc_id", "left_semi"))
    found = matched.doc_terms.join(terms, "term").select("query_id", "doc_id").distinct()  # a match has a term of the query
    boosts = B.boosts(x, marked).select(F.col("session_id").alias("query_id"), "term", F.round("weight", 9).alias("weight"))
    scores = R.score(matched, found, B.personalise(x, terms, boosts)).withColumn("score", F.round("score", 6))
    return R.top_k_per_query(scores, 10)


@registered(
    f""", marked AS (SELECT DISTINCT doc_id % 50 AS session_id, doc_id, quality FROM labels WHERE quality IN (0, 1)),
ordered AS (SELECT session_id, quality, doc_id, term, tf, row_number() OVER (PARTITION BY session_id, doc_id ORDER BY tf DESC, term) AS r FROM marked JOIN dt USING (doc_id)),
weighed AS (SELECT session_id, quality, doc_id, term, tf * greatest(0, log10(total / df)) AS w FROM ordered JOIN vocab USING (term), stats WHERE r <= 25),
sizes AS (SELECT session_id, quality, count(DISTINCT doc_id) AS n FROM weighed WHERE w <> 0 GROUP BY ALL),
parts AS (SELECT session_id, term, CASE quality WHEN 1 THEN {ROCCHIO[1]} ELSE -{ROCCHIO[2]} END * w / n AS x FROM weighed JOIN sizes USING (session_id, quality) WHERE w <> 0
  UNION ALL SELECT session_id, term, {ROCCHIO[0]} * greatest(0, log10(total / df)) FROM (SELECT DISTINCT session_id FROM marked), (SELECT * FROM vocab WHERE term IN ({_quoted(TERMS)})), stats)
SELECT session_id, term, round(sum(x), 6) AS weight FROM parts GROUP BY ALL HAVING round(sum(x), 6) > 0"""
)
def rocchio_both_sides(spark, sf_dir):
    """The words of a query moved towards a session's good documents and away from its bad ones."""
    x = index(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("session_id"), "doc_id", "quality")
    vectors = lambda q: B.relevant_vectors(x, labels.where(F.col("quality") == q).select("session_id", "doc_id"))
    asked = R.query_vectors(x, Q.query_terms(x, RANKED).select(F.lit(0).alias("query_id"), "*")).select("term", F.col("q_weight").alias("weight"))
    sessions = labels.where("quality in (0, 1)").select("session_id").distinct().crossJoin(F.broadcast(asked))  # the words of one query
    return B.rocchio(sessions, vectors(1), vectors(0)).select("session_id", "term", F.round("weight", 6).alias("weight")).where("weight > 0")


# --- evaluation ------------------------------------------------------------------------------------------------------

_JUDGED = ", relevant AS (SELECT DISTINCT a.query_id, l.doc_id FROM asked a JOIN labels l ON l.quality = 1 AND l.doc_id % 40 = a.query_id % 40), sizes AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id)"


def _metrics_sql(value: str) -> str:
    return _ASKED.replace("VALUE", value) + _JUDGED + """, marked AS (SELECT t.query_id, t.rank, (r.doc_id IS NOT NULL)::INT AS hit FROM top t LEFT JOIN relevant r USING (query_id, doc_id)),
running AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS p FROM marked),
sums_of AS (SELECT query_id, sum(hit) FILTER (rank <= 5) AS h5, sum(hit) AS h10, min(rank) FILTER (hit = 1) AS first, sum(hit * p) AS ps FROM running GROUP BY query_id),
report AS (SELECT a.query_id, coalesce(CASE WHEN n > 0 THEN h5 / 5.0 END, 0.0) AS precision_at_5, coalesce(CASE WHEN n > 0 THEN h10 / 10.0 END, 0.0) AS precision_at_10, coalesce(h5 / n, 0.0) AS recall_at_5, coalesce(h10 / n, 0.0) AS recall_at_10,
  coalesce(1.0 / first, 0.0) AS reciprocal_rank, coalesce(ps / n, 0.0) AS average_precision FROM (SELECT DISTINCT query_id FROM asked) a LEFT JOIN sums_of USING (query_id) LEFT JOIN sizes USING (query_id))
"""


def _report(spark, sf_dir, mode="bm25"):
    asked = _asked(spark, sf_dir)
    judged = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", (F.col("doc_id") % 40).alias("k"))
    relevant = asked.select("query_id", (F.col("query_id") % 40).alias("k")).join(judged, "k").select("query_id", "doc_id")
    return E.evaluate(_batch(spark, sf_dir, mode), relevant, asked)


def _rounded(df, *keep):
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in df.columns if c not in keep))


_R6 = lambda *cs: ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cs)


@registered(_metrics_sql(_BM25) + "SELECT query_id, " + _R6("precision_at_5", "precision_at_10", "recall_at_5", "recall_at_10") + " FROM report")
def precision_recall_at_k(spark, sf_dir):
    return _rounded(_report(spark, sf_dir).drop("reciprocal_rank", "average_precision"), "query_id")


@registered(_metrics_sql(_BM25) + "SELECT query_id, " + _R6("reciprocal_rank", "average_precision") + " FROM report")
def rr_ap_per_query(spark, sf_dir):
    return _rounded(_report(spark, sf_dir).select("query_id", "reciprocal_rank", "average_precision"), "query_id")


def _means(mode: str, value: str) -> str:
    cols = ", ".join(f"round(CAST(avg({c}) AS DOUBLE), 6) AS {n}" for c, n in (("precision_at_5",) * 2, ("precision_at_10",) * 2, ("recall_at_5",) * 2, ("recall_at_10",) * 2, ("reciprocal_rank",) * 2, ("average_precision",) * 2, ("reciprocal_rank", "mrr"), ("average_precision", "map")))
    return f"SELECT * FROM ({PRELUDE + _metrics_sql(value)} SELECT '{mode}' AS mode, {cols} FROM report)"


@registered("WITH both_modes AS (" + _means("bm25", _BM25) + " UNION ALL " + _means("tfidf", "tf * greatest(0, log10(total / df))") + ") SELECT * FROM both_modes")
def metrics_by_mode(spark, sf_dir):
    reports = [_report(spark, sf_dir, m).withColumn("mode", F.lit(m)) for m in ("bm25", "tfidf")]
    return _rounded(E.aggregate_metrics(reports[0].unionByName(reports[1]), "mode"), "mode")


# --- pages, links, records -------------------------------------------------------------------------------------------

_URL = r"""WITH parts AS (SELECT page_id, url, regexp_extract(trim(url), '^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
cut AS (SELECT page_id, url, lower(p.scheme) AS scheme, regexp_replace(lower(p.host), CASE WHEN lower(p.scheme) = 'http' THEN ':80$' ELSE ':443$' END, '') AS host, rtrim(trim(p.path), '/') AS path, CASE WHEN p.query = '?' THEN '' ELSE p.query END AS query FROM parts),
urls AS (SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS normal, host FROM cut)
"""


@registered(_URL + "SELECT page_id, normal, host FROM urls")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise_url(F.col("url")).alias("normal")).withColumn("host", U.host_of(F.col("normal")))


@registered(_URL + "SELECT normal, count(*) AS n, min(page_id) AS first_page FROM urls WHERE normal IS NOT NULL GROUP BY normal")
def url_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.normalise_url(F.col("url")).alias("normal")).where("normal is not null")
    return rows.groupBy("normal").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@registered(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS title FROM t""")
def page_titles(spark, sf_dir):
    return C.parse_pages(table(spark, sf_dir, "pages")).select("page_id", "title")


@registered(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="[^"]+"') AS a FROM pages) SELECT page_id, CAST(len(a) AS INT) AS n_links FROM t""")
def page_links(spark, sf_dir):
    return C.parse_pages(table(spark, sf_dir, "pages")).select("page_id", F.size("links").alias("n_links"))


#: Visible text by regular expressions, for pages whose head is closed: section breaks at block elements, comments and tags dropped, entities decoded.
_VISIBLE = (
    r"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', '', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gi') AS h FROM pages),
blocks AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(?:BLOCKS)\b[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g') AS t FROM bare),
decoded AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM blocks),
flat AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[\s\x01]*\x01[\s\x01]*', chr(1), 'g'), '\s+', ' ', 'g'), ' ' || chr(1)) AS t FROM decoded),
segments AS (SELECT page_id, t, list_filter(list_transform(string_split(t, chr(1)), lambda s: list_filter(list_transform(regexp_extract_all(s, '[a-zA-Z0-9]+'), lambda w: lower(w)), lambda w: w NOT IN (STOP))), lambda ws: len(ws) > 0) AS ss FROM flat)
SELECT page_id, md5(replace(t, chr(1), ' | ')) AS text_md5, CAST(len(ss) AS INT) AS n_segments, CAST(len(flatten(ss)) AS INT) AS n_tokens FROM segments"""
).replace("BLOCKS", "|".join(BLOCK_TAGS)).replace("STOP", _quoted(CRAWL_STOPWORDS))


@registered(_VISIBLE)
def html_text(spark, sf_dir):
    rows = C.parse_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.md5(F.replace("text", F.lit(SECTION_BREAK), F.lit(" | "))).alias("text_md5"), F.size("token_segments").alias("n_segments"), F.size("tokens").alias("n_tokens"))


#: Links of pages whose hrefs are absolute paths or whole URLs, normalised like the pages' own.
_LINKS = (
    _URL
    + r""", hrefs AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]+)"', 1) AS hs FROM pages),
raw_links AS (SELECT u.normal AS src, u.normal LIKE 'https:%' AS safe, u.host, CAST(unnest(range(len(hs))) AS INT) AS link_ord, replace(unnest(hs), '&amp;', '&') AS h FROM hrefs JOIN urls u USING (page_id) WHERE u.normal IS NOT NULL),
absolute AS (SELECT src, link_ord, CASE WHEN h LIKE '/%' THEN CASE WHEN safe THEN 'https://' ELSE 'http://' END || host || h ELSE h END AS h FROM raw_links),
parsed_links AS (SELECT src, link_ord, regexp_extract(trim(h), '^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS p FROM absolute),
links AS (SELECT src, lower(p.scheme) || '://' || lower(p.host) || CASE WHEN rtrim(trim(p.path), '/') = '' THEN '/' ELSE rtrim(trim(p.path), '/') END || p.query AS dst, link_ord FROM parsed_links WHERE lower(p.scheme) IN ('http', 'https'))
"""
)


@registered(_LINKS + "SELECT src, dst, link_ord FROM links")
def link_graph(spark, sf_dir):
    return C.link_graph(table(spark, sf_dir, "pages"))


@registered()
def bfs_crawl(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    seeds = [r.url for r in pages.orderBy("page_id").select("url").limit(5).collect()]  # a crawl starts somewhere
    return C.crawl(pages, seeds, max_pages=500, max_depth=5, max_links=3).select("doc_id", "url", "title", "depth", F.size("tokens").alias("n_tokens"))


@registered(
    _LINKS.replace("WITH parts", "WITH RECURSIVE parts", 1)
    + ", reach AS (SELECT min(normal) AS url, 0 AS depth FROM urls WHERE normal IS NOT NULL GROUP BY host UNION SELECT l.dst, r.depth + 1 FROM reach r JOIN links l ON l.src = r.url JOIN urls u ON u.normal = l.dst WHERE r.depth < 5) "
    + "SELECT url, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY url"
)
def bfs_reach(spark, sf_dir):
    """Depth of all pages that up to five links lead to, from the first page of every host."""
    pages = table(spark, sf_dir, "pages")
    urls = pages.select(U.normalise_url(F.col("url")).alias("url")).where("url is not null")
    return C.reachable(pages, urls.groupBy(U.host_of(F.col("url")).alias("host")).agg(F.min("url").alias("url")), max_depth=5)


@registered("SELECT doc_id, md5(text) AS text_md5 FROM docs")
def json_roundtrip(spark, sf_dir):
    lines = S.to_records(X.with_columns(documents(spark, sf_dir)))
    back = lines.select(F.from_json("value", S.SCHEMA).alias("d")).select("d.*")
    return S.typed(back).select("doc_id", F.md5("text").alias("text_md5"))
