"""Scores and top-k. A ranking mode is a Column of tf, df, document length and corpus statistics."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.words import BM25_B, BM25_K1

from .index import Index


class RankingMode(Enum):
    TFIDF = "tfidf"
    BM25 = "bm25"
    VECTOR = "vector"
    IDF_SUM = "idf_sum"


_NAMES = {"tfidf": "tfidf", "tf-idf": "tfidf", "tf_idf": "tfidf", "bm25": "bm25", "vector": "vector", "cosine": "vector", "vector/cosine": "vector", "idf_sum": "idf_sum"}


def parse_ranking_mode(name: str | RankingMode) -> RankingMode:
    if isinstance(name, RankingMode):
        return name
    if (known := _NAMES.get(name.strip().lower() if isinstance(name, str) else None)) is None:
        raise ValueError(f"unknown ranking mode {name!r}")
    return RankingMode(known)


def tfidf(tf: Column, df: Column, total: Column) -> Column:
    return F.when((tf > 0) & (df > 0) & (total > 0), tf * F.greatest(F.lit(0.0), F.log10(total / F.nullif(df, F.lit(0))))).otherwise(0.0)


def bm25(tf: Column, df: Column, total: Column, length: Column, average: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative and b lie in 0..1")
    average = F.when(average > 0, average).otherwise(F.greatest(length, F.lit(1)))
    idf = F.greatest(F.lit(0.0), F.log10((total - df + 0.5) / (df + 0.5) + 1))
    full = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    return F.when((tf > 0) & (df > 0), idf * full).otherwise(0.0)


def idf_sum(tf: Column, df: Column, total: Column) -> Column:
    return F.ln(1 + (total - df + 0.5) / (df + 0.5)) * tf


def vector_weight(tf: Column, df: Column, total: Column) -> Column:
    """TF-IDF weight of a sparse vector; terms of weight 0 are left out."""
    return tfidf(tf, df, total)


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(dot, norm_a * norm_b), F.lit(0.0)))


def score(index: Index, candidates: DataFrame, terms: DataFrame, mode: str | RankingMode = "bm25", k1: float = BM25_K1, b: float = BM25_B, df_scope: str = "candidates") -> DataFrame:
    """(query_id, doc_id, score) of every candidate (query_id, doc_id) for terms (query_id, term, df, qtf).

    Candidates without any of the terms score 0. In vector mode terms that aren't the query's take their document frequency
    among the query's candidates (``df_scope`` "candidates") or in the corpus ("corpus").
    """
    mode = parse_ranking_mode(mode)
    stats = F.broadcast(index.stats.select("total_docs", "avg_doc_length"))  # one row
    if mode is RankingMode.VECTOR:
        scored = _cosine_scores(index, candidates, terms, stats, df_scope)
    else:
        rows = index.doc_terms.join(terms, "term").join(candidates, ["query_id", "doc_id"]).crossJoin(stats)
        if mode is RankingMode.BM25:
            rows = rows.join(index.doc_stats, "doc_id")
            value = bm25(F.col("tf"), F.col("df"), F.col("total_docs"), F.col("doc_len"), F.col("avg_doc_length"), k1, b) * F.col("qtf")
        elif mode is RankingMode.TFIDF:
            value = tfidf(F.col("tf"), F.col("df"), F.col("total_docs")) * F.col("qtf")
        else:
            value = idf_sum(F.col("tf"), F.col("df"), F.col("total_docs"))
        scored = rows.groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))
    return candidates.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def score_document(index: Index, doc_id: int, terms: DataFrame, mode: str | RankingMode = "bm25", **options) -> float:
    """The score of one document for terms (term, df, qtf); 0 for a document without any of them, or that isn't there."""
    one = terms.select(F.lit(0).cast("long").alias("query_id"), "*")
    asked = index.doc_stats.where(F.col("doc_id") == doc_id).select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    row = score(index, asked, one, mode, **options).first()
    return row["score"] if row else 0.0


def document_vectors(index: Index, candidates: DataFrame, terms: DataFrame, df_scope: str = "candidates") -> DataFrame:
    """(query_id, doc_id, term, weight): TF-IDF vectors of the candidates, weights of 0 left out."""
    full = candidates.select("query_id", "doc_id").join(index.doc_terms, "doc_id")
    if df_scope == "corpus":
        rated = full.join(index.vocab, "term").withColumnRenamed("df", "known")
    else:
        local = full.groupBy("query_id", "term").agg(F.count("*").alias("local"))
        known = terms.where("df > 0").select("query_id", "term", F.col("df").alias("own"))
        local = local.join(known, ["query_id", "term"], "left").select("query_id", "term", F.coalesce("own", "local").alias("known"))
        rated = full.join(local, ["query_id", "term"])
    weight = vector_weight(F.col("tf"), F.col("known"), F.col("total_docs"))
    return rated.crossJoin(F.broadcast(index.stats.select("total_docs"))).select("query_id", "doc_id", "term", weight.alias("weight")).where("weight <> 0")


def query_vectors(index: Index, terms: DataFrame) -> DataFrame:
    weight = vector_weight(F.col("qtf"), F.col("df"), F.col("total_docs"))
    return terms.crossJoin(F.broadcast(index.stats.select("total_docs"))).select("query_id", "term", weight.alias("q_weight")).where("q_weight <> 0")


def _cosine_scores(index: Index, candidates: DataFrame, terms: DataFrame, stats: DataFrame, df_scope: str) -> DataFrame:
    docs = document_vectors(index, candidates, terms, df_scope)
    query = query_vectors(index, terms)
    q_norm = query.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q_weight") * F.col("q_weight"))).alias("q_norm"))
    both = docs.join(query, ["query_id", "term"], "left").groupBy("query_id", "doc_id")
    parts = both.agg(F.sum(F.col("weight") * F.coalesce("q_weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return parts.join(q_norm, "query_id").select("query_id", "doc_id", cosine(F.col("dot"), F.col("norm"), F.col("q_norm")).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(doc_id, score) of the k best, ties by doc_id; scores that are no number are left out, k below 1 gives none."""
    return scores.where(~F.isnan("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(max(0, k))


def top_k_for_mmr(scores: DataFrame, pool: int = 20) -> DataFrame:
    return top_k(scores, pool)


def top_k_per_query(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of each query; Spark keeps k rows per query and task before it shuffles."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = scores.where(~F.isnan("score")).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def batch_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, df, qtf) of plain word queries (query_id, query): lemmas of their words with multiplicity."""
    from tarn.functions.text import process_text

    words = queries.select("query_id", F.explode(process_text(F.col("query"))).alias("term"))
    counts = words.groupBy("query_id", "term").agg(F.count("*").cast("int").alias("qtf"))
    return counts.join(index.vocab, "term", "left").select("query_id", "term", F.coalesce("df", F.lit(0)).alias("df"), "qtf")


def batch_search(index: Index, queries: DataFrame, mode: str | RankingMode = "bm25", k: int = 10, any_term: bool = False) -> DataFrame:
    """The k best documents of many word queries (query_id, query) in one job; all words must occur, or any."""
    terms = batch_terms(index, queries)
    needed = terms.groupBy("query_id").agg(F.count("*").alias("needed"))
    found = index.doc_terms.join(terms.select("query_id", "term"), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    candidates = found.select("query_id", "doc_id") if any_term else found.join(needed, "query_id").where("n = needed").select("query_id", "doc_id")
    return top_k_per_query(score(index, candidates, terms, mode), k)
