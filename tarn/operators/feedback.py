"""Relevance feedback: Rocchio over sparse vectors held as rows, and its use in a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.words import FEEDBACK_DOC_TERMS, FEEDBACK_MAX_REPEAT, FEEDBACK_MAX_TERMS, ROCCHIO

from .index import Index
from .ranking import vector_weight


def rocchio(query: DataFrame, relevant: DataFrame, other: DataFrame | None = None, weights: tuple[float, float, float] = ROCCHIO) -> DataFrame:
    """(session_id, term, weight) above 0 from a query's vector (session_id, term, weight) and those of documents
    (session_id, doc_id, term, weight) that are relevant, or not."""
    alpha, beta, gamma = weights
    if min(weights) < 0:
        raise ValueError("weights must not be negative")

    def mean(vectors: DataFrame, factor: float) -> DataFrame:
        n = vectors.groupBy("session_id").agg(F.count_distinct("doc_id").alias("n"))
        return vectors.join(n, "session_id").select("session_id", "term", (F.lit(factor) * F.col("weight") / F.col("n")).alias("weight"))

    parts = query.select("session_id", "term", (F.lit(alpha) * F.col("weight")).alias("weight")).unionByName(mean(relevant, beta))
    if other is not None:
        parts = parts.unionByName(mean(other, -gamma))
    return parts.groupBy("session_id", "term").agg(F.sum("weight").alias("weight")).where("weight > 0")


def relevant_vectors(index: Index, marked: DataFrame) -> DataFrame:
    """(session_id, doc_id, term, weight): the most frequent terms of the documents marked (session_id, doc_id), TF-IDF weighed."""
    best = Window.partitionBy("session_id", "doc_id").orderBy(F.desc("tf"), F.asc("term"))
    top = marked.distinct().join(index.doc_terms, "doc_id").withColumn("r", F.row_number().over(best)).where(F.col("r") <= FEEDBACK_DOC_TERMS)
    weight = vector_weight(F.col("tf"), F.col("df"), F.col("total_docs"))
    rated = top.join(index.vocab, "term").crossJoin(F.broadcast(index.stats.select("total_docs")))
    return rated.select("session_id", "doc_id", "term", weight.alias("weight")).where("weight <> 0")


def boosts(index: Index, marked: DataFrame) -> DataFrame:
    """(session_id, term, weight) that the marked documents give a session."""
    vectors = relevant_vectors(index, marked)
    none = vectors.select("session_id", "term", "weight").where("false")
    return rocchio(none, vectors)


def personalise(index: Index, terms: DataFrame, boosts: DataFrame) -> DataFrame:
    """Query terms (query_id, term, df, qtf) with the strongest boosts (query_id, term, weight) that aren't among them, repeated by strength."""
    fresh = boosts.where("weight > 0").join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), F.asc("term"))
    ranked = fresh.withColumns({"r": F.row_number().over(order), "top": F.max("weight").over(Window.partitionBy("query_id"))}).where(F.col("r") <= FEEDBACK_MAX_TERMS)
    repeat = F.greatest(F.lit(1), F.bround(F.lit(FEEDBACK_MAX_REPEAT) * F.col("weight") / F.col("top")).cast("int"))
    added = ranked.join(index.vocab.where("df > 0"), "term").select("query_id", "term", "df", repeat.alias("qtf"))
    return terms.select("query_id", "term", "df", "qtf").unionByName(added)
