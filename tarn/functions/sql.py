"""The analysers and scores as functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .words import BM25_B, BM25_K1, INDEX_STOPWORDS, IRREGULAR


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_functions() -> dict[str, str]:
    """Name -> signature and body of each function: plain SQL, so that queries that use them stay in the JVM."""
    undouble = lambda w, n: f"CASE WHEN length({w}) - {n} > 2 AND substr({w}, -{n + 1}, 1) = substr({w}, -{n + 2}, 1) THEN left({w}, length({w}) - {n + 1}) ELSE left({w}, length({w}) - {n}) END"
    irregular = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    lemma = (
        f"CASE WHEN contains(w, '*') THEN w {irregular} WHEN length(w) > 5 AND endswith(w, 'ies') THEN left(w, length(w) - 3) || 'y' "
        f"WHEN length(w) > 5 AND endswith(w, 'ing') THEN {undouble('w', 3)} WHEN length(w) > 4 AND endswith(w, 'ed') THEN {undouble('w', 2)} "
        "WHEN length(w) > 4 AND endswith(w, 'es') THEN left(w, length(w) - 2) WHEN length(w) > 3 AND endswith(w, 's') AND NOT endswith(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"
    )
    return {
        "tarn_lemma": f"(w STRING) RETURNS STRING RETURN {lemma}",
        "tarn_tokens": "(body STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(body), '[a-z0-9_*]+', 0)",
        "tarn_is_stopword": f"(w STRING) RETURNS BOOLEAN RETURN lower(w) IN ({_quoted(INDEX_STOPWORDS)})",
        "tarn_tfidf": "(tf DOUBLE, df DOUBLE, total DOUBLE) RETURNS DOUBLE RETURN CASE WHEN tf > 0 AND df > 0 AND total > 0 THEN tf * greatest(0D, log10(total / df)) ELSE 0D END",
        "tarn_bm25": "(tf DOUBLE, df DOUBLE, total DOUBLE, length DOUBLE, average DOUBLE) RETURNS DOUBLE RETURN CASE WHEN tf > 0 AND df > 0 "
        f"THEN greatest(0D, log10((total - df + 0.5D) / (df + 0.5D) + 1)) * tf * ({BM25_K1}D + 1) / (tf + {BM25_K1}D * (1 - {BM25_B}D + {BM25_B}D * length / CASE WHEN average > 0 THEN average ELSE greatest(length, 1D) END)) ELSE 0D END",
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL, and give their names."""
    for name, body in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(sql_functions())
