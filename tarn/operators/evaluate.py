"""Retrieval quality over many queries at once.

``retrieved`` is (query_id, rank, doc_id) with ranks from 1, ``relevant`` is (query_id, doc_id), one row per judged document.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame | None = None, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """precision@k, recall@k, reciprocal rank and average precision of each query; 0 where either side is empty."""
    marks = relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    sizes = marks.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = retrieved.join(marks, ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    rows = rows.withColumn("precision", F.sum("hit").over(seen) / F.col("rank"))
    hits = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    sums = rows.groupBy("query_id").agg(
        *(hits(k).alias(f"hits_{k}") for k in ks), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("hit") * F.col("precision")).alias("precisions")
    )
    all_queries = queries.select("query_id") if queries is not None else retrieved.select("query_id").unionByName(relevant.select("query_id"))
    joined = all_queries.distinct().join(sums, "query_id", "left").join(sizes, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision = [zero(F.when(F.col("n_relevant") > 0, F.col(f"hits_{k}") / F.lit(k)) if k > 0 else F.lit(0.0)).alias(f"precision_at_{k}") for k in ks]
    recall = [zero(F.col(f"hits_{k}") / F.col("n_relevant") if k > 0 else F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    return joined.select("query_id", *precision, *recall, zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("precisions") / F.col("n_relevant")).alias("average_precision"))


def aggregate_metrics(report: DataFrame, *by: str) -> DataFrame:
    """Means over queries, by the columns named; the mean reciprocal rank also as ``mrr``, the mean average precision as ``map``."""
    metrics = [c for c in report.columns if c not in ("query_id", *by)]
    return report.groupBy(*by).agg(*(F.avg(c).alias(c) for c in metrics), F.avg("reciprocal_rank").alias("mrr"), F.avg("average_precision").alias("map"))


def latency(run: Callable[[], object], repeats: int = 3) -> dict[str, float]:
    """Seconds of a call: mean, median, 95th percentile (nearest rank) and maximum."""
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    times.sort()
    return {"mean": statistics.fmean(times), "median": statistics.median(times), "p95": times[-(-95 * len(times) // 100) - 1], "max": times[-1]}


def format_report(rows: Iterable[dict]) -> str:
    """A fixed-width table of reports."""
    rows = list(rows)
    if not rows:
        return "no results\n"
    shown = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]
    heads = list(rows[0])
    widths = [max(len(h), *(len(s[k]) for s in shown)) for k, h in enumerate(heads)]
    return "".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() + "\n" for line in [heads, *shown])
