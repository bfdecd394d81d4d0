"""Maximal marginal relevance over small pools, one group per query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.words import MMR_LAMBDA


def greedy_mmr(ids: list[int], relevance: dict[int, float], similarity: dict[tuple[int, int], float], k: int, trade_off: float = MMR_LAMBDA) -> list[tuple[int, float]]:
    """(id, MMR score) in the order chosen; ties keep the pool's order, repeated ids count once."""
    if not 0 <= trade_off <= 1:
        raise ValueError("the trade-off must lie in 0..1")
    left, chosen = list(dict.fromkeys(ids)), []
    closest = dict.fromkeys(left, 0.0)
    while left and len(chosen) < k:
        value = lambda d: trade_off * relevance.get(d, 0.0) - (1 - trade_off) * closest[d]
        best = max(left, key=value)  # the first of equals
        chosen.append((best, value(best)))
        left.remove(best)
        for d in left:
            pair = similarity.get((d, best), similarity.get((best, d), 0.0))
            closest[d] = pair if len(chosen) == 1 else max(closest[d], pair)
    return chosen


def mmr_rerank(pool: DataFrame, doc_vectors: DataFrame, query_vectors: DataFrame, k: int, trade_off: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, doc_id, mmr_score, step) chosen from ``pool`` (query_id, doc_id, pool_rank; a few dozen rows per query).

    Vectors are (query_id, doc_id, term, weight) and (query_id, term, q_weight). Cosines are computed as joins on the term;
    only the greedy choice runs in Python, on a pool at a time.
    """
    vectors = doc_vectors.join(pool.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    norms = vectors.groupBy("query_id", "doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = vectors.join(norms, ["query_id", "doc_id"]).select("query_id", "doc_id", "term", (F.col("weight") / F.col("norm")).alias("w"))
    q_norm = query_vectors.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q_weight") * F.col("q_weight"))).alias("norm"))
    q_unit = query_vectors.join(q_norm, "query_id").select("query_id", "term", (F.col("q_weight") / F.col("norm")).alias("q"))
    one = lambda c: F.round(F.least(F.lit(1.0), c), 9)  # noqa: E731  rounded, so that copies tie whatever the order of summation
    relevance = unit.join(q_unit, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(one(F.sum(F.col("w") * F.col("q"))).alias("relevance"))
    other = unit.select("query_id", F.col("doc_id").alias("other"), "term", F.col("w").alias("v"))
    near = unit.join(other, ["query_id", "term"]).where("doc_id < other").groupBy("query_id", "doc_id", "other").agg(one(F.sum(F.col("w") * F.col("v"))).alias("similarity"))
    members = pool.select("query_id", "doc_id", "pool_rank").join(relevance, ["query_id", "doc_id"], "left")
    nobody = F.lit(None)
    rows = members.select("query_id", "doc_id", "pool_rank", "relevance", nobody.cast("long").alias("other"), nobody.cast("double").alias("similarity"))
    pairs = near.select("query_id", "doc_id", nobody.cast("int").alias("pool_rank"), nobody.cast("double").alias("relevance"), "other", "similarity")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group.other.isna()].sort_values("pool_rank")
        both = group[group.other.notna()]
        similarity = {(int(a), int(b)): s for a, b, s in zip(both.doc_id, both.other, both.similarity, strict=True)}
        chosen = greedy_mmr([int(x) for x in own.doc_id], dict(zip(own.doc_id.astype(int), own.relevance.fillna(0.0), strict=True)), similarity, k, trade_off)
        return pd.DataFrame({"query_id": group.query_id.iloc[0], "doc_id": [d for d, _ in chosen], "mmr_score": [s for _, s in chosen], "step": range(1, len(chosen) + 1)})

    return rows.unionByName(pairs).groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, mmr_score double, step int")
