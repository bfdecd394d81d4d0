"""An engine under measurement: quality and latency by ranking mode, concurrent sessions, the best k against a full sort, reports."""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.evaluate import aggregate_metrics, evaluate, format_report, latency
from tarn.operators.index import Index
from tarn.operators.ranking import batch_search

from .engine import SearchEngine

MODES = ("tfidf", "bm25", "vector")


def compare_modes(index: Index, queries: DataFrame, relevant: DataFrame, modes: Sequence[str] = MODES, k: int = 10) -> DataFrame:
    """Mean metrics by ``mode`` over word queries (query_id, query) and judged documents (query_id, doc_id), each mode in one job.
    Queries that no document matches are left out, as the offline evaluator does."""
    reports = []
    for mode in modes:
        found = batch_search(index, queries, mode, k, any_term=True)
        asked = found.select("query_id").distinct()
        reports.append(evaluate(found, relevant.join(asked, "query_id", "left_semi"), asked).withColumn("mode", F.lit(mode)))
    together = reports[0]
    for r in reports[1:]:
        together = together.unionByName(r)
    return aggregate_metrics(together, "mode")


class Measurement:
    """``make`` builds an engine whose durable cache lies at the path it is given; ``queries`` are (text, relevant doc_ids)."""

    def __init__(self, make: Callable[[str], SearchEngine], queries: Sequence[tuple[str, set[int]]], repeats: int = 3, sessions: int = 8, k: int = 10):
        self.make, self.queries, self.repeats, self.sessions, self.k = make, list(queries), max(1, repeats), sessions, k

    def _ask(self, engine: SearchEngine, query: str, mode: str, session: str | None = None) -> list[int]:
        return [r["doc_id"] for r in engine.search(query, session, mode, self.k)]

    def quality(self, engine: SearchEngine, mode: str) -> dict[str, float]:
        spark = engine.index.documents.sparkSession
        engine.clear_cache()
        found = [(i, rank, d) for i, (q, _) in enumerate(self.queries) for rank, d in enumerate(self._ask(engine, q, mode), 1)]
        judged = [(i, d) for i, (_, relevant) in enumerate(self.queries) for d in sorted(relevant)]
        asked = spark.createDataFrame([(i,) for i in range(len(self.queries))], "query_id long")
        report = evaluate(spark.createDataFrame(found, "query_id long, rank int, doc_id long"), spark.createDataFrame(judged, "query_id long, doc_id long"), asked)
        row = aggregate_metrics(report.withColumn("mode", F.lit(mode)), "mode").first()
        return {name: row[name] for name in ("precision_at_5", "precision_at_10", "recall_at_5", "recall_at_10", "mrr", "map")}

    def misses(self, engine: SearchEngine, mode: str) -> dict[str, float]:
        def run(query: str) -> None:
            engine.clear_cache()
            self._ask(engine, query, mode)

        return self._over_queries(run)

    def hits(self, engine: SearchEngine, mode: str) -> dict[str, float]:
        for query, _ in self.queries:
            self._ask(engine, query, mode)
        return self._over_queries(lambda q: self._ask(engine, q, mode))

    def _over_queries(self, run: Callable[[str], object], repeats: int | None = None) -> dict[str, float]:
        todo = iter([q for _ in range(repeats or self.repeats) for q, _ in self.queries])
        return latency(lambda: run(next(todo)), (repeats or self.repeats) * len(self.queries)) if self.queries else {}

    def after_restart(self, mode: str) -> dict[str, float]:
        """First answers of a new engine over the durable cache of an earlier one."""
        with tempfile.TemporaryDirectory() as folder:  # SQLite, on the driver
            path = os.path.join(folder, "answers.db")
            before = self.make(path)
            for query, _ in self.queries:
                self._ask(before, query, mode)
            again = self.make(path)
            return self._over_queries(lambda q: self._ask(again, q, mode), 1) | {"from_disk": again.cache_hits}

    def together(self, mode: str, seed: int = 1) -> dict[str, float]:
        """Many sessions at once on one engine: latency, requests a second, and answers that differ from those of a lone session."""
        with tempfile.TemporaryDirectory() as folder:
            engine = self.make(os.path.join(folder, "answers.db"))
            alone = {q: self._ask(engine, q, mode) for q, _ in self.queries}
            engine.clear_cache()
            rnd = random.Random(seed)
            todo = [(f"session {s}", rnd.choice(self.queries)[0]) for s in range(self.sessions) for _ in self.queries]

            def request(asked: tuple[str, str]) -> tuple[float, bool]:
                began = time.perf_counter()
                found = self._ask(engine, asked[1], mode, asked[0])
                return time.perf_counter() - began, found == alone[asked[1]]

            began = time.perf_counter()
            with ThreadPoolExecutor(self.sessions) as pool:
                done = list(pool.map(request, todo))
            wall = time.perf_counter() - began
            times = iter(sorted(t for t, _ in done))
            mean = sum(t for t, _ in done) / max(1, len(done))
            return {"mean": mean, "max": max(times, default=0.0), "requests": len(done), "per_second": len(done) / wall if wall else 0.0, "inconsistent": sum(not same for _, same in done), "cached": len(engine.cache) if engine.cache else 0}

    def run(self, modes: Sequence[str] = MODES) -> list[dict]:
        """A row for each mode: quality, and seconds of a miss, a hit, a first answer after a restart, and under concurrency."""
        rows = []
        with tempfile.TemporaryDirectory() as folder:
            engine = self.make(os.path.join(folder, "answers.db"))
            for mode in modes:
                row = {"mode": mode} | self.quality(engine, mode)
                for name, times in (("miss", self.misses(engine, mode)), ("hit", self.hits(engine, mode)), ("restart", self.after_restart(mode)), ("together", self.together(mode))):
                    row |= {f"{name}_{k}": v for k, v in times.items()}
                rows.append(row)
        return rows


def best_against_sort(spark: SparkSession, n: int = 50_000, k: int = 10, trials: int = 5) -> dict[str, float]:
    """Median seconds of the best k of n scores by Spark's top-k plan, and by a full sort."""
    scores = spark.range(n).select(F.col("id").alias("doc_id"), F.rand(0).alias("score"))
    ordered = scores.orderBy(F.desc("score"), "doc_id")
    return {"n": n, "k": k, "best": latency(lambda: ordered.limit(k).collect(), trials)["median"], "sorted": latency(lambda: ordered.write.format("noop").mode("overwrite").save(), trials)["median"]}


def save_report(rows: list[dict], json_path: str, text_path: str | None = None) -> None:
    """The rows as JSON, and as a table of text where a second path is given; on the driver's disk."""
    with open(json_path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2)
    if text_path:
        with open(text_path, "w", encoding="utf-8") as f:
            f.write(format_report(rows))


def print_report(rows: list[dict]) -> None:
    print(format_report(rows), end="")
