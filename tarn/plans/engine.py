"""The search engine: one query through candidates, scores, top-k, MMR, snippets, cache and feedback."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions.words import MMR_LAMBDA, MMR_POOL, STOPWORD_DOCS, STOPWORD_NOTICE
from tarn.operators import ranking
from tarn.operators.diversify import mmr_rerank
from tarn.operators.feedback import boosts, personalise
from tarn.operators.index import Index
from tarn.operators.query import matching_documents, parse, query_terms

from .cache import CacheManager, cache_key


@dataclass(frozen=True)
class SearchResults:
    rows: tuple[dict, ...] = ()
    notice: str | None = None

    def __iter__(self):
        return iter(self.rows)

    def __len__(self):
        return len(self.rows)


@dataclass(frozen=True)
class Feedback:
    """What a session has told: documents marked relevant, and the term boosts that they give."""

    marked: frozenset[int] = frozenset()
    boosts: dict[str, float] = field(default_factory=dict)


class SearchEngine:
    """Over an index whose tables are read anew for every query; ``index`` may be saved tables or a lazy build.

    What scores, reranks, turns marks into boosts and makes a result of a row can be replaced: ``score``, ``rerank`` and ``boost`` have the
    signatures of ``ranking.score``, ``mmr_rerank`` and ``feedback.boosts``. Feedback is kept by session id in ``feedback``, any mapping.
    """

    def __init__(
        self, index: Index, cache_capacity: int = 100, cache_path: str | None = None, feedback: MutableMapping[str, Feedback] | None = None, mmr_pool: int = MMR_POOL, mmr_lambda: float = MMR_LAMBDA,
        score: Callable = ranking.score, rerank: Callable = mmr_rerank, boost: Callable = boosts, make_result: Callable[[dict], object] = dict,
    ):
        self.feedback, self.mmr_pool, self.mmr_lambda = {} if feedback is None else feedback, mmr_pool, mmr_lambda
        self._score, self._rerank, self._boost, self._make_result = score, rerank, boost, make_result
        self._capacity, self._path, self._lock = cache_capacity, cache_path, threading.Lock()
        self.reload(index)

    def open_session(self) -> str:
        with self._lock:
            self.feedback[new := uuid.uuid4().hex] = Feedback()
        return new

    def feedback_of(self, session_id: str | None) -> Feedback:
        """A session's feedback, empty for one that has given none."""
        return self.feedback.get(session_id or "", Feedback())

    def close_session(self, session_id: str) -> bool:
        with self._lock:
            return self.feedback.pop(session_id, None) is not None

    def reload(self, index: Index) -> None:
        self.index = index
        self.total_docs, self.avg_doc_length, self.version = index.stats.select("total_docs", "avg_doc_length", "version").first()
        self.cache = CacheManager(self._capacity, self._path, self.version) if self._capacity > 0 else None
        self.cache_hits = self.cache_misses = 0
        self._frequencies: dict[str, int] = {}

    def document_frequency(self, term: str) -> int:
        """Documents with a lemma, remembered for as long as the index stays."""
        if term not in self._frequencies:
            row = self.index.vocab.where(F.col("term") == term).select("df").first()
            self._frequencies[term] = row.df if row else 0
        return self._frequencies[term]

    def clear_cache(self) -> None:
        if self.cache:
            self.cache.clear()

    def stats(self) -> dict:
        return {"index_version": self.version, "total_docs": self.total_docs, "cache_entries": len(self.cache) if self.cache else 0, "cache_hits": self.cache_hits, "cache_misses": self.cache_misses}

    def plan(self, query: str, mode: str = "bm25", k: int = 10, use_mmr: bool = False, boosted: dict[str, float] | None = None, strict_parity: bool = False) -> DataFrame:
        """(rank, doc_id, score, title, url, snippet) as one lazy plan."""
        parsed, index = parse(query), self.index
        spark = index.documents.sparkSession
        one = lambda df: df.select(F.lit(0).cast("long").alias("query_id"), "*")
        if parsed.stopwords_only:
            best = index.documents.select("doc_id", F.lit(0.0).alias("score")).orderBy("doc_id").limit(min(k, STOPWORD_DOCS))
        else:
            found = one(matching_documents(index, parsed, overlap=strict_parity))
            terms = one(self._raw_terms(query) if strict_parity else query_terms(index, parsed))
            if boosted:
                extra = spark.createDataFrame([(0, t, float(b)) for t, b in boosted.items()], "query_id long, term string, weight double")
                terms = personalise(index, terms, extra)
            scores = self._score(index, found, terms, mode)
            best = ranking.top_k(scores, max(self.mmr_pool, k) if use_mmr else k)
            if use_mmr:
                pool = ranking.top_k_per_query(best.select("query_id", "doc_id", "score"), max(self.mmr_pool, k)).withColumnRenamed("rank", "pool_rank")
                chosen = self._rerank(pool, ranking.document_vectors(index, found, terms), ranking.query_vectors(index, terms), k, self.mmr_lambda)
                best = best.join(chosen.select("doc_id"), "doc_id", "left_semi")
            best = best.select("doc_id", "score")
        numbered = ranking.top_k_per_query(one(best), k)
        shown = index.documents.join(F.broadcast(numbered), "doc_id")  # k rows
        text = T.snippet(F.col("text"), T.score_terms_of(query))
        return shown.select("rank", "doc_id", "score", "title", "url", text.alias("snippet")).orderBy("rank")

    def _raw_terms(self, query: str) -> DataFrame:
        """Scoring terms as typed, not lemmatised: those that are no lemma score nothing."""
        counts: dict[str, int] = {}
        for t in T.score_terms_of(query):
            counts[t] = counts.get(t, 0) + 1
        rows = self.index.vocab.sparkSession.createDataFrame(list(counts.items()), "term string, qtf int")
        return self.index.vocab.join(F.broadcast(rows), "term").select("term", "df", "qtf")

    def search(self, query: str, session_id: str | None = None, mode: str = "bm25", k: int = 10, use_mmr: bool = False) -> SearchResults:
        mode = ranking.parse_ranking_mode(mode).value
        if not isinstance(k, int) or k <= 0 or not T.score_terms_of(query or ""):
            return SearchResults()
        boosted = self.feedback_of(session_id).boosts
        personal = bool(boosted)
        key = None if personal or self.cache is None else cache_key(query, mode, k, use_mmr, self.version)
        if key is not None and (found := self.cache.get(key)) is not None:
            with self._lock:
                self.cache_hits += 1
            return SearchResults(tuple(map(self._make_result, found)))
        with self._lock:
            self.cache_misses += 1
        rows = self.plan(query, mode, k, use_mmr, boosted if personal else None).collect()
        notice = STOPWORD_NOTICE if parse(query).stopwords_only else None
        plain = [r.asDict() for r in rows]
        if key is not None and notice is None:
            self.cache.put(key, plain)
        return SearchResults(tuple(map(self._make_result, plain)), notice)

    def mark_relevant(self, session_id: str, doc_id: int) -> bool:
        """Adds a document to a session's relevant ones; False, and nothing is kept, if it gives no terms."""
        if not session_id or not session_id.strip():
            raise ValueError("a session id is needed")
        if self.index.doc_terms.where(F.col("doc_id") == doc_id).isEmpty():
            return False
        marked = self.feedback_of(session_id).marked | {doc_id}
        rows = self.index.doc_terms.sparkSession.createDataFrame([(0, d) for d in sorted(marked)], "session_id long, doc_id long")
        found = {r.term: r.weight for r in self._boost(self.index, rows).collect() if r.weight > 0}
        if not found:
            return False
        with self._lock:
            self.feedback[session_id] = Feedback(marked, found)
        return True

    def reset_feedback(self, session_id: str) -> None:
        with self._lock:
            if session_id in self.feedback:
                self.feedback[session_id] = Feedback()
