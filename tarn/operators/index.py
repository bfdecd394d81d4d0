"""The inverted index as tables.

``occurrences`` (doc_id, pos, surface, term, is_stop) holds every word with its position, stop words included; a sentence's
end takes a position, so that phrases don't cross it. ``postings`` groups them by term and document. ``doc_terms`` leaves
stop words out and is what ranking reads; ``vocab`` has document frequencies, ``surfaces`` the words behind each lemma.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T


@dataclass(frozen=True)
class Index:
    documents: DataFrame  # doc_id, title, url, text
    occurrences: DataFrame
    doc_terms: DataFrame  # doc_id, term, tf
    vocab: DataFrame  # term, df
    surfaces: DataFrame  # surface, lemma
    doc_stats: DataFrame  # doc_id, doc_len: of every document
    stats: DataFrame  # total_docs, avg_doc_length, version: one row

    @property
    def postings(self) -> DataFrame:
        """term, doc_id, tf, positions: of all words, by raw stop word or lemma."""
        return self.occurrences.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))

    def has_term(self, term: str) -> bool:
        """Whether any document has the lemma."""
        return not self.vocab.where(F.col("term") == term).isEmpty()

    def has_document(self, doc_id: int) -> bool:
        return not self.doc_stats.where(F.col("doc_id") == doc_id).isEmpty()

    def dump(self, rows: int | None = None) -> DataFrame:
        """The posting lists in order of term and document, all or the first ``rows``."""
        listed = self.postings.orderBy("term", "doc_id")
        return listed if rows is None else listed.limit(rows)

    def save(self, path: str, mode: str = "error") -> None:
        """Tables are written one after another, each from those already written, so that texts are read twice in all.
        Those that are looked up by term are ranged and sorted by it and by document, so that a term's filter reads few row groups and a
        frequent term is dealt to many tasks."""
        spark = self.documents.sparkSession

        def write(name: str, table: DataFrame) -> DataFrame:
            keys = [k for k in ("term", "surface", "doc_id") if k in table.columns]
            if keys[:1] in (["term"], ["surface"]):
                table = table.repartitionByRange(*keys).sortWithinPartitions(*keys)
            table.write.mode(mode).parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        documents = write("documents", self.documents)
        found = write("occurrences", self.occurrences)
        doc_terms = write("doc_terms", _derive(documents, found).doc_terms)
        doc_stats = write("doc_stats", _derive(documents, found, doc_terms).doc_stats)
        rest = _derive(documents, found, doc_terms, doc_stats)
        for name in ("vocab", "surfaces", "stats"):
            write(name, getattr(rest, name))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def with_columns(docs: DataFrame) -> DataFrame:
    """doc_id, title, url and text; what is missing or null is empty, a missing text is the tokens' or stays empty."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    text = has("text")
    if "tokens" in docs.columns:
        text = F.when(text == "", F.coalesce(F.array_join("tokens", " "), F.lit(""))).otherwise(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), has("title").alias("title"), has("url").alias("url"), text.alias("text"))


def spread(docs: DataFrame) -> DataFrame:
    """An input of fewer partitions than cores, which may lie in a single row group, over all cores; any other as its files are split."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per word; places within a document come from the row itself, without a shuffle."""
    items = docs.select("doc_id", F.posexplode(T.index_items(F.col("text"))).alias("pos", "item")).where(~F.substring("item", -1, 1).isin(".", "!", "?"))
    words = items.select("doc_id", "pos", F.lower("item").alias("surface"))
    stop = T.is_stopword(F.col("surface"))
    return words.select("doc_id", "pos", "surface", F.when(stop, F.col("surface")).otherwise(T.lemma_once(F.col("surface"))).alias("term"), stop.alias("is_stop"))


def build_index(docs: DataFrame, index_title: bool = False) -> Index:
    """An index of docs (doc_id, text, and title, url, tokens where there are such), one row per doc_id."""
    docs = spread(with_columns(docs))
    body = docs.withColumn("text", F.concat_ws(" ", "text", "title")) if index_title else docs
    found = occurrences(body)
    lengths = body.select("doc_id", T.index_length(F.col("text")).cast("long").alias("doc_len"))  # a row's own, without a shuffle
    return _derive(docs, found, doc_stats=lengths)


def _derive(docs: DataFrame, found: DataFrame, doc_terms: DataFrame | None = None, doc_stats: DataFrame | None = None) -> Index:
    """All tables from documents and occurrences; those given are used as they are."""
    terms = found.where(~F.col("is_stop"))
    if doc_terms is None:
        doc_terms = terms.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    if doc_stats is None:
        lengths = doc_terms.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
        doc_stats = docs.select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
    hashed = docs.agg(F.format_string("w2-%d-%016x", F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("doc_id", "title", "url", "text")), F.lit(0))).alias("version"))
    stats = doc_stats.agg(F.count("*").alias("total_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_length")).crossJoin(hashed)  # a row each
    return Index(
        documents=docs,
        occurrences=found,
        doc_terms=doc_terms,
        vocab=doc_terms.groupBy("term").agg(F.count("*").alias("df")),
        surfaces=terms.select("surface", F.col("term").alias("lemma")).distinct(),
        doc_stats=doc_stats,
        stats=stats,
    )


def keep_first(docs: DataFrame, order: Column) -> DataFrame:
    """One row per doc_id, the first by ``order``."""
    return docs.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("d")).select("d.*")
