"""The corpus pipeline: language, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; other columns of ``docs`` are dropped. Decisions are made on rows, not on ids: rows
without an id, or that share one, are judged by their own text like any others. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import language_id, near_dedup, packing, quality, secret_scan
from tarn.llm.common import fewer_files, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; a stage's input is a table of files, and its splits are read in tasks of a useful size."""
    return fewer_files(docs.select(*COLUMNS))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; null texts, texts without a letter and ambiguous ones go. Repeated rows stay or go
    together. Rows with a null language are not learned from; where none has a language, all rows go."""
    docs = _documents(docs)
    judged = language_id.identify(docs, language_id.train(docs, ~language_id.held_out()), list(COLUMNS))
    return judged.where("lang_pred <> 'und' and not ambiguous").select(*COLUMNS)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by its own text, language and source; nulls of these are groups of their own. Null
    and short texts go, repeated rows stay or go together."""
    return quality.keep_good(_documents(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (shingles of five words, a similarity of 0.8 or more): that with the smallest doc_id, rows without one
    last, ties by a hash of the text; of repeated rows one. Texts without a word, and null ones, all stay."""
    return near_dedup.one_of_each_class(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in their texts and ``n_chars`` counted again; a null text stays null, with a null count. A null source says nothing."""
    docs = _documents(docs)
    model = secret_scan.train(secret_scan.labelled_findings(spark), secret_scan.dictionary(docs))
    masked = secret_scan.redact(docs, model)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of at most 4096; every row has one at least, also with a null or empty text."""
    import public_tokenizers

    return packing.pieces_digest(packing.pack_documents(_documents(docs), public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", by_language),
    ("quality_rules", by_quality),
    ("near_dedup", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Language codes, forests and packing are out of SQL's reach; the stages are tested one by one against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
