"""Corpus files: JSON lines, arrays, pretty-printed or concatenated objects; seeds; labelled queries; sinks."""

from __future__ import annotations

import importlib
import json
import os
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.text import clean_control

META = "struct<crawled_at:string,content_length:string,status:string,depth:string>"
SCHEMA = f"doc_id string, url string, title string, text string, tokens array<string>, token_segments array<array<string>>, meta {META}"
DOCUMENT = "struct<doc_id:bigint,url:string,title:string,text:string,tokens:array<string>,meta:struct<crawled_at:timestamp,content_length:int,status:string,depth:int>>"


def read_documents(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Documents of JSON files: ``lines``, one ``array`` or object a file, or ``objects`` that follow one another in any
    shape. Rows without a readable doc_id are left out; of rows with the same doc_id the first by text stays."""
    if layout == "lines":
        raw = spark.read.schema(SCHEMA).json(path)
    elif layout == "array":
        raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    elif layout == "objects":
        raw = spark.read.text(path, wholetext=True).mapInPandas(_split_objects, "object string").select(F.from_json("object", SCHEMA, {"allowUnquotedControlChars": "true"}).alias("d")).select("d.*")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return typed(raw)


def _split_objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    decoder = json.JSONDecoder(strict=False)
    for batch in batches:
        out = []
        for text in batch.iloc[:, 0]:
            at = 0
            while (at := text.find("{", at)) >= 0:
                try:
                    value, at = decoder.raw_decode(text, at)
                    out.append(json.dumps(value))
                except ValueError:
                    at += 1
        yield pd.DataFrame({"object": out})


def typed(raw: DataFrame) -> DataFrame:
    """The typed document columns of raw string ones; junk numbers are 0, control characters spaces."""
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0))
    empty = F.coalesce
    rows = raw.select(
        F.expr("try_cast(doc_id as bigint)").alias("doc_id"), empty("url", F.lit("")).alias("url"), empty("title", F.lit("")).alias("title"),
        clean_control(empty("text", F.lit(""))).alias("text"), empty("tokens", F.expr("cast(array() as array<string>)")).alias("tokens"),
        F.struct(F.expr("try_cast(meta.crawled_at as timestamp)").alias("crawled_at"), number("meta.content_length").alias("content_length"), empty("meta.status", F.lit("")).alias("status"), number("meta.depth").alias("depth")).alias("meta"),
    )
    named = rows.where("doc_id is not null and doc_id <> -1")
    return named.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.struct("text", "url")).alias("d")).select("d.*")


def read_simple_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, url, text) of ``[{id, title, url, text}]`` or ``{"documents": [...]}``."""
    part = "struct<id:bigint,title:string,url:string,text:string>"
    raw = spark.read.text(path, wholetext=True)
    docs = F.when(F.regexp_like("value", F.lit(r"^\s*\{")), F.from_json("value", f"struct<documents:array<{part}>>")["documents"]).otherwise(F.from_json("value", f"array<{part}>"))
    return raw.select(F.inline(docs)).select(F.col("id").alias("doc_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url", "text")))


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url): lines without comments and blanks."""
    return spark.read.text(path).select(F.btrim(F.split("value", "#")[0]).alias("url")).where("url <> ''")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_docs, description) of a JSON list or ``{"queries": [...]}``."""
    part = "struct<query:string,relevant_docs:array<bigint>,description:string>"
    raw = spark.read.text(path, wholetext=True)
    rows = F.when(F.regexp_like("value", F.lit(r"^\s*\{")), F.from_json("value", f"struct<queries:array<{part}>>")["queries"]).otherwise(F.from_json("value", f"array<{part}>"))
    return raw.select(F.posexplode(rows).alias("query_id", "q")).select("query_id", "q.*")


def query_by_text(queries: DataFrame, text: str) -> DataFrame:
    return queries.where(F.lower(F.btrim("query")) == text.strip().lower())


def to_records(docs: DataFrame) -> DataFrame:
    """(value): a JSON line per document, fields in the contract's order, section breaks as spaces."""
    text = F.translate("text", "\x00", " ")
    fields = [c for c in ("doc_id", "url", "title", "text", "tokens", "token_segments", "meta") if c in docs.columns]
    doc_id = F.when(F.col("doc_id").cast("string").rlike("^[0-9]{1,5}$"), F.format_string("%06d", F.col("doc_id").cast("long"))).otherwise(F.col("doc_id").cast("string"))
    return docs.withColumns({"text": text, "doc_id": doc_id}).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    to_records(docs).write.mode(mode).text(path)


def synthetic_corpus(spark: SparkSession, seed: int = 7, topics: int = 10, subtopics: int = 4, docs_each: int = 6) -> tuple[DataFrame, DataFrame]:
    """A small labelled corpus (doc_id, title, url, text) and its queries (query_id, query, relevant_docs): a topic's
    sub-topics have words of their own, and the query for a sub-topic asks for its documents."""
    rnd, docs, queries = random.Random(seed), [], []
    word = lambda: "".join(rnd.choice(c) for c in ("bdgklmnprst", "aeiou", "bdgklmnprst", "aeiou", "klmnr"))
    common = [word() for _ in range(60)]
    for topic in range(topics):
        shared = [word() for _ in range(8)]
        for sub in range(subtopics):
            own = [word() for _ in range(6)]
            first = len(docs)
            for _ in range(docs_each):
                words = rnd.choices(own, k=14) + rnd.choices(shared, k=12) + rnd.choices(common, k=24)
                rnd.shuffle(words)
                docs.append((len(docs), f"{shared[0]} {own[0]}", f"http://example.com/{topic}/{sub}/{len(docs)}", " ".join(words)))
            queries.append((len(queries), f"{shared[0]} {own[0]} {own[1]}", list(range(first, len(docs)))))
    return spark.createDataFrame(docs, "doc_id long, title string, url string, text string"), spark.createDataFrame(queries, "query_id long, query string, relevant_docs array<long>")


class BackendError(ValueError):
    """A backend gave no usable documents."""


def checked(docs: object) -> DataFrame:
    """A backend's documents as (doc_id long, title, url, text): the columns must be there and convertible, missing title and url are empty.
    Rows whose doc_id is no number are an error when they are read."""
    if not isinstance(docs, DataFrame):
        raise BackendError(f"a DataFrame is needed, not {type(docs).__name__}")
    if missing := {"doc_id", "text"} - set(docs.columns):
        raise BackendError(f"columns are missing: {', '.join(sorted(missing))}")
    for name in ("doc_id", "title", "url", "text"):
        if name in docs.columns and isinstance(docs.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise BackendError(f"column {name} is of type {docs.schema[name].dataType.simpleString()}")
    text = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("title"), text("url"), text("text"))


def load_backend(name: str):
    """An object, or what a factory of that name makes: ``module`` (its ``create_backend``) or ``module:attribute``."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute or "create_backend")
    return found() if callable(found) else found


def corpus_from(spark: SparkSession, backend: str | None = None, corpus: str | None = None) -> DataFrame:
    """Documents by precedence: a backend, a corpus file, the synthetic corpus; names fall back to TARN_BACKEND and TARN_CORPUS."""
    backend, corpus = backend or os.environ.get("TARN_BACKEND"), corpus or os.environ.get("TARN_CORPUS")
    if backend:
        try:
            return checked(load_backend(backend))
        except (ImportError, AttributeError) as e:
            raise BackendError(f"backend {backend!r}: {e}") from e
    return read_documents(spark, corpus) if corpus else synthetic_corpus(spark)[0]


def result_json(results: DataFrame) -> DataFrame:
    """(value): search results as JSON, scores rounded to six places."""
    rounded = [F.round(c, 6).alias(c) if isinstance(results.schema[c].dataType, T.DoubleType) else F.col(c) for c in results.columns]
    return results.select(F.to_json(F.struct(*rounded)).alias("value"))
