"""Streams: a folder of JSON-line documents into index tables, and feedback events into session state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.index import build_index
from tarn.sources.corpus import SCHEMA, typed


def stream_documents(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw documents of a folder that grows."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def index_stream(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's occurrences and document terms go to ``path``/<table>/batch=<id>. A batch that is run again
    overwrites its own folder, so every document is indexed once. Document frequencies are counted when read."""

    def write(batch: DataFrame, number: int) -> None:
        index = build_index(typed(batch))
        for name in ("documents", "occurrences", "doc_terms", "doc_stats"):
            getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/doc_terms").groupBy("term").agg(F.count("*").alias("df"))


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per window and type; events later than ``late`` are left out of a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
