"""Saved indexes: built once for a table of documents and asked often."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.index import Index, build_index
from tarn.tables import table_path

_SAVED: dict[tuple, str] = {}


def files_stamp(docs: DataFrame) -> tuple:
    """Number and a hash of names, sizes and times of the files behind a table, from their metadata alone."""
    files = docs.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    return tuple(files.agg(F.count("*"), F.bit_xor("f")).first())


def index_of(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "text")) -> Index:
    """The index of the documents at ``path``, a table of files: built and saved in the shared folder where this application
    has none yet for these files as they are, else opened. An empty table has an index too."""
    docs = spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path, columns, files_stamp(docs))
    if key not in _SAVED:
        place = table_path(spark, "index")
        build_index(docs.select(*columns)).save(place)
        _SAVED[key] = place
    return Index.open(spark, _SAVED[key])
