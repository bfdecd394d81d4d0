"""What several operators share: shared-folder tables and Arrow text access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarn.tables import clear_tables, fewer_files, materialise, shared_dir, table_path  # noqa: F401  for the operators

#: Bytes of text that the vectorised passes work on at once; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 19
#: Rows and bytes in an Arrow batch; rows of a Parquet batch, whose texts are held in one array each.
ARROW_ROWS, ARROW_BYTES, PARQUET_ROWS = 1024, 16 << 20, 1024
_BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS,
    "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES,
    "spark.sql.parquet.columnarReaderBatchSize": PARQUET_ROWS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of ARROW_ROWS rows and about ARROW_BYTES at most, as texts can be long. The bounds are settings of the session,
    lowered where they are higher."""
    conf = df.sparkSession.conf
    for name, most in _BOUNDS.items():
        now = conf.get(name).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(function, schema)


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and the n + 1 offsets into them; a null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        sizes = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        keep = np.repeat(np.asarray(column.is_valid()), np.diff(offsets))
        data = data[offsets[0] : offsets[-1]][keep] if len(keep) else data[:0]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes; at least a row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(last, n)
        row = min(last, n)


def batches_of(rows: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``."""
    for batch in rows:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
