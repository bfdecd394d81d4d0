"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of the row. For every block the number of its rows that go
to each shard is drawn from the multivariate hypergeometric law with the shard sizes as column
sums, so the shards have exactly the sizes asked for and the result is distributed as a uniform
shuffle. Each block is permuted locally and cut by its counts (first exchange), the rows move to
their shards in small buckets (second exchange) and are permuted again there.

Everything on the rows is DataFrame functions; the driver only draws the matrix, of at most
``MAX_BLOCKS`` rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Rows in a block or bucket on average, until the number of blocks reaches its bound.
BLOCK_ROWS = 4096
MAX_BLOCKS = 32_768


def _hypergeometric(random: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Of ``drawn`` rows out of good + bad, how many are good: by inversion of the hypergeometric law, whatever the numbers.

    Probabilities relative to the mode's come from the ratios of neighbouring ones, up to where less than 1e-30 is left.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1)))
    reach = int(12 * spread) + 40
    k = np.arange(mode, min(high, mode + reach), dtype=float)
    up = np.cumprod((good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1)))
    k = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    down = np.cumprod(k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1)))
    sums = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return mode - len(down) + int(np.searchsorted(sums, random.random() * sums[-1], "right"))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with these row and column sums, as a uniform shuffle would give."""
    random, left, out = np.random.Generator(np.random.PCG64(seed)), list(columns), []
    for drawn in rows:
        rest, line = sum(left), []
        for k, good in enumerate(left):
            rest -= good
            got = _hypergeometric(random, good, rest, drawn)
            line.append(got)
            left[k] -= got
            drawn -= got
        out.append(line)
    return out


def _small_table(spark: SparkSession, values: list, schema: T.DataType) -> DataFrame:
    """Driver values as a table, without Python rows in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), T.ArrayType(schema))))


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of ``docs`` with their columns, plus ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    Shard sizes differ by one at most. Equal rows are dealt one by one like any others, and so are
    rows with nulls in any column; rows that are equal in all columns are interchangeable. A column of docs named
    ``shard`` or ``slot`` is replaced. An empty table gives an empty one. The result depends on the
    rows, ``shards`` and ``seed`` only, not on partitions or retries.
    """
    docs = docs.drop("shard", "slot")
    spark = docs.sparkSession
    hashed = [F.to_json(c) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in docs.dtypes]  # these have no hash
    spread = docs.withColumn("__h", F.xxhash64(F.lit(seed), *hashed))
    total = docs.count()
    blocks = max(1, min(MAX_BLOCKS, -(-total // block_rows)))
    spread = spread.withColumn("__block", F.pmod("__h", F.lit(blocks)).cast("int"))
    counts = {r["__block"]: r["count"] for r in spread.groupBy("__block").count().collect()}
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    cuts = [{"__block": b, "__cuts": np.cumsum(line).tolist()} for b, line in enumerate(matrix)]
    dealt = _small_table(spark, cuts, T.StructType().add("__block", T.IntegerType()).add("__cuts", T.ArrayType(T.LongType())))

    def deal(rows: DataFrame) -> DataFrame:
        """Local permutation of each block, then the block's counts; the bucket in the shard is a fresh random one."""
        order = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 1), "__h"), "__h")
        buckets = max(1, -(-sizes[0] // block_rows)) if shards * -(-sizes[0] // block_rows) <= MAX_BLOCKS else MAX_BLOCKS // shards
        return (
            rows.withColumn("__rank", F.row_number().over(order) - 1)
            .join(F.broadcast(dealt), "__block")
            .withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__rank"))).cast("int"))
            .withColumn("__key", F.xxhash64(F.lit(seed + 2), "__h"))
            .withColumn("__bucket", F.pmod(F.shiftrightunsigned("__key", 20), F.lit(buckets)).cast("int"))
            .drop("__cuts", "__rank", "__block")
        )

    in_bucket = deal(spread.select("__h", "__block")).groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_bucket.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    again = Window.partitionBy("shard", "__bucket").orderBy("__key", "__h")
    return (
        deal(spread)
        .join(F.broadcast(starts), ["shard", "__bucket"])  # MAX_BLOCKS rows at most
        .withColumn("slot", (F.col("__start") + F.row_number().over(again) - 1).cast("long"))
        .select(*docs.columns, "shard", "slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
