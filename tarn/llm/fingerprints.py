"""Document fingerprints by MinHash, and matches through signature bands with exact Jaccard.

A fingerprint is a MinHash signature over word shingles: for each of ``SIZE`` universal hashes 16 bits
that stand for the smallest hashed shingle, as hex. The share of equal places of two fingerprints estimates
the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, map_arrow, table
from .near_dedup import band_hashes, shingle_sets
from .shingles import MinHash, mix

SIZE = 128
WIDTH = 5
#: Bands of the match join: a pair at 0.8 is missed with probability 4e-8.
BANDS = 32
#: Ranges of document ids that ``with_next`` streams; their first rows are held by the driver.
MOST_RANGES = 40_000
RANGE_ROWS = 2000


class Fingerprinter:
    def __init__(self, size: int = SIZE, width: int = WIDTH):
        self.minhash, self.width = MinHash(size, seed=3), width

    def places(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for items in shingle_sets(pa.array(texts, pa.large_string()), self.width):
            least = self.minhash.of(items).astype(np.uint64)
            out.append((mix(least) >> np.uint64(48)).astype(">u2"))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _even_cells(docs: DataFrame, rows: int) -> tuple[Column, dict[int, int]]:
    """A number for each row's cell, ascending as doc_id falls, and the rows of each cell: cells of more than ``rows`` rows are cut into cells
    of equal width between their own first and last id, again and again, so that far-off ids don't matter. Null ids have a cell at the end."""
    falling = -F.col("doc_id").cast("double")
    cell, sizes = F.when(F.col("doc_id").isNotNull(), F.lit(0)), {}
    for _ in range(12):
        found = {r["cell"]: r for r in docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(falling).alias("low"), F.max(falling).alias("high")).collect()}
        missing = found.pop(None, None)
        sizes = {c: r["n"] for c, r in found.items()}
        heavy = {c for c, r in found.items() if r["n"] > rows and r["low"] < r["high"]}
        if not heavy:
            break
        cuts, at = [], 0
        for c in range(max(found) + 1):
            parts = 4 * -(-sizes[c] // rows) if c in heavy else 1
            cuts.append({"at": at, "low": found[c]["low"] if c in heavy else 0.0, "step": parts / (found[c]["high"] - found[c]["low"]) if c in heavy else 0.0, "last": parts - 1})
            at += parts
        table = F.from_json(F.lit(json.dumps(cuts)), "array<struct<at:int,low:double,step:double,last:int>>")
        own = lambda name, table=table, cell=cell: F.element_at(table, cell + 1)[name]
        cell = (own("at") + F.least(own("last"), F.floor((falling - own("low")) * own("step")))).cast("int")
    end = max(sizes, default=-1) + 1
    if missing is not None:
        sizes[end] = missing["n"]
    return F.coalesce(cell, F.lit(end)), sizes


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) sorted by descending doc_id within ``range``, each range followed by a row with
    ``after`` = 1: the first of the next range, and of the first range after the last.

    Rows with the same doc_id follow by a hash of their text, rows without an id come last. Ranges hold about as many rows
    each, whatever the ids, unless one id has more; a range is streamed.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.count()
    ranges = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    cell, sizes = _even_cells(docs, max(1, -(-total // (4 * ranges))))
    to, seen = [], 0
    for k in range(max(sizes, default=0) + 1):
        to.append(min(ranges - 1, seen * ranges // max(1, total)))
        seen += sizes.get(k, 0)
    numbers = F.from_json(F.lit(json.dumps(to)), "array<int>")
    placed = docs.withColumns({"range": F.element_at(numbers, cell + 1), "tie": F.xxhash64("text")})
    firsts = placed.groupBy("range").agg(F.max(F.struct(F.coalesce(F.col("doc_id").isNotNull(), F.lit(False)).alias("named"), "doc_id", "tie")).alias("f")).collect()
    firsts = sorted((r["range"], r["f"]["doc_id"], r["f"]["tie"]) for r in firsts)
    heads = [{"range": r, "head": i, "head_tie": t, "before": firsts[k - 1][0]} for k, (r, i, t) in enumerate(firsts)]
    kind = "array<struct<range:int,head:bigint,head_tie:bigint,before:int>>"
    head = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(heads)), kind)))
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct(F.col("range"), F.lit(0).alias("after"))
    copies = F.when(is_head, F.array(own, F.struct(F.col("before").alias("range"), F.lit(1).alias("after")))).otherwise(F.array(own))
    spread = placed.join(F.broadcast(head), "range").select("doc_id", "text", "tie", F.explode(copies).alias("to"))  # MOST_RANGES rows
    spread = spread.select("doc_id", "text", "tie", "to.range", "to.after")
    return spread.repartition("range").sortWithinPartitions("range", "after", F.desc_nulls_last("doc_id"), F.desc("tie")).select("doc_id", "text", "range", "after")


_COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document by descending doc_id (after the last: the first; a lone document follows itself). A null text is empty
    and has the fingerprint of the empty set, which is like that of no other set. Repeated rows get a row each;
    extra columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, held = Fingerprinter(), None  # held: the row before, whose next isn't known yet
        for batch in batches_of(batches, 256):
            ids, texts, ranges, after = (batch.column(k).to_pylist() for k in range(4))
            rows = list(zip(ids, texts, ranges, after, maker.places(texts), strict=True))
            rows = [held, *rows] if held else rows
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
            out = [
                (a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), a[4].tobytes().hex(), x.tobytes().hex(), likeness(a[4], x), likeness(a[4], b[4]))
                for (a, b), e, x in zip(pairs, edited, maker.places(edited), strict=True)
            ]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", *(x.split()[0] for x in _COMPARED.split(", "))])

    return map_arrow(with_next(docs), compare, f"doc_id {kind}, {_COMPARED}")


def near_matches(queries: DataFrame, docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(query_id, doc_id, jaccard) of the documents that are similar to a stated set of queries, both (doc_id, text).

    Documents with the same text are matched once and joined back; a document is no match of itself. Bands of the signatures
    are joined in Spark, then the shingle sets of the whole texts are compared. Null ids and texts without a word match nothing.
    """

    def banded(df: DataFrame) -> DataFrame:
        def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            minhash = MinHash(SIZE, seed=3)
            for batch in batches_of(batches, 1024):
                keep, bands = [], []
                for k, items in enumerate(shingle_sets(batch.column(1), WIDTH)):
                    if len(items):
                        keep.append(k)
                        bands.append(band_hashes(minhash.of(items), BANDS))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["id", "bands"])

        return map_arrow(df, band, "id long, bands array<bigint>").select("id", F.explode("bands").alias("band"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            out = []
            a, b = (shingle_sets(batch.column(k), WIDTH) for k in (1, 3))
            for q, d, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), a, b, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and common >= similarity * (len(x) + len(y) - common):
                    out.append((q, d, common / (len(x) + len(y) - common)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rep", "jaccard"])

    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("key"))
    reps = named.groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = named.select("doc_id", "key").join(reps, "key").select("rep", "doc_id").distinct()
    texts = named.join(reps, (named.key == reps.key) & (named.doc_id == reps.rep)).select("rep", F.col("text").alias("doc_text")).dropDuplicates(["rep"])
    asked = queries.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("query_id"), F.col("text").alias("query_text")).dropDuplicates(["query_id"])
    pairs = banded(asked.select("query_id", "query_text")).withColumnRenamed("id", "query_id").join(banded(texts.select("rep", "doc_text")).withColumnRenamed("id", "rep"), "band")
    pairs = pairs.select("query_id", "rep").distinct().join(asked, "query_id").join(texts, "rep").select("query_id", "query_text", "rep", "doc_text")
    found = map_arrow(pairs, verify, "query_id long, rep long, jaccard double")
    return found.join(members, "rep").where("doc_id <> query_id").select("query_id", "doc_id", "jaccard")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def fingerprint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are similar to those whose id is divisible by 100: bands of fingerprints joined, Jaccard on whole texts."""
    docs = table(spark, sf_dir, "documents")
    return near_matches(docs.where("doc_id % 100 = 0"), docs).select("query_id", "doc_id", F.round("jaccard", 6).alias("jaccard"))


MATCHES_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words WHERE len(w) > 0
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
)
SELECT q.doc_id AS query_id, d.doc_id, round(count(*) / (q.n + d.n - count(*)), 6) AS jaccard
FROM items q JOIN items d ON q.item = d.item AND q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id
GROUP BY q.doc_id, d.doc_id, q.n, d.n HAVING count(*) >= 0.8 * (q.n + d.n - count(*))
"""
