"""MinHash near-duplicate classes with odd sketches and exact confirmation.

1. One pass over the texts gives each row its set of hashed word shingles, a MinHash signature, band
   hashes of it and an odd sketch: the signature's (position, value) pairs folded into a parity bitmap. Of
   two sketches the XOR's population count estimates how many pairs differ, and so a high similarity, precisely.
2. Rows with the same set are one node of the graph; a group of copies is never expanded.
3. Hub rounds: in each band bucket every node is paired with one node of the bucket, the hub, so that there are as many pairs as
   rows. Pairs whose sketches or set sizes rule out the threshold are dropped, the others are compared on their
   full shingle sets; a hub's set travels once for each ``hub_nodes`` of its pairs. Linked nodes get one label.
   Most buckets then have one label and are done; those with several have another round with another hub.
4. What is left is compared exhaustively: in a bucket with several labels, the nodes outside its largest label meet all
   nodes of other labels, in parts of at most ``part_nodes`` against ``part_nodes``; sketches first, each pair in
   the first bucket that it shares, and then the sets of nodes that have a partner by their sketches. Only a spanning forest of the links leaves a task.
5. The classes are the components of all links; their id is the smallest document id.

With the default bands a pair at the threshold of 0.8 is missed by all buckets with probability 3e-6
(0.85: 7e-9) and then often joined through others; the sketch limit lies beyond five standard errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, chunks, map_arrow, materialise, table, utf8_parts
from .graph import connected_components
from .shingles import MinHash, mix, shingles, words


@dataclass(frozen=True)
class NearDedup:
    width: int = 5  # words in a shingle
    percent: int = 80  # smallest Jaccard similarity of a link
    bands: int = 32
    rows: int = 5
    sketch_bits: int = 512
    hub_rounds: int = 1  # a node meets a hub in each of its buckets
    #: Nodes of a part that meets a hub in one task, nodes of a part that meets another part, and the shingles in it on average.
    hub_nodes: int = 128
    part_nodes: int = 1024
    part_shingles: int = 1_000_000

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def most_flips(self) -> int:
        """Largest XOR population count of two sketches that may still be linked: five standard errors above the threshold's."""
        k, j, n = self.size, self.percent / 100, self.sketch_bits
        differing = 2 * k * (1 - j) + 2 * 5 * (k * j * (1 - j)) ** 0.5
        flips = n * (1 - np.exp(-2 * differing / n)) / 2
        return int(flips + 2 * flips**0.5)


def estimated_jaccard(flips: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Similarity of two sets from the XOR population count of their odd sketches."""
    return 1 + bits / (4 * size) * np.log(np.maximum(1e-9, 1 - 2 * np.asarray(flips) / bits))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, ASCII letters lower-cased."""
    data, offsets = utf8_parts(column)
    out = []
    for a, b in chunks(offsets):
        found, at = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1], lower=True), width)
        out += [np.unique(found[at[k] : at[k + 1]]) for k in range(b - a)]
    return out


def set_key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """The parity bitmap as int64 words."""
    at = mix(signature.astype(np.uint64) + (np.arange(len(signature), dtype=np.uint64) << np.uint64(32))) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.int64)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.astype(np.uint64).reshape(bands, -1)
    h = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(parts.shape[1]):
        h = mix(h ^ (parts[:, k] * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k)))
    return h.view(np.int64)


def signatures(docs: DataFrame, s: NearDedup) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key, bands and sketch; the last three are null for an empty set."""
    many = T.ArrayType(T.LongType())
    schema = docs.select("doc_id").schema.add("text_key", "long").add("n_shingles", "long").add("set_key", "binary").add("bands", many).add("sketch", many)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, longs = MinHash(s.size), pa.list_(pa.int64())
        for batch in batches_of(batches, 2048):
            n, keys, bands, sketches = [], [], [], []
            for items in shingle_sets(batch.column(2), s.width):
                n.append(len(items))
                signature = minhash.of(items) if len(items) else None
                keys.append(set_key(items) if len(items) else None)
                bands.append(band_hashes(signature, s.bands) if len(items) else None)
                sketches.append(odd_sketch(signature, s.sketch_bits) if len(items) else None)
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], schema.names)

    return map_arrow(docs.select("doc_id", _text_key().alias("text_key"), F.col("text").alias("__text")), sign, schema)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _flips(a: str, b: str, s: NearDedup) -> Column:
    """XOR population count of two sketches, with the columns of Spark."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(s.sketch_bits // 64)), F.lit(0))


def _sizes_allow(a: str, b: str, s: NearDedup) -> Column:
    return 100 * F.least(a, b) >= s.percent * F.greatest(a, b)


def shingle_tables(docs: DataFrame, nodes: DataFrame, s: NearDedup) -> DataFrame:
    """node and items (its sorted shingle set, 64-bit) of ``nodes`` (node, first, set_key), from the texts that they stand for."""
    wanted = nodes.select("node", "set_key", F.col("first.text_key").alias("__key"), F.col("first.doc_id").alias("__id"))
    found = docs.join(wanted.hint("shuffle_hash"), (_text_key() == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))

    def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows lie in one partition
        for batch in batches_of(batches, 256):
            sets = shingle_sets(batch.column(2), s.width)
            rows = enumerate(zip(batch.column(0).to_pylist(), sets, batch.column(1).to_pylist(), strict=True))
            mine = [k for k, (node, x, key) in rows if set_key(x) == key and not (node in seen or seen.add(node))]  # else a text with the same hash
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine, pa.int64())), pa.array([sets[k].tobytes() for k in mine], pa.binary())], ["node", "items"])

    return map_arrow(found.select("node", "set_key", "text"), items_of, "node long, items binary")


def _linked(own: np.ndarray, others: list[np.ndarray], s: NearDedup) -> np.ndarray:
    """Which of the sorted sets are similar enough to one."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    common = np.add.reduceat((own[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= s.percent * (len(own) + sizes - common)


def _by_group(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], handle: Callable[[list[tuple]], list[tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
    """Two long columns that ``handle`` makes of each group's rows (tuples of ``columns``); a group is bounded by how keys were dealt."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            made = np.array(handle(held) if held else [], np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], list(names))

        for batch in batches_of(batches, 256):
            lists = [c.to_pylist() for c in batch.columns]
            for row in zip(*lists, strict=True):
                if row[: len(keys)] != now:
                    yield close()
                    now = row[: len(keys)]
                held.append(row[len(keys) :])
        yield close()

    return map_arrow(dealt, run, f"{names[0]} long, {names[1]} long")


def hub_links(pairs: DataFrame, sets: DataFrame, s: NearDedup) -> DataFrame:
    """(src, dst): the linked ones of distinct pairs (node, hub, n_shingles); each part of a hub's pairs is a task's group."""
    parts = pairs.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / s.hub_nodes), F.ceil(F.sum("n_shingles") / s.part_shingles)).alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", F.lit(1).alias("member"))
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(0).alias("member"))

    def compare(held: list[tuple]) -> list[tuple[int, int]]:
        if held[0][1]:
            return []  # cannot be: each part has its hub
        hub, own = held[0][0], np.frombuffer(held[0][2], np.uint64)
        members = {node: np.frombuffer(items, np.uint64) for node, member, items in held if member}
        return [(node, hub) for node, ok in zip(members, _linked(own, list(members.values()), s), strict=True) if ok] if members else []

    return _by_group(dealt.unionByName(hubs).join(sets, "node"), ["hub", "part"], ["member"], ["node", "member", "items"], compare, ("src", "dst"))


def _met(rows: DataFrame, s: NearDedup, with_sets: bool = True) -> DataFrame:
    """rows (bucket, node, label, n_shingles, apart) copied to the tasks (bucket, part, other) in which a part of the nodes with ``apart``
    meets a part of the bucket's nodes; side 0 asks, side 1 answers."""
    shingles_in = lambda c: F.sum(F.when(c, F.col("n_shingles"))) if with_sets else F.lit(0)
    size = lambda c: F.greatest(F.ceil(F.count_if(c) / s.part_nodes), F.ceil(shingles_in(c) / s.part_shingles), F.lit(1)).cast("long")
    counts = rows.groupBy("bucket").agg(size(F.col("apart")).alias("asking"), size(F.lit(True)).alias("answering"))
    rows = rows.join(counts, "bucket")
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    asking = rows.where("apart").withColumns({"side": F.lit(0), "part": own("asking")}).withColumn("other", F.explode(up_to("answering")))
    answering = rows.withColumns({"side": F.lit(1), "other": own("answering")}).withColumn("part", F.explode(up_to("asking")))
    return asking.unionByName(answering).drop("asking", "answering")


def exhaustive_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, s: NearDedup) -> DataFrame:
    """(src, dst) labels linked by a pair of nodes of the same bucket: rows are (bucket, node, label, apart), for every pair of
    labels of a bucket the nodes of one at least are ``apart``."""

    def stack(column: list) -> np.ndarray:
        return np.array(column, np.int64)

    def near(asking: tuple, labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        _, label, n, sketch = asking[:4]
        fits = (labels != label) & (100 * np.minimum(sizes, n) >= s.percent * np.maximum(sizes, n))
        return fits & (np.bitwise_count((sketches ^ np.array(sketch, np.int64)).view(np.uint64)).sum(axis=1) <= s.most_flips)

    def sides(held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        return [h[1:] for h in held if not h[0]], [h[1:] for h in held if h[0]]

    def screen(held: list[tuple]) -> list[tuple[int, int]]:
        asking, answering = sides(held)
        if not asking or not answering:
            return []
        labels, sizes, sketches = (stack([h[k] for h in answering]) for k in (1, 2, 3))
        home = asking[0][4]
        shared = np.full((len(answering), max(len(h[5]) for h in answering)), home)
        for k, h in enumerate(answering):
            shared[k, : len(h[5])] = h[5]
        met, hit = np.zeros(len(answering), bool), []
        for x in asking:
            found = np.flatnonzero(near(x, labels, sizes, sketches))
            if len(found) and (earlier := [b for b in x[5] if b < home]):
                found = found[~np.isin(shared[found], earlier).any(axis=1)]  # such a pair meets in that bucket
            if len(found):
                met[found] = True
                hit.append((home, x[0]))
        return hit + [(home, answering[k][0]) for k in np.flatnonzero(met)]

    def compare(held: list[tuple]) -> list[tuple[int, int]]:
        asking, answering = sides(held)
        if not asking or not answering:
            return []
        labels, sizes, sketches = (stack([h[k] for h in answering]) for k in (1, 2, 3))
        items = [np.frombuffer(h[4], np.uint64) for h in answering]
        out, moved = [], {}  # moved: labels that became another one in this task
        for node, label, n, sketch, own in asking:
            while label in moved:
                label = moved[label]
            found = np.flatnonzero(near((node, label, n, sketch), labels, sizes, sketches))
            if not len(found):
                continue
            linked = found[_linked(np.frombuffer(own, np.uint64), [items[k] for k in found], s)]
            for other in np.unique(labels[linked]).tolist():
                out.append((other, label))
                moved[other] = label
                labels[labels == other] = label
        return out

    keys = ["bucket", "part", "other"]
    known = nodes.select("node", "n_shingles", "sketch")
    places = rows.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # a bucket for each band at most
    met = _met(rows.join(known, "node").join(places, "node"), s, False).withColumn("home", F.col("bucket"))
    alive = _by_group(met, keys, ["side"], ["side", "node", "label", "n_shingles", "sketch", "home", "buckets"], screen, ("bucket", "node")).distinct()
    alive = materialise(alive, "near-screened")
    left = _met(rows.join(alive, ["bucket", "node"]).join(known, "node"), s).join(sets, "node")
    return _by_group(left, keys, ["side"], ["side", "node", "label", "n_shingles", "sketch", "items"], compare, ("src", "dst"))


def linked_nodes(docs: DataFrame, nodes: DataFrame, s: NearDedup) -> DataFrame:
    """(node, label) of all nodes that are linked with another one; nodes of one class have one label."""
    in_bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket")
    members = materialise(in_bucket.join(shared, "bucket"), "near-buckets")
    sets = shingle_tables(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), s)
    sets = materialise(sets, "near-sets")
    known = nodes.select("node", "n_shingles", "sketch")
    labels = None  # (node, label) of linked nodes so far

    def labelled() -> DataFrame:
        """Members of the buckets with several labels."""
        rows = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        return rows.join(open_, "bucket") if labels is not None else rows

    def carry_on(links: DataFrame, tag: str) -> None:
        """Links are between labels or nodes; labels that are linked become one."""
        nonlocal labels
        joined = connected_components(links, tag)
        if labels is None:
            labels = joined
            return
        moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = materialise(moved.unionByName(joined.join(labels, "node", "left_anti")), f"{tag}-all")

    for k in range(s.hub_rounds):
        rows = labelled()
        first = lambda c: F.min_by(c, F.xxhash64(F.lit(k), "node"))  # noqa: E731, B023
        hubs = rows.groupBy("bucket").agg(first("node").alias("hub"), first("label").alias("hub_label"))
        pairs = rows.join(hubs, "bucket").where("label <> hub_label").select("node", "hub", "label", "hub_label").distinct()
        other = known.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
        pairs = pairs.join(known, "node").join(other, "hub").where(_sizes_allow("n_shingles", "hub_n", s) & (_flips("sketch", "hub_sketch", s) <= s.most_flips))
        pairs = materialise(pairs.select("node", "hub", "n_shingles", "label", "hub_label"), f"near-pairs{k}")
        links = hub_links(pairs.select("node", "hub", "n_shingles"), sets, s)
        if labels is not None:
            named = pairs.select(F.col("node").alias("src"), F.col("hub").alias("dst"), "label", "hub_label")
            links = links.join(named, ["src", "dst"]).select(F.col("label").alias("src"), F.col("hub_label").alias("dst"))
        carry_on(links, f"near-hubs{k}")

    rows = labelled()
    counts = rows.groupBy("bucket", "label").count()
    largest = counts.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    same = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("b"))
    once = same.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket")  # buckets of the same nodes
    rows = rows.join(once, "bucket").join(largest, "bucket").select("bucket", "node", "label", (F.col("label") != F.col("largest")).alias("apart"))
    rows = materialise(rows, "near-left")
    if not rows.isEmpty():
        carry_on(exhaustive_links(rows, nodes, sets, s), "near-rest")
    return labels if labels is not None else members.select("node", F.col("node").alias("label")).where("false")


def classes(docs: DataFrame, settings: NearDedup | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and ``best`` of every row of ``docs`` (doc_id, text): whether the row's text and id are
    those that stand for its class (exact repeats of that row say so too). See ``near_duplicate_classes``."""
    s = settings or NearDedup()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(signatures(docs, s), "near-signatures")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    nodes = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")  # the numbers are fixed as they are written
    labels = linked_nodes(docs, nodes, s)
    shared = nodes.select("node", "set_key", "first", "copies").join(labels, "node", "left").where("copies > 1 or label is not null")
    shared = shared.select("set_key", "first", F.coalesce("label", "node").alias("label"))
    firsts = shared.groupBy("label").agg(F.min("first").alias("chosen"))
    chosen = shared.join(firsts, "label").select("set_key", "chosen")
    found = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(chosen, "set_key", "left")
    alone = F.col("chosen").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("chosen.doc_id"))
    best = alone | (F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_key") == F.col("chosen.text_key")))
    return found.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), best.alias("best"))


def near_duplicate_classes(docs: DataFrame, settings: NearDedup | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    A row's set is that of its text's distinct shingles of ``width`` words; with fewer words, the whole sequence as one.
    Null and empty texts and texts without a word have no set and are linked with nothing. The component_id is the
    smallest doc_id of the class, null if no row of it has one; ``kept`` is true where doc_id equals it, null-safe. Every row
    is judged by its own text, also where several rows share a doc_id; repeated rows get the same answer each. Extra columns
    are ignored; an empty table gives an empty one. Integer doc_ids are asked for.
    """
    return classes(docs, settings).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each_class(docs: DataFrame, settings: NearDedup | None = None) -> DataFrame:
    """The rows of docs (doc_id, text and other columns) without near-duplicates: of each class the row with the smallest doc_id stays, rows
    without one coming last, and of repeated rows one. Texts without a word are no duplicates and all stay."""
    rows = classes(docs, settings).groupBy("doc_id", "text_key").agg(F.bool_and("best").alias("best"), (F.sum(F.sign("n_shingles")) > 1).alias("repeated"))
    marked = materialise(rows.where("not best or repeated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "best"), "near-marked")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (_text_key() == F.col("__key"))
    left = docs.join(marked.select("__id", "__key").hint("shuffle_hash"), same, "left_anti")  # texts are streamed past the ids, not sorted
    again = marked.where("best")
    if again.isEmpty():
        return left
    return left.unionByName(docs.join(again.hint("shuffle_hash"), same).dropDuplicates(["__id", "__key"]).select(*docs.columns))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), NearDedup(width=3, percent=85))


#: The same by brute force: distinct sets are compared through their common shingles.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words
), reps AS (
  SELECT min(doc_id) AS rep, s FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT rep, len(s) AS n, unnest(s) AS item FROM reps
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS a, rep AS b FROM reps WHERE rep IN (SELECT a FROM both_ways)
  UNION
  SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a
), classes AS (
  SELECT a AS rep, min(b) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component, r.rep, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component, r.rep, d.doc_id) AS kept
FROM sets d LEFT JOIN reps r ON d.s = r.s AND len(d.s) > 0 LEFT JOIN classes c ON c.rep = r.rep
"""
