"""Quality rules with adaptive cut-offs from mergeable quantile sketches per language and source.

Exact counts are taken of every whole text (``text_counts``). Documents that fail the fixed
minimum rules are out. For the rest, ratios of the counts are summarised in a KLL sketch for
each language and source, a mergeable summary that Spark combines from partial ones, so a source
with a third of all rows is summed up where its rows lie; the sketches of a language and of all documents are merged from these.
Ratios are smoothed: ``RATIOS`` adds pseudo-counts, so that a ratio that is 0 in most texts still spreads with their lengths and a short
text isn't out for a single mark. A cut-off is the sketch's upper quartile plus ``SPREADS`` interquartile ranges; no fixed value bounds it.
A source's cut-off is bounded by that of its language and, but for ``OF_LANGUAGE``, that of all documents, so a source full of junk
can't raise its own; groups with few rows have no cut-offs of their own. The joined cut-offs then filter the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, chunks, map_arrow, materialise, table, utf8_parts
from .shingles import shingles, words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: KLL parameter; the normalised rank error is about 1.3 % at 200, 0.3 % at 1000.
SKETCH_K = 1000
#: A group's own cut-offs need so many rows.
GROUP_ROWS = 100
#: ratio -> (count, what it is a share of, pseudo-counts added to the one and to the other).
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words", 1, 20),
    "dup_line_share": ("n_dup_lines", "n_lines", 1, 10),
    "repeat_share": ("n_repeat_words", "n_words", 8, 80),
    "same_next_share": ("n_same_next", "n_words", 1, 20),
    "chars_per_word": ("word_chars", "n_words", 0, 0),
}
#: An interquartile range counts as this share of the upper quartile at least, for groups of much alike texts.
LEAST_SPREAD = {"chars_per_word": 0.03}
OTHER_SPREAD = 0.25
#: Interquartile ranges that a cut-off lies above the upper quartile.
SPREADS = 10.0
#: Ratios that differ by language: a language's cut-off isn't bounded by the overall one.
OF_LANGUAGE = ("chars_per_word",)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    found = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(found), len(found) - len(set(found))


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """Words in windows that occur twice or more."""
    if len(windows) < 2 or len(np.unique(windows)) == len(windows):
        return 0
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    first = np.flatnonzero(times[which] > 1)
    step = np.zeros(n_words + 1, np.int64)
    step[first] += 1
    step[first + WINDOW] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


def _count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = utf8_parts(column)
    out = {k: np.zeros(len(offsets) - 1, np.int64) for k in _COUNTS}
    for a, b in chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, word_at = words(part, at)
        windows, window_at = shingles(hashes, word_at, WINDOW)
        n = np.diff(word_at)
        per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
        out["n_words"][a:b] = n
        out["word_chars"][a:b] = per_text(((part & 0xC0) != 0x80) & ~_IS_SPACE[part])
        out["n_symbols"][a:b] = per_text(_IS_SYMBOL[part])
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[word_at[:-1][n > 0]] = False  # a text's first word
        out["n_same_next"][a:b] = np.diff(np.concatenate([[0], np.cumsum(same)])[word_at])
        whole = part.tobytes()
        for k in range(b - a):
            out["n_lines"][a + k], out["n_dup_lines"][a + k] = _lines(whole[at[k] : at[k + 1]])
            if n[k] > WINDOW:
                out["n_repeat_words"][a + k] = _repeated(windows[window_at[k] : window_at[k + 1]], int(n[k]))
    return out


def text_counts(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The exact counts of every whole text beside the columns named in ``carry``; a null text counts as empty.
    ``text`` may name a field of a carried struct (``row.text``), so that the text goes to Python once."""
    schema = docs.select(*carry).schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    outer, _, inner = text.partition(".")
    own, at, n = ([], carry.index(outer), len(carry)) if inner else ([F.col(text).alias("__text")], len(carry), len(carry))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            column = batch.column(at)
            got = _count_texts(column.flatten()[column.type.get_field_index(inner)] if inner else column)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(got[k]) for k in _COUNTS)], [*carry, *_COUNTS])

    return map_arrow(docs.select(*carry, *own), count, schema)


def _with_ratios(counted: DataFrame) -> DataFrame:
    ratio = lambda x, n, a, b: F.coalesce(F.try_divide((F.col(x) + a).cast("double"), (F.col(n) + b).cast("double")), F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumns({"base_failed": failed} | {name: ratio(*parts) for name, parts in RATIOS.items()})


def cut_offs(measured: DataFrame) -> DataFrame:
    """A row for each language and source, each language (source null, level 1) and all (level 2): ``n`` and a cut-off per ratio.

    The coarser sketches are merged from the finer ones, not computed again from the rows.
    """
    fine = measured.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r, SKETCH_K).alias(r) for r in RATIOS))
    fine = fine.withColumn("level", F.lit(0))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in RATIOS)]
    by_lang = fine.groupBy("lang").agg(*merged).withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)})
    overall = by_lang.agg(*merged).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(2)}).where("n > 0")

    def cut(ratio: str):
        q = lambda x: F.kll_sketch_get_quantile_double(ratio, F.lit(x))
        return (q(0.75) + SPREADS * F.greatest(q(0.75) - q(0.25), LEAST_SPREAD.get(ratio, OTHER_SPREAD) * q(0.75))).alias(f"cut_{ratio}")

    return fine.unionByName(by_lang).unionByName(overall).where("n > 0").select("level", "lang", "source", "n", *(cut(r) for r in RATIOS))


def _judged(measured: DataFrame, cuts: DataFrame, group_rows: int) -> DataFrame:
    """measured with ``kept``, by the cut-offs of each row's groups."""
    names = [f"cut_{r}" for r in RATIOS]

    def level(n: int) -> DataFrame:
        return cuts.where((F.col("level") == n) & ((F.col("n") >= group_rows) | F.lit(n == 2))).select(
            F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(F.col(c).alias(f"{c}_{n}") for c in names)
        )

    joined = (
        measured.join(level(0), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
        .drop("__lang", "__source")
        .join(level(1), F.col("lang").eqNullSafe(F.col("__lang")), "left")
        .drop("__lang", "__source")
    )
    overall = level(2).select(*(F.col(f"{c}_2") for c in names))
    joined = joined.join(F.broadcast(overall), F.lit(True), "left")  # a single row

    def limit(r: str):
        own, of_lang, of_all = (F.col(f"cut_{r}_{n}") for n in range(3))
        bound = F.least(own, of_lang)  # skips nulls
        return F.coalesce(bound, of_all) if r in OF_LANGUAGE else F.least(bound, of_all)

    passed = reduce(Column.__and__, (F.col(r) <= limit(r) for r in RATIOS))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(passed, F.lit(False))).select(*measured.columns, "kept")


def quality_verdicts(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, lang, source, the counts and ratios, ``base_failed`` and ``kept`` of every document.

    A null text counts as empty and so fails the base rules. Null languages and sources are groups of their own.
    Repeated rows count as often as they occur and each gets its verdict. Extra columns are ignored; an empty table
    gives an empty one. The sketches' cut-offs are written to the shared folder before they are used, so all
    verdicts rest on the same ones even if tasks are run again.
    """
    measured = _with_ratios(text_counts(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"]))
    measured = materialise(measured, "quality-counts")
    return _judged(measured, materialise(cut_offs(measured), "quality-cuts"), group_rows)


def keep_good(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of docs (text, lang, source and other columns) that ``quality_verdicts`` would keep.

    The verdict is found on the row itself: texts are read and counted twice, for the cut-offs and for the verdicts, and never
    shuffled. Rows are judged one by one, whatever their ids; nulls, repeats and empty tables as in ``quality_verdicts``.
    """
    counted = _with_ratios(text_counts(docs.select("text", "lang", "source"), ["lang", "source"]))
    cuts = materialise(cut_offs(counted), "quality-cuts")
    row = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source")
    return _judged(_with_ratios(text_counts(row.select("row", "lang", "source"), ["row", "lang", "source"], text="row.text")), cuts, group_rows).where("kept").select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _op5_sql() -> str:
    """The query in SQL; cut-offs by exact quantiles, which the sketches give for up to ``SKETCH_K`` rows a group."""
    ratio = lambda x, n, a, b: f"coalesce(CAST({x} + {a} AS DOUBLE) / nullif(CAST({n} + {b} AS DOUBLE), 0), 0)"
    ratios = ", ".join(f"{ratio(*parts)} AS {r}" for r, parts in RATIOS.items())
    cuts = ", ".join(f"q3.{r} + {SPREADS} * greatest(q3.{r} - q1.{r}, {LEAST_SPREAD.get(r, OTHER_SPREAD)} * q3.{r}) AS {r}" for r in RATIOS)
    quartile = lambda q: "{" + ", ".join(f"{r}: quantile_disc({r}, {q})" for r in RATIOS) + "}"
    level = lambda n, by: f"SELECT {n} AS level, {by}, count(*) AS n, {quartile(0.25)} AS q1, {quartile(0.75)} AS q3 FROM good GROUP BY ALL"
    limit = lambda r: f"coalesce(least(a.{r}, b.{r}), c.{r})" if r in OF_LANGUAGE else f"least(a.{r}, b.{r}, c.{r})"
    kept = " AND ".join(f"m.{r} <= {limit(r)}" for r in RATIOS)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT row, unnest(range(len(ws) - 7)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k : k + 7], ' '))) AS w FROM texts WHERE len(ws) > 8),
repeated AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, w) > 1),
covered AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS k FROM repeated) GROUP BY row),
lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
counted AS (SELECT doc_id, lang, source, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(range(1, len(ws)), lambda k: ws[k] = ws[k + 1])) AS n_same_next FROM texts JOIN lines USING (row) LEFT JOIN covered c USING (row)),
measured AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {ratios} FROM counted),
good AS (SELECT * FROM measured WHERE NOT base_failed),
levels AS ({level(0, "lang, source")} UNION ALL {level(1, "lang, NULL AS source")} UNION ALL {level(2, "NULL AS lang, NULL AS source")}),
cuts AS (SELECT level, lang, source, {cuts} FROM levels WHERE n >= {GROUP_ROWS} OR level = 2)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({kept}, false) AS kept
FROM measured m LEFT JOIN cuts a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
LEFT JOIN cuts b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM m.lang LEFT JOIN cuts c ON c.level = 2
"""


OP5_SQL = _op5_sql()
