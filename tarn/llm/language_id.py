"""Language identification with error-correcting output codes.

Each language has a codeword of bits; a binary classifier per bit (logistic regression on hashed
byte n-grams) predicts that bit of a text's language. Decoding weighs every bit with the
classifier's loss and takes the nearest codeword; a small lead over the second nearest flags
the text as ambiguous.

The classifiers are fitted on a bounded sample (``TRAIN_DOCS`` documents over all languages,
chosen by a hash of the document id); everything else reads whole texts of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, map_arrow, table, utf8_parts

#: Documents that the classifiers are fitted on, over all languages: the bound of the sample.
TRAIN_DOCS = 4000
#: Hashed n-gram features: sizes of the n-grams in bytes, and the number of features.
GRAMS = (1, 2, 3, 4)
FEATURES = 1 << 12
#: A lead of the nearest codeword below this share of the loss range is ambiguous.
AMBIGUOUS = 0.05
#: Bits of a codeword when there are too many languages for all of the 2**(n-1) - 1 splits.
MAX_BITS = 31


def _lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[:32] = 32
    out[48:58] = 32  # digits and most ASCII punctuation say little about a language
    for c in b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~":
        out[c] = 32
    return out


_FOLD = _lower_table()


def features(text: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams in a text, float32, of unit length; zeros for an empty text."""
    folded = _FOLD[text]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)  # runs of folded characters count once
    folded = np.concatenate([[32], folded[keep], [32]]).astype(np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    code = np.zeros(len(folded), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = (code[: len(folded) - n + 1] * np.uint32(257)) + folded[n - 1 :] + np.uint32(n == 1)
        if n in GRAMS:
            counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    root = np.sqrt(counts.astype(np.float32))
    size = float(np.sqrt((root * root).sum()))
    return root / size if size else root


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of bits (-1, 1): every split of few languages, else random splits with far-apart rows."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if (1 << (n - 1)) - 1 <= MAX_BITS:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(bits == 1, 1, -1).astype(np.int8)
    random, best, best_gap = np.random.Generator(np.random.PCG64(seed)), None, -1
    width = min(MAX_BITS * 4, max(MAX_BITS, int(10 * np.log2(n))))
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = int(min((code[a] != code[b]).sum() for a in range(n) for b in range(a)))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, float32
    bias: np.ndarray  # bits

    def decode(self, x: np.ndarray) -> tuple[int, float, float]:
        """Index of the language, score in 0..1 and lead over the second, by logistic loss to each codeword."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -self.code * margins[None, :]).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        odds = np.exp(-(loss - loss[order[0]]))
        lead = float((loss[order[1]] - loss[order[0]]) / (loss[order[1]] + loss[order[0]] + 1e-9)) if len(order) > 1 else 1.0
        return int(order[0]), float(1 / odds.sum()), lead


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 120, decay: float = 1e-4) -> LanguageModel:
    """Logistic regressions for all bits at once, by accelerated gradient descent from zero (no randomness)."""
    code = codewords(len(languages))
    target = code[y].astype(np.float32)  # rows x bits
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    weight = (len(y) / (len(languages) * share))[y][:, None].astype(np.float32) / len(y)  # languages count alike
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    w0, b0, step = w.copy(), b.copy(), 4.0
    for k in range(rounds):
        m = k / (k + 3)
        vw, vb = w + m * (w - w0), b + m * (b - b0)
        w0, b0 = w, b
        g = -target / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30))) * weight
        w, b = vw - step * (x.T @ g + decay * vw), vb - step * g.sum(axis=0)
    return LanguageModel(tuple(languages), code, w * 1.0, b)


def train(docs: DataFrame, eligible: Column, most: int = TRAIN_DOCS) -> LanguageModel:
    """A model of the non-null ``lang`` values of the eligible rows, from at most about ``most`` of their texts."""
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel((), np.zeros((0, 1), np.int8), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32))
    each = max(1, most // len(languages))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    rate = F.lit(0.0)
    for lang in languages:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, each / counts[lang]))).otherwise(rate)
    sample = rows.where(draw < rate).select("lang", F.col("text").alias("__text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            data, at = utf8_parts(batch.column(1))
            x = [zlib.compress(features(data[at[k] : at[k + 1]]).astype(np.float16).tobytes(), 1) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    got = map_arrow(sample, measure, "lang string, x binary").withColumn("key", F.xxhash64("x")).toArrow().combine_chunks()  # about ``most`` rows of some kB
    langs = got["lang"].to_pylist()
    present = sorted(set(langs)) or languages
    if not langs:
        return LanguageModel(tuple(present[:1]), np.ones((1, 1), np.int8), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32))
    y = np.array([present.index(lang) for lang in langs])
    order = np.lexsort((got["key"].to_numpy(), y))  # sums don't depend on the order in which rows came
    x, packed = np.empty((len(y), FEATURES), np.float32), got["x"].take(pa.array(order)).to_pylist()
    for k, row in enumerate(packed):
        x[k] = np.frombuffer(zlib.decompress(row), np.float16)
    return fit(x, y[order], present)


def identify(docs: DataFrame, model: LanguageModel, carry: list[str]) -> DataFrame:
    """The columns named in ``carry`` with lang_pred, score and ambiguous for every whole text.

    A text that is null or has no letter is ``und`` with score 0, and ambiguous; so is everything if the model
    knows no language. Only the text is looked at. Repeated rows get the same answer; an empty table an empty one.
    """
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    own = [] if "text" in carry else [F.col("text").alias("__text")]
    place, n = carry.index("text") if "text" in carry else len(carry), len(carry)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            data, at = utf8_parts(batch.column(place))
            lang, score, unsure = [], [], []
            for k in range(batch.num_rows):
                raw = data[at[k] : at[k + 1]]
                folded = raw | 32
                known = bool(len(raw)) and (bool(((folded >= 97) & (folded <= 122)).any()) or has_letter(raw.tobytes().decode()))
                if not known or not model.languages:
                    lang.append("und"), score.append(0.0), unsure.append(True)
                    continue
                best, p, lead = model.decode(features(raw))
                lang.append(model.languages[best]), score.append(p), unsure.append(lead < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], schema.names)

    return map_arrow(docs.select(*carry, *own), predict, schema)


def held_out() -> Column:
    """The fifth of the documents that nothing is learned from; documents without an id are never learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
