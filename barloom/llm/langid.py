"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all training documents, by each task in one array and then by sums of these.
The regression is trained with follow-the-regularised-leader (McMahan et al., 2013): a weight stays zero until its
accumulated gradient exceeds the L1 penalty, and an L2 penalty shrinks the others. It is fitted on a bounded sample,
about ``PER_LANGUAGE`` documents of each language, chosen by a hash. Part of the sample is left out of training and
fits the temperature by which logits are divided, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import stored

#: Bits of a hashed n-gram, and the lengths of n-grams.
BITS, LENGTHS = 14, (1, 2, 3)
SIZE = 1 << BITS
#: Documents of each language, about, that the regression is fitted on.
PER_LANGUAGE = 1000
#: Documents of all languages together, about; with more than ``MOST_SAMPLES`` / ``PER_LANGUAGE`` languages each has fewer.
MOST_SAMPLES = 50_000
#: Languages whose counts are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Letters of an excerpt that is trained on besides each whole text, so that short texts are known too.
EXCERPT = 30
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.02, 0.5
#: One sample in so many is kept for the temperature.
CALIBRATION = 5
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, a space for the rest."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x10000)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Code points of lower-case letters, with one space around each run of them; empty if there is none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _letters()[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):
        out[codes == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 32
    space = out == 32
    if space.all():
        return np.zeros(0, np.uint32)
    out = np.r_[np.uint32(32), out, np.uint32(32)]
    space = np.r_[True, space, True]
    return out[~(space & np.r_[False, space[:-1]])]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that occur, and how often."""
    each = []
    for n in LENGTHS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * FACTORS[i]
                h ^= h >> np.uint32(15)
            each.append((h * FACTORS[0]) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(each), minlength=SIZE)
    index = np.flatnonzero(counts)
    return index, counts[index]


def held_out(doc_id: Column) -> Column:
    """One document in three, by a checksum of its id, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[index]
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def logits(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[:, index] @ self.vector(index, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letters(text) if text else np.zeros(0, np.uint32)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(*grams(codes)) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents with a letter, and for each hashed n-gram of those that have it. ``SIZE`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if (text := t.as_py()) and len(codes := letters(text)):
                    seen[grams(codes)[0]] += 1
                    seen[SIZE] += 1
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.array(seen[index])], ["gram", "n"])

    sums = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE + 1, np.int64)
    for r in sums:
        out[r.gram] = r.n
    return int(out[SIZE]), out[:SIZE]


def samples(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list:
    """Rows (lang, key, part, index, count) of a hash sample: whole texts (part 0) and excerpts (part 1)."""
    counts = stored(docs.groupBy("lang").agg(F.count("*").alias("rows")))
    languages = counts.count()
    per_language = min(per_language, MOST_SAMPLES // max(1, languages) + 1)
    key = F.xxhash64(F.lit("langid"), F.col("doc_id"), F.xxhash64("text"))
    share = F.lit(float(per_language)) / F.col("rows")
    picked = docs.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").withColumn("key", key).where(F.shiftrightunsigned("key", 11) < share * float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = letters(text or "")
                if len(codes):
                    at = crc32(text.encode("utf-8", "replace")) % max(1, len(codes) - EXCERPT)
                    rows += [(lang, key, part, *grams(c)) for part, c in enumerate((codes, codes[at : at + EXCERPT]))]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "key", "part", "index", "count"), (a, b, c, d.astype(np.uint16).tobytes(), e.astype(np.int32).tobytes()), strict=True)) for a, b, c, d, e in rows], pa.schema([("lang", pa.string()), ("key", pa.int64()), ("part", pa.int32()), ("index", pa.binary()), ("count", pa.binary())]))

    return picked.select("lang", "key", "text").mapInArrow(run, "lang string, key long, part int, index binary, count binary").collect()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs with doc_id, text and lang -> a model. Rows without text or lang teach nothing; without any row all is unknown."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n, frequency = document_frequencies(known)
    rows = sorted(samples(known, per_language), key=lambda r: (r.key, r.part, r.lang))
    languages = sorted({r.lang for r in rows})
    idf = np.log((1 + n) / (1 + frequency)) + 1
    model = Model(languages, idf, np.zeros((len(languages), SIZE)), np.zeros(len(languages)), 1.0)
    if not rows:
        return model
    place = {c: i for i, c in enumerate(languages)}
    data = [(place[r.lang], np.frombuffer(r["index"], np.uint16).astype(np.int64), np.frombuffer(r["count"], np.int32), r.key % CALIBRATION == 0) for r in rows]
    _train(model, [(y, i, model.vector(i, c)) for y, i, c, aside in data if not aside] or [(y, i, model.vector(i, c)) for y, i, c, _ in data])
    _calibrate(model, [(y, model.logits(i, c)) for y, i, c, aside in data if aside])
    return model


def _train(model: Model, data: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Weights by follow-the-regularised-leader with per-coordinate rates, one sample at a time in hashed order."""
    k = len(model.languages)
    z, n = np.zeros((k, SIZE + 1)), np.zeros((k, SIZE + 1))

    def weights(i: np.ndarray) -> np.ndarray:
        a, b = z[:, i], n[:, i]
        return np.where(np.abs(a) <= L1, 0.0, (np.sign(a) * L1 - a) / ((BETA + np.sqrt(b)) / ALPHA + L2 * (i != SIZE)))

    for epoch in range(EPOCHS):
        for j in np.random.default_rng(epoch).permutation(len(data)):
            y, index, x = data[j]
            index, x = np.append(index, SIZE), np.append(x, 1.0)  # the last is the bias
            w = weights(index)
            p = w @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            old = n[:, index]
            new = old + g * g
            z[:, index] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[:, index] = new
    full = weights(np.arange(SIZE + 1))
    model.weights, model.bias = full[:, :SIZE], full[:, SIZE]


def _calibrate(model: Model, data: list[tuple[int, np.ndarray]]) -> None:
    """The temperature of least log-loss, by golden-section search over its logarithm."""
    if not data:
        return
    y, z = np.array([d[0] for d in data]), np.array([d[1] for d in data])

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    a, b, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def identify(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """docs with ``text`` -> with lang_pred and score, columns of ``docs`` by these names replaced. Null texts and texts without a letter are ``und`` with score 0."""
    kept = docs.drop("lang_pred", "score")
    fields = [f for f in kept.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts the language of all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep_text=False)
