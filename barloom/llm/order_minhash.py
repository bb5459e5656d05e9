"""Document fingerprints by Order MinHash (Marcais et al., 2019).

The k-mers of a text are numbered by occurrence, so that the third "abc" differs from the first. Each of ``HASHES``
hash functions selects the ``TUPLE`` numbered k-mers with the least values, keeps them in the order of the text and
hashes the tuple. Two signatures agree at a place with a probability that falls as the edit distance grows; unlike
MinHash it also falls when the same k-mers stand in another order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import stored

#: Code points of a k-mer.
K = 8
#: Numbered k-mers of a tuple.
TUPLE = 2
#: Hash functions; each makes 16 bits of the signature, the last always set.
HASHES = 64
#: Rows of a range of doc_id to aim for, when each document meets the next.
RANGE_ROWS = 5_000
#: Heads of ranges, of 24 bytes, that are broadcast; more are joined by a shuffle.
BROADCAST_HEADS = 100_000
#: Quantiles of doc_id at most; each range between two is divided evenly.
QUANTILES = 256
MULTIPLIERS = np.random.default_rng(20190705).integers(1, 2**63, (HASHES, 2), np.int64).astype(np.uint64) | np.uint64(1)
WEIGHTS = np.random.default_rng(20190706).integers(1, 2**63, K, np.int64).astype(np.uint64) | np.uint64(1)
LAST = np.uint32(2**32 - 1)
#: Values that are compared at once.
AT_ONCE = 131_072
SHORT = (MULTIPLIERS[:, :1] >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over the word (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(codes: np.ndarray) -> np.ndarray:
    """One hash for each k-mer with its occurrence number. Texts shorter than a k-mer are one k-mer."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    if n < K:
        return _mixed(np.array([np.sum(codes.astype(np.uint64) * WEIGHTS[:n]) + np.uint64(n)], np.uint64))
    wide = codes.astype(np.uint64)
    h = np.zeros(n - K + 1, np.uint64)
    for i in range(K):
        h += wide[i : n - K + 1 + i] * WEIGHTS[i]
    h = _mixed(h)
    # Equal k-mers stand together, in order of text, after sorting hashes whose low bits hold the place.
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    kmer = packed & ~low
    new = np.r_[True, kmer[1:] != kmer[:-1]]
    if new.all():
        return h
    place = np.arange(len(h))
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    again = occurrence > 0
    at = (packed[again] & low).astype(np.int64)
    h[at] = _mixed(h[at] + occurrence[again].astype(np.uint64) * GOLDEN)
    return h


def signature(codes: np.ndarray) -> np.ndarray:
    """``HASHES`` odd values of 16 bits, so none is zero; an empty text has zeros."""
    h = numbered_kmers(codes)
    n = len(h)
    if not n:
        return np.zeros(HASHES, np.uint16)
    many = min(TUPLE, n)
    picked = np.empty((HASHES, many), np.int64)
    block = max(1, AT_ONCE // n)
    short = (h >> np.uint64(32)).astype(np.uint32)
    for j in range(0, HASHES, block):
        value = short * SHORT[j : j + block]
        rows = np.arange(len(value))
        for k in range(many):
            picked[j : j + block, k] = least = value.argmin(axis=1)
            value[rows, least] = LAST
    picked.sort(axis=1)
    x = MULTIPLIERS[:, 1]
    for k in range(many):
        x = _mixed(x * GOLDEN + h[picked[:, k]])
    return (x & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places."""
    return float(np.mean(a == b))


def hexadecimal(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def with_signatures(docs: DataFrame, columns: dict[str, str], keep_texts: bool = True) -> DataFrame:
    """docs -> with a signature (array of int) of each text column, named by ``columns``. Null text counts as empty."""
    kept = [f for f in docs.schema.fields if keep_texts or f.name not in columns]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = []
            for c in columns:
                values = [signature(code_points(t.as_py() or "")) for t in batch.column(batch.schema.get_field_index(c))]
                flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
                signatures.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, HASHES, dtype=np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *signatures], [*names, *columns.values()])

    schema = T.StructType([*kept, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in columns.values())])
    return docs.mapInArrow(run, schema)


def _ranges(docs: DataFrame) -> Column:
    """The range that a row's doc_id falls into: a struct in order of doc_id. Null comes first."""
    n, lo, hi, nulls = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    many = max(1, n // RANGE_ROWS)
    parts = min(QUANTILES, many)
    cuts = sorted({*docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * QUANTILES)).first()[0]}) if parts > 1 and lo is not None else []
    doc = F.col("doc_id")
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= doc)) if cuts else F.lit(0)
    limits = F.array(*[F.lit(c).cast("long") for c in (lo or 0, *cuts, (hi or 0) + 1)])
    start, end = F.element_at(limits, part + 1), F.element_at(limits, part + 2)
    within = -(-many // parts)
    even = F.least(F.lit(within - 1), F.floor((doc - start).cast("double") / F.greatest(end - start, F.lit(1)) * within).cast("int"))
    # Rows without doc_id follow each other by their tie, a hash, so its high bits divide them.
    bits = (max(1, nulls // RANGE_ROWS) - 1).bit_length()
    tied = F.when(doc.isNull(), F.shiftright("tie", 64 - bits) if bits else F.lit(0).cast("long")).otherwise(0)
    return F.struct(F.when(doc.isNull(), -1).otherwise(part).alias("part"), F.coalesce(even, F.lit(-1)).alias("even"), tied.alias("tied"))


def with_next(docs: DataFrame, column: str, name: str) -> DataFrame:
    """docs with doc_id and ``tie`` -> with ``column`` of the next row as ``name``, in order of doc_id, then tie; the last row's next is the first.

    Rows are dealt by ranges of doc_id, so that each meets the next in its own task. Each range also gets the first
    row of the next range that has rows: one row a range, found by its doc_id and tie.
    """
    ranged = docs.withColumns({"_range": _ranges(docs), "_extra": F.lit(False)})
    heads = ranged.groupBy("_range").agg(F.min(F.struct("doc_id", "tie")).alias("h"))
    # Ranges follow each other within a part; one row a part, of at most QUANTILES + 1, tells the last range of the part before.
    w = W.orderBy("part")
    ends = heads.groupBy("_range.part").agg(F.max("_range").alias("end"))
    ends = ends.select("part", F.coalesce(F.lag("end").over(w), F.last("end").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end"))
    heads = heads.withColumn("before", F.lag("_range").over(W.partitionBy("_range.part").orderBy("_range"))).join(F.broadcast(ends), F.col("_range.part") == F.col("part"))
    heads = stored(heads.select(F.coalesce("before", "end").alias("_to"), "h.doc_id", "h.tie")).alias("h")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    met = ranged.alias("d").join(heads, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.tie") == F.col("h.tie")))
    extra = met.select(*[F.col(f"d.{c}") for c in docs.columns], F.col("h._to").alias("_range"), F.lit(True).alias("_extra"))
    order = W.partitionBy("_range").orderBy("_extra", "doc_id", "tie")
    return ranged.select(*docs.columns, "_range", "_extra").union(extra).withColumn(name, F.lead(column).over(order)).where(~F.col("_extra")).drop("_range", "_extra")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points, rounded down, gives way to the first as many, or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def alike(a: str, b: str) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(HASHES))


def hexadecimal_column(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id and text -> doc_id, n_chars, edited_sha256, signatures of the text, its edit and the next text.

    Null text counts as empty. Rows of one doc_id follow each other in order of a hash of their texts.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    pairs = with_next(plain, "text", "following").withColumn("edited", edited_text(F.col("text"), F.col("following")))
    pairs = pairs.select("doc_id", "tie", "text", "edited", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    signed = with_signatures(pairs, {"text": "signature", "edited": "edited_signature"}, keep_texts=False)
    return with_next(stored(signed), "signature", "next_signature")
