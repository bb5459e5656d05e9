"""Near copies for the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash: fingerprints of these shingles, linked by the index in Gray order. It finds the closest
copies only: at a similarity of 0.8 about 10 of 64 bits differ, and no block of the index would be shared. So texts are
also candidates that share one of ``BANDS`` keys, each of ``ROWS`` minimum hashes. Every text of a group of candidates is
then compared with the others by its whole set of shingles, unless they are linked already. Equal sets are one node.
A group's links leave its task as a tree of each local component: never as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import simhash
from barloom.llm.components import components
from barloom.llm.shared import checkpointed, row_hash, stored

#: Words of a shingle, and the least similarity, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Two texts of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
FACTORS = np.random.default_rng(7).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Products of shingles and factors that are held at once.
AT_ONCE = 20_000


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's different shingles, ascending; fewer words are one shingle, none are none. Words are as in op5."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.array([xxh64_intdigest(s) for s in found], np.uint64))


def keys(found: np.ndarray) -> list[int]:
    """One key a band; a set without shingles has none."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.min([(FACTORS * found[i : i + AT_ONCE]).min(1) for i in range(0, len(found), AT_ONCE)], 0)
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    top, bottom = LEAST
    if bottom * len(a) < top * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return bottom * both >= top * (len(a) + len(b) - both)


def tree(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that make the components of all similar pairs: one less than a component has members."""
    out: list[tuple[int, int]] = []
    parts: list[list[int]] = []
    for i, mine in enumerate(sets):
        own, apart = [i], []
        for part in parts:
            if (j := next((j for j in part if similar(mine, sets[j])), None)) is None:
                apart.append(part)
            else:
                out.append((i, j))
                own = part + own
        parts = [*apart, own]
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with ``text`` -> its other columns, ``node`` (a hash of its shingles), ``keys`` and ``fp``, its SimHash."""
    from xxhash import xxh64_intdigest

    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, key, fp = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                found = shingles(text.as_py())
                node.append(xxh64_intdigest(found.tobytes()))
                key.append(keys(found))
                fp.append(simhash.majorities(found, np.array([len(found)]))[0])
            more = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(key, pa.list_(pa.int64())), pa.array(np.array(fp, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *more], [*names, "node", "keys", "fp"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("node", "long").add("keys", T.ArrayType(T.LongType())).add("fp", "long"))


def links(members: DataFrame) -> DataFrame:
    """Rows (band, key, node, text) of whole groups in order -> links (a, b) of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def out() -> pa.RecordBatch:
            found = tree(sets)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            band, key, node, text = (batch.column(i) for i in range(4))
            for b, k, n, t in zip(band.to_pylist(), key.to_pylist(), node.to_pylist(), text, strict=True):
                if (b, k) != at:
                    if len(nodes) > 1:
                        yield out()
                    at, nodes, sets = (b, k), [], []
                nodes.append(n)
                sets.append(shingles(t.as_py()))
        if len(nodes) > 1:
            yield out()

    return members.repartition("band", "key").sortWithinPartitions("band", "key", "node").select("band", "key", "node", "text").mapInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies stays, the one with its smallest doc_id, with all its columns.

    Rows are told apart by doc_id and a hash of all their columns, so that of rows which repeat a doc_id the same one stays in
    every run, and of equal rows one. Columns of ``docs`` may have any names. Bands whose groups have the same members are
    compared once. Texts are shuffled for groups of two nodes or more only.
    """
    id_, hash_ = F.coalesce("doc_id", F.lit(0)).alias("_id"), row_hash(docs).alias("_hash")
    rows = stored(with_keys(docs.select(F.col("doc_id").isNull().alias("_null"), id_, hash_, "text")))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("_null", "_id", "_hash")).alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    close = components(simhash.links(nodes.select("fp").distinct()).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    close = nodes.where(F.size("keys") > 0).select("node", "fp").join(close.withColumnRenamed("node", "linked"), F.col("fp") == F.col("linked"), "left")
    members = nodes.select("node", F.posexplode("keys").alias("band", "key")).union(close.select("node", F.lit(BANDS), F.coalesce("root", "fp")))
    mark = partial(F.xxhash64, "node")
    groups = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(mark()).alias("x"), F.bit_xor(mark(F.lit(1))).alias("y")).where("n > 1")
    chosen = groups.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("g")).select("g.band", "g.key")
    grouped = stored(members.join(chosen, ["band", "key"]))
    needed = nodes.join(grouped, "node", "left_semi").select("node", "first._id", "first._hash")
    texts = docs.select(id_, hash_, "text").join(needed, ["_id", "_hash"]).select("node", "text").dropDuplicates(["node"])
    roots = components(stored(links(grouped.join(texts, "node"))))
    labelled = checkpointed(nodes.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root")))
    keep = labelled.groupBy("root").agg(F.min("first").alias("k")).select("k._id", "k._hash").distinct()
    return simhash.kept_rows(docs, keep)
