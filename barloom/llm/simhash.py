"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are deduplicated first. With 4 blocks of 16 bits, two fingerprints that differ in at most 2 bits agree on
2 blocks at least; so each is placed, for each of the 6 pairs of blocks, in the group of those that share the pair.
Within it, fingerprints are sorted by the Gray rank of their bits with the pair in front. Runs of neighbours then share
many bits: an index node keeps the bits that all below it have in common, less those that its parent has. A query adds
up its differences from the root down and drops a node, and all below it, once there are more than 2.

A group of more than ``LARGE`` goes through a second round, where its other 32 bits are divided into 4 blocks of 8 in
turn. The groups of that round share 48 bits, so none can have more than 65,536 fingerprints, and they are searched
whole. A group's links leave its task as a tree of each local component: never as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.shared import checkpointed, fresh, row_hash, stored

#: Fingerprints with up to so many differing bits are linked. Blocks are made for this value.
RADIUS = 2
#: Words of a shingle, and the seed of its XXH64.
SHINGLE, SEED = 3, 42
#: Larger groups are divided further.
LARGE = 4096
#: Children of an index node.
FAN = 8
#: Pairs of a query and a row of its group that are held at once.
AT_ONCE = 4_000_000
#: Shingles that are hashed at once.
HASHED = 1_000_000
LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One fingerprint a text: a bit is set where more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    counts: list[int] = []
    first = 0
    for k, text in enumerate(texts):
        # ASCII letters and ASCII white space only, as bytes have it.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)] if words else []
        before = len(hashes)
        hashes.extend([xxh64_intdigest(s, SEED) for s in shingles])
        counts.append(len(hashes) - before)
        if len(hashes) >= HASHED or k == len(texts) - 1:
            out[first : k + 1] = majorities(np.array(hashes, np.uint64), np.array(counts))
            hashes, counts, first = [], [], k + 1
    return out


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of several texts side by side -> fingerprints. Bits are counted 8 at once, in the bytes of a word, over runs of at most 255."""
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(full):
        return out
    n = counts[full]
    runs = -(-n // 255)
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    starts = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    found = np.zeros(len(full), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, starts).astype("<u8")
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            found |= (2 * bits[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = found
    return out


def with_fingerprints(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with ``text`` -> with ``fp`` (long). Null text counts as empty: no words, fingerprint zero."""
    kept = docs.drop("fp")
    names = [c for c in kept.columns if keep_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(fingerprints(texts).view(np.int64))], [*names, "fp"])

    return kept.mapInArrow(run, kept.select(*names).schema.add("fp", "long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of codes in Gray order; a code is its rank xor half its rank."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(s))
    return codes


def reordered(codes: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    """Codes made of bit fields (shift, width) of others, the first in front."""
    out = np.zeros(len(codes), np.uint64)
    for shift, width in fields:
        out = (out << np.uint64(width)) | ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _placed(rows: DataFrame, front: int, width: int, shared: int) -> DataFrame:
    """Rows (slot, fp, code) -> (slot, rank, fp), one for each pair of 4 blocks: the blocks of the pair come behind the first ``front`` bits of the code, the others last.

    Rows that share their first ``shared`` bits come together, in Gray order.
    """
    orders = [[*pair, *(b for b in range(4) if b not in pair)] for pair in combinations(range(4), 2)]
    fields = [[(64 - front, front)] * bool(front) + [(64 - front - width * (b + 1), width) for b in order] for order in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, fp, code = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k, f in enumerate(fields):
                rank = gray_rank(reordered(code.view(np.uint64), f)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((slot * len(fields) + k).astype(np.int32)), pa.array(rank), pa.array(fp)], ["slot", "rank", "fp"])

    out = rows.select("slot", "fp", "code").mapInArrow(run, "slot int, rank long, fp long")
    return out.withColumn("top", F.shiftrightunsigned("rank", 64 - shared)).repartition("slot", "top").sortWithinPartitions("slot", "rank").select("slot", "rank", "fp")


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of a and b; every node points at its root before and after."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent != (up := parent[parent])).any():
            parent = up


def linked(codes: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Codes of whole groups in Gray order -> for each its local component's first member. ``group`` ascends."""
    n = len(codes)
    parent = np.arange(n)
    # Levels of the index from the leaves up: bits in common, their values, first leaf, group.
    both, either, leaf, owner = codes, codes, np.arange(n), group
    levels = []
    while True:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        levels.append((~(both ^ either), both, leaf))
        if len(starts) == len(owner):
            break
        cut = np.flatnonzero(place % FAN == 0)
        both, either = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut)
        levels[-1] += (np.append(cut, len(owner)),)
        leaf, owner = leaf[cut], owner[cut]
    roots = np.searchsorted(owner, group)
    size = np.diff(np.r_[levels[-1][2], n])[roots]
    upto = np.cumsum(size)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
        q, node, apart = np.arange(begin, end), roots[begin:end], np.zeros(end - begin, np.uint8)
        for level in range(len(levels) - 2, -1, -1):
            common, value, leaf, children = levels[level]
            upper = levels[level + 1][0]
            first, many = children[node], children[node + 1] - children[node]
            at = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]
            last = np.append(leaf[1:], n)[child]
            keep = last > q[at] + 1  # a pair is met from its earlier member
            at, child = at[keep], child[keep]
            more = np.bitwise_count((codes[q[at]] ^ value[child]) & common[child] & ~upper[node[at]])
            total = apart[at] + more
            keep = total <= radius
            q, node, apart = q[at[keep]], child[keep], total[keep]
        if len(levels) > 1:
            parent = _merge(parent, q[q < node], node[q < node])
        begin = end
    return parent


def _search(placed: DataFrame, shared: int, large: int | None) -> DataFrame:
    """Output of ``_placed`` -> links (large false: fp, and other, of one component) and members of groups that are too large (true: fp, slot, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["large", "slot", "fp", "other"]
        rest: tuple[np.ndarray, ...] | None = None
        passed: tuple[int, int] | None = None  # the group whose members are being passed on

        def out(is_large: bool, slot: np.ndarray, fp: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), is_large)), pa.array(slot), pa.array(fp), pa.array(other)], names)

        def whole(slot: np.ndarray, rank: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            top = rank.view(np.uint64) >> np.uint64(64 - shared)
            new = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (top[1:] != top[:-1])])
            many = np.diff(np.r_[new, len(slot)])
            group, size = np.repeat(np.arange(len(new)), many), np.repeat(many, many)
            if large and (over := size > large).any():
                yield out(True, slot[over], fp[over], rank[over])
            pick = (size > 1) & (size <= (large or size))
            if pick.any():
                slot, rank, fp, group = slot[pick], rank[pick].view(np.uint64), fp[pick], group[pick]
                parent = linked(rank ^ (rank >> np.uint64(1)), group)
                child = np.flatnonzero(parent != np.arange(len(parent)))
                yield out(False, slot[child], fp[child], fp[parent[child]])

        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            slot, rank, fp = now
            if not len(slot):
                continue
            top = rank.view(np.uint64) >> np.uint64(64 - shared)
            if passed is not None and (more := (slot == passed[0]) & (top == np.uint64(passed[1]))).any():
                yield out(True, slot[more], fp[more], rank[more])
                slot, rank, fp, top = slot[~more], rank[~more], fp[~more], top[~more]
                if not len(slot):
                    rest = None
                    continue
            passed = None
            open_from = int(np.argmax((slot == slot[-1]) & (top == top[-1])))
            if open_from:
                yield from whole(slot[:open_from], rank[:open_from], fp[:open_from])
            rest = slot[open_from:], rank[open_from:], fp[open_from:]
            if large and len(rest[0]) > large:
                yield out(True, rest[0], rest[2], rest[1])
                passed, rest = (int(rest[0][0]), int(top[-1])), None
        if rest is not None and len(rest[0]):
            yield from whole(*rest)

    return placed.mapInArrow(run, "large boolean, slot int, fp long, other long")


def links(fingerprint: DataFrame) -> DataFrame:
    """Distinct ``fp`` -> links (fp, other) whose components are those of all pairs within the radius."""
    first = stored(_search(_placed(fingerprint.select(F.lit(0).alias("slot"), "fp", F.col("fp").alias("code")), 0, 16, 32), 32, LARGE))
    large = first.where("large").select("slot", "fp", F.col("other").bitwiseXOR(F.shiftrightunsigned("other", 1)).alias("code"))
    second = _search(_placed(large, 32, 8, 48), 48, None)
    return first.where(~F.col("large")).union(second).select("fp", "other")


def near_duplicates(fingerprinted: DataFrame) -> DataFrame:
    """Stored rows (doc_id, fp) -> (fp, component_id) for each distinct fp; the id is the component's smallest doc_id."""
    nodes = stored(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp")).select(F.col("fp").alias("a"), F.col("other").alias("b")))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = checkpointed(labelled)
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(ids, "root").select("fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def link_documents(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text -> doc_id, fp and component_id, one row a document. Rows without doc_id count by their text alone."""
    rows = stored(with_fingerprints(docs.select("doc_id", "text"), keep_text=False))
    return rows.join(near_duplicates(rows), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with its smallest doc_id, with all its columns.

    Texts are read twice and shuffled once, to meet the ids of those that stay. Rows are told apart by doc_id and a hash of
    all their columns, so that of rows which repeat a doc_id the same one stays in every run, and of equal rows one. Columns
    of ``docs`` may have any names.
    """
    id_, hash_ = F.coalesce("doc_id", F.lit(0)).alias("_id"), row_hash(docs).alias("_hash")
    rows = stored(with_fingerprints(docs.select("doc_id", "text", id_, hash_), keep_text=False))
    ids = rows.join(near_duplicates(rows), "fp")
    keep = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "_id", "_hash")).alias("k")).select("k._id", "k._hash")
    return kept_rows(docs, keep.distinct())


def kept_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id (0 for null) and ``row_hash`` are in ``keep``, once each."""
    i, h = fresh(docs, "_id", "_hash")
    marked = docs.select("*", F.coalesce("doc_id", F.lit(0)).alias(i), row_hash(docs).alias(h))
    return marked.join(keep.toDF(i, h), [i, h], "left_semi").dropDuplicates([i, h]).select(*docs.columns)
