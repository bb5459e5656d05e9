"""Phrase collocations: contiguous phrases of two and three words that occur more often than their parts' counts let expect.

Each task builds generalised suffix automata of its shards, which are the pieces of about ``SHARD_BYTES`` of text in one
language. States are the classes of word sequences with equal end positions, no deeper than three words. A state stands for its
longest sequence and that one's suffixes down to a shortest length; its suffix link is the next shorter suffix, and its count the
number of end positions. Sequences are numbered level by level with NumPy: a sequence belongs to the state of its left
extension where both have the same count. The root's count is the number of words. Counts of states, opened into the sequences
that they stand for, are reduced by equality over all shards.

There are two rounds over the texts. The first counts words and pairs and keeps those with ``LEAST`` occurrences. These go
into a Bloom filter, at most ``FILTER_BITS`` in size whatever the table's. The second goes one level deeper, but passes on only
triples both of whose pairs are in the filter: a triple that is as frequent has no rarer pair, so that none is lost, and where a
filter is too full for its pairs, more triples travel than need to. It also passes on the words of the filter themselves.

Subsumption goes by the triples' suffix links and by their prefixes: a pair is dropped if one triple with at least half of its
count has it as either.

Words are 64 bits of a hash of language and word, which other 64 bits verify; if two words of the corpus meet, hashes are made anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import discard, stored

LEAST = 10
SUBSUMED_PERCENT = 50
TOP = 2000
#: Text of one automaton.
SHARD_BYTES = 24_000_000
#: Most bits of the filter of pairs, 64 MB; a smaller corpus gets ``BITS_EACH`` for a pair or word.
FILTER_BITS = 1 << 29
BITS_EACH = 16
#: Rows of an output batch.
ROWS_OUT = 500_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Parts in which each language is ranked before the best of all parts are.
RANK_PARTS = 64
UNKNOWN = "und"

#: A-Z lower-cased, what ends a piece a newline, what ends a word a space.
_TABLE = bytes(32 if b == 9 else 10 if b in b".,;:!?" or 10 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
#: Fixed values of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Fixed value of the Fowler-Noll-Vo hash.
_PRIME = _U(0x100000001B3)


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << _U(by)) | (h >> _U(64 - by))


def spark_hash(*columns: np.ndarray) -> np.ndarray:
    """What ``xxhash64`` gives for columns of longs."""
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = (h + _P5 + _U(8)) ^ (_rotated(c.astype(np.uint64) * _P2, 31) * _P1)
        h = _rotated(h, 27) * _P1 + _P4
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        h ^= h >> _U(32)
    return h


@dataclass
class Words:
    """Words of a shard: where they are in its bytes, the number of their piece, their code."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    code: np.ndarray


def split_words(texts: list[bytes], lang: str, seed: int) -> Words:
    from xxhash import xxh64_intdigest

    data = b"\n".join(texts).translate(_TABLE)
    chars = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = (chars != 32) & (chars != 10)
    change = np.diff(inside)
    # A shard is far below 2^31 bytes, so that places and numbers of words take 32 bits; a single longer text takes 64.
    place = np.int32 if len(chars) < 1 << 31 else np.int64
    start, end = np.flatnonzero(change == 1).astype(place), np.flatnonzero(change == -1).astype(place)
    del inside, change
    piece = np.cumsum(chars == 10, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    code = np.full(len(start), xxh64_intdigest(lang.encode(), seed), np.uint64)
    length = end - start
    active, k = np.flatnonzero(length <= LONG_WORD).astype(place), 0
    while len(active):
        code[active] = (code[active] ^ chars[start[active] + k]) * _PRIME
        k += 1
        active = active[length[active] > k]
    for i in np.flatnonzero(length > LONG_WORD):
        code[i] = xxh64_intdigest(data[start[i] : end[i]], int(code[i]))
    code = (code ^ (code >> _U(32))) * _P1
    return Words(data, start, end, piece, code ^ (code >> _U(29)))


@dataclass
class Level:
    """Sequences of one length: a word's number, that of the sequence before it, that of its longest proper suffix, count, first place."""

    word: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    count: np.ndarray
    first: np.ndarray


class Automaton:
    """Generalised suffix automaton of words in pieces, ``depth`` words deep."""

    def __init__(self, code: np.ndarray, piece: np.ndarray, depth: int):
        self.codes, first, at, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        place = np.int32 if len(code) < 1 << 31 else np.int64
        none, at = np.full(len(count), -1, place), at.astype(place)
        self.levels = [Level(np.arange(len(count), dtype=place), none, none, count, first)]
        ends, word, many = np.arange(len(code), dtype=place), at, len(count)
        for _ in range(1, depth):
            # Sequences one longer: those whose next word is in the same piece.
            on = np.flatnonzero(piece[np.minimum(ends + 1, len(piece) - 1)] == piece[ends]) if len(ends) else ends
            on = on[ends[on] + 1 < len(piece)]
            before, ends_now = at[on], ends[on] + 1
            key = before.astype(np.int64) * many + word[ends_now]
            del on
            _, first, now, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            del key, _
            now = now.astype(place)
            # The suffix of a sequence ends where it ends, one level up.
            level_at = np.full(len(code), -1, place)
            level_at[ends] = at
            self.levels.append(Level(word[ends_now[first]], before[first], level_at[ends_now[first]], count, ends_now[first]))
            ends, at = ends_now, now

    def states(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of ``k`` words that are the longest of their states, and the length of the shortest sequence of each."""
        level = self.levels[k - 1]
        longest = np.ones(len(level.count), bool)
        if k < len(self.levels):
            longer = self.levels[k]
            longest[longer.suffix[longer.count == level.count[longer.suffix]]] = False
        states = np.flatnonzero(longest)
        shortest, at, same = np.full(len(states), k), states, np.ones(len(states), bool)
        for j in range(k - 1, 0, -1):
            link = self.levels[j].suffix[at]
            same = same & (self.levels[j - 1].count[link] == level.count[states])
            shortest[same] = j
            at = link
        return states, shortest

    def sequence(self, k: int, which: np.ndarray) -> list[np.ndarray]:
        """Codes of the words of sequences of ``k`` words."""
        out = []
        for j in range(k - 1, -1, -1):
            out.append(self.codes[self.levels[j].word[which]])
            which = self.levels[j].prefix[which]
        return out[::-1]


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, text) in batches -> so much text of one language as fills a shard, or what is left of it in the end."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = text.as_py() or b""
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if sum(size.values()) >= shard_bytes:
                most = max(size, key=size.get)
                yield most, held.pop(most)
                del size[most]
    yield from held.items()


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _slices(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS_OUT):
        yield pa.RecordBatch.from_arrays([c.slice(i, ROWS_OUT) for c in columns], names)


def _checks(words: Words, first: np.ndarray, lang: str) -> np.ndarray:
    """Other 64 bits of words, by the first place of each."""
    from xxhash import xxh64_intdigest

    seed, data = xxh64_intdigest(lang.encode(), 7), words.data
    return np.fromiter((xxh64_intdigest(data[s:e], seed) for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)), np.uint64, len(first))


def count_pairs(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, text) -> (w1, w2, n, least_check, most_check): pairs, words (w1 null), and the root of each language as a word whose code is its name's hash."""
    from xxhash import xxh64_intdigest

    names, shard_bytes = ["w1", "w2", "shortest", "n", "check"], SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _shards(batches, shard_bytes):
            words = split_words(texts, lang, seed)
            automaton = Automaton(words.code, words.piece, 2)
            root, check = (np.array([xxh64_intdigest(lang.encode(), s)], np.uint64) for s in (42, 7))
            yield from _slices([pa.nulls(1, pa.int64()), _signed(root), pa.array([1], pa.int32()), pa.array([len(words.code)]), _signed(check)], names)
            for k in (1, 2):
                states, shortest = automaton.states(k)
                codes, n = automaton.sequence(k, states), automaton.levels[k - 1].count[states]
                # The word of a state is checked where the state stands for it alone, too.
                check, single = np.zeros(len(states), np.uint64), np.flatnonzero(shortest == 1)
                check[single] = _checks(words, automaton.levels[k - 1].first[states[single]], lang)
                w1 = _signed(codes[0]) if k == 2 else pa.nulls(len(states), pa.int64())
                yield from _slices([w1, _signed(codes[-1]), pa.array(shortest.astype(np.int32)), pa.array(n), _signed(check)], names)

    states = docs.mapInArrow(run, "w1 long, w2 long, shortest int, n long, check long")
    # A state opens into the sequences that it stands for.
    both = F.array(F.struct("w1", F.lit(None).cast("long").alias("check")), F.struct(F.lit(None).cast("long").alias("w1"), "check"))
    alone = F.array(F.struct("w1", F.when(F.col("w1").isNull(), F.col("check")).alias("check")))
    opened = states.select("w2", "n", F.inline(F.when(F.col("w1").isNotNull() & (F.col("shortest") == 1), both).otherwise(alone)))
    # Shards have counted already; a second partial count before the shuffle would find little to merge.
    dealt = opened.select("w1", "w2", "n", "check").repartition("w1", "w2")
    return dealt.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("check").alias("least_check"), F.max("check").alias("most_check"))


def totals(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, n): counts of the roots. Only languages with ``LEAST`` words have one here."""
    roots = frequent.where("w1 IS NULL").select("w2", "n")
    return docs.select("lang").distinct().join(roots, F.xxhash64("lang") == F.col("w2")).select("lang", "n")


def bloom_filter(frequent: DataFrame) -> np.ndarray:
    """(w1, w2) -> bits of a filter, two a row, made by bit maps of 32,768 bits that the driver only joins."""
    bits = 1 << 15
    n = frequent.count()
    while bits < min(FILTER_BITS, n * BITS_EACH):
        bits *= 2
    h = F.xxhash64("w1", "w2")
    place = F.array(h.bitwiseAND(bits - 1) + 1, F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1) + 1)
    places = frequent.select(F.explode(place).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    found, out = places.toArrow(), np.zeros(bits // 8, np.uint8)
    for bucket, part in zip(found.column("bucket").to_pylist(), found.column("map"), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part.as_py(), np.uint8)
    return out


def in_filter(bits: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    h, last = spark_hash(*columns), _U(len(bits) * 8 - 1)
    seen = np.ones(len(h), bool)
    for place in (h & last, (h >> _U(32)) & last):
        seen &= (bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
    return seen


def count_triples(docs: DataFrame, frequent: DataFrame, seed: int) -> DataFrame:
    """(lang, text) -> (w1, w2, w3, n, lang, word): triples whose pairs are in the filter of ``frequent``, and its words (w2 and w3 null)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(frequent))
    names, shard_bytes = ["w1", "w2", "w3", "n", "lang", "word"], SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for lang, texts in _shards(batches, shard_bytes):
            words = split_words(texts, lang, seed)
            automaton = Automaton(words.code, words.piece, 3)
            one, two, three = automaton.levels
            known = np.flatnonzero(in_filter(bits, automaton.codes))
            own = [words.data[words.start[f] : words.end[f]] for f in one.first[known].tolist()]
            none = pa.nulls(len(known), pa.int64())
            text = pa.array(own, pa.binary()).cast(pa.string())
            yield from _slices([_signed(automaton.codes[known]), none, none, none, pa.array([lang] * len(known), pa.string()), text], names)
            pair = in_filter(bits, *automaton.sequence(2, np.arange(len(two.count))))
            # No state is cut by the depth here: all triples are the longest of theirs.
            some = np.flatnonzero(pair[three.prefix] & pair[three.suffix])
            blank = pa.nulls(len(some), pa.string())
            yield from _slices([*map(_signed, automaton.sequence(3, some)), pa.array(three.count[some]), blank, blank], names)

    found = docs.mapInArrow(run, "w1 long, w2 long, w3 long, n long, lang string, word string").repartition("w1", "w2", "w3")
    return found.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n"), F.min("lang").alias("lang"), F.min("word").alias("word"))


def association(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10^15."""
    return F.expr(f"(1000000BD * cast({a} AS decimal(15, 0)) * cast({a} AS decimal(15, 0))) div (cast({left} AS decimal(18, 0)) * cast({right} AS decimal(18, 0)))")


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, text) -> frequent pairs and words (w1, w2, n), and frequent triples with words (w1, w2, w3, n, lang, word), both stored."""
    for seed in range(8):
        pairs = count_pairs(docs, seed)
        met = F.col("least_check") != F.col("most_check")
        pairs = stored(pairs.where((F.col("n") >= LEAST) | met).select("w1", "w2", "n", F.coalesce(met, F.lit(False)).alias("met")))
        if pairs.where("met").isEmpty():
            frequent = pairs.drop("met")
            return frequent, stored(count_triples(docs, frequent, seed).where(F.col("w3").isNull() | (F.col("n") >= LEAST)))
        discard(pairs)
    raise ValueError("words of the corpus meet in all hashes")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """docs with lang and text -> lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language.

    Only these columns are read, so others can't clash. Null text has no words; null lang is ``und``, one with documents that
    say so. Repeated rows count as often. The empty table, and one without a frequent phrase, have no rows. Ties of score and
    count are broken by the phrase, so that ranks are unique.
    """
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, deeper = counted(docs)
    names = deeper.where("w2 IS NULL").select(F.col("w1").alias("w"), "lang", "word")
    words = frequent.where("w1 IS NULL").select(F.col("w2").alias("w"), F.col("n").alias("f")).join(names, "w")
    left = words.select(F.col("w").alias("w1"), "lang", F.col("word").alias("s1"), F.col("f").alias("f1"))
    right = words.select(F.col("w").alias("w2"), F.col("word").alias("s2"), F.col("f").alias("f2"))
    pairs = frequent.where("w1 IS NOT NULL").withColumnRenamed("n", "a").join(left, "w1").join(right, "w2")
    triples = deeper.where("w3 IS NOT NULL").select("w1", "w2", "w3", F.col("n").alias("a"))
    # Prefixes and suffix links of triples.
    longer = triples.select(F.inline(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    kept = pairs.join(longer, ["w1", "w2"], "left").where(f"longest IS NULL OR 100 * longest < {SUBSUMED_PERCENT} * a")
    head = pairs.select("w1", "w2", "lang", "s1", "s2", "f1", F.col("a").alias("a12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("s2").alias("s3"), F.col("f2").alias("f3"), F.col("a").alias("a23"))
    whole = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    cut = lambda k, l, r: F.struct(association("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    phrases = kept.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", cut(1, "f1", "f2").alias("cut")).union(
        whole.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", F.least(cut(1, "f1", "a23"), cut(2, "a12", "f3")).alias("cut"))
    )
    phrases = phrases.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals(docs, frequent), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, words FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))
), placed AS (
  SELECT lang, p, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM pieces
), ahead AS (
  SELECT lang, w, lead(w) OVER piece AS w2, lead(w, 2) OVER piece AS w3 FROM placed WINDOW piece AS (PARTITION BY p ORDER BY i)
), ones AS (SELECT lang, w, count(*) AS f FROM ahead GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang),
twos AS (SELECT lang, w, w2, count(*) AS a FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
threes AS (SELECT lang, w, w2, w3, count(*) AS a FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w, w2, max(a) AS longest FROM (SELECT lang, w, w2, a FROM threes UNION ALL SELECT lang, w2, w3, a FROM threes) GROUP BY ALL
), cuts AS (
  SELECT t.lang, w || ' ' || t.w2 AS phrase, t.a, 1 AS k, x.f AS l, y.f AS r
  FROM twos t JOIN ones x USING (lang, w) JOIN ones y ON y.lang = t.lang AND y.w = t.w2 LEFT JOIN longer g USING (lang, w, w2)
  WHERE longest IS NULL OR 100 * longest < 50 * t.a
  UNION ALL
  SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.a, 1, x.f, y.a
  FROM threes t JOIN ones x ON x.lang = t.lang AND x.w = t.w JOIN twos y ON y.lang = t.lang AND y.w = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3, t.a, 2, x.a, y.f
  FROM threes t JOIN twos x ON x.lang = t.lang AND x.w = t.w AND x.w2 = t.w2 JOIN ones y ON y.lang = t.lang AND y.w = t.w3
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE c = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
