"""Line dedup: lines that many documents share go from all but the largest doc_id that holds them.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``LEAST_CHARS`` code points
that at least ``LEAST_DOCS`` documents hold are common. Lines become rows of hashes and positions, which are dealt in ranges
of the key's hash with a secondary sort by document and position. Each range streams over its rows and passes on the first
occurrence of a key in each of its ``LEAST_DOCS`` largest documents. That many decide exactly whether a key is common, and
which document is largest, however the ranges cut a key. A salt of the line's place is the second column of the ranges, so
that no key is hot: a common key's rows fall into ``SALTS`` pieces, and no more than ``SALTS * LEAST_DOCS`` rows of it meet.

The result is no text but a bitmap of each document: 64-bit words with the bits of lines that stay. Words without a dropped
line aren't stored. Bits are set by ``bit_or``, so that repeated rows and repeated lines merge before they travel.

Documents are told apart by doc_id and 128 bits of their text. Rows that agree in both get one decision. Null doc_ids count
as one document that is smaller than all others; null text is empty text, which has one empty line. No Python runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import fresh

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Pieces of a key's rows.
SALTS = 256
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digests(c: Column) -> tuple[Column, Column]:
    """128 bits of a hash."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text) -> (h1, h2, salt, doc, t1, t2, pos), a row for each line whose key is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t1, t2 = _digests(text)
    lines = docs.select(F.col("doc_id").alias("doc"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", F.btrim("line", F.lit(SPACE))).where(F.length("key") >= least_chars)
    h1, h2 = _digests(F.translate("key", UPPER, LOWER))
    lines = lines.select(h1.alias("h1"), h2.alias("h2"), "doc", "t1", "t2", "pos")
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc", "t1", "pos"), F.lit(SALTS)).cast("int"))


def common_pieces(dealt: DataFrame, least_docs: int) -> DataFrame:
    """Lines in ranges of (h1, salt) -> (h1, h2, salt, largest): each piece of a common key with the largest document that holds it."""
    order = [F.desc_nulls_last("doc")]
    new = lambda w: (F.lag(F.lit(1)).over(w).isNull() | ~F.lag("doc").over(w).eqNullSafe(F.col("doc"))).cast("int")
    stream = W.partitionBy("h1", "salt", "h2").orderBy(*order, "pos")
    firsts = dealt.select("h1", "salt", "h2", "doc", F.dense_rank().over(W.partitionBy("h1", "salt", "h2").orderBy(*order)).alias("place"), new(stream).alias("new"))
    firsts = firsts.where(F.col("new") == 1).where(F.col("place") <= least_docs)
    # What streams have passed on meets by key: SALTS * least_docs rows at most.
    key = W.partitionBy("h1", "h2")
    met = firsts.repartition("h1", "h2").select("h1", "h2", "salt", "doc", "place", new(key.orderBy(*order)).alias("new"))
    met = met.select("h1", "h2", "salt", "place", F.sum("new").over(key).alias("n_docs"), F.max("doc").over(key).alias("largest"))
    return met.where((F.col("n_docs") >= least_docs) & (F.col("place") == 1)).select("h1", "h2", "salt", "largest")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text) -> (doc, t1, t2, n_dropped, kept), a row for each document that loses a line.

    ``t1`` and ``t2`` are digests of its text. ``kept`` is an array of (word, bits), ascending: bit b of word w is 1 if line
    64 * w + b stays. Words that lose no line aren't stored; bits beyond the last line are 1.
    """
    dealt = lines_of(docs, least_chars).repartitionByRange("h1", "salt")
    gone = dealt.join(common_pieces(dealt, least_docs), ["h1", "h2", "salt"]).where(F.col("doc").isNull() | (F.col("doc") < F.col("largest")))
    words = gone.groupBy("doc", "t1", "t2", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    bits = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc", "t1", "t2").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(bits)).alias("kept"))


def apply_bitmap(text: Column, kept: Column) -> Column:
    """The lines of ``text`` that stay, joined by newlines. A null bitmap keeps all."""
    lines = F.split(text, "\n")
    # The array of one struct binds its fields, so that inner functions don't compute them for each line again.
    bound = lambda inner, **fields: F.transform(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])), inner)[0]
    dropped_bits = lambda w: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", w["bits"], b) == 0)
    gone = F.flatten(F.transform(kept, lambda w: F.transform(dropped_bits(w), lambda b: w["word"] * 64 + b)))
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    between = lambda x, i: F.slice(x["lines"], x["edges"][i] + 2, x["edges"][i + 1] - x["edges"][i] - 1)
    stay = bound(lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["edges"]) - 2), lambda i: between(x, i))), lines=lines, edges=edges)
    return F.when(kept.isNull(), text).otherwise(F.array_join(stay, "\n"))


def drop_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with doc_id and text -> all its columns, ``text`` without common lines, then n_lines and n_dropped (longs) and kept, the bitmap.

    Null text becomes empty text. The three new columns get a "_" at the end where docs has such names already, which stay.
    The empty table has no rows. Rows that share doc_id and text get the same bitmap.
    """
    n_lines, n_dropped, kept, doc, t1, t2 = fresh(docs, "n_lines", "n_dropped", "kept", "doc", "t1", "t2")
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), least_chars, least_docs).toDF(doc, t1, t2, n_dropped, kept)
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.withColumn("text", text)
    one, two = _digests(F.col("text"))
    met = left.join(bitmaps, left["doc_id"].eqNullSafe(bitmaps[doc]) & (one == bitmaps[t1]) & (two == bitmaps[t2]), "left")
    keep = [F.col(f"`{c}`") if c != "text" else apply_bitmap(F.col("text"), F.col(kept)).alias("text") for c in docs.columns]
    return met.select(*keep, F.size(F.split("text", "\n")).cast("long").alias(n_lines), F.coalesce(F.col(n_dropped), F.lit(0)).cast("long").alias(n_dropped), kept)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < largest) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE largest IS NULL OR doc_id >= largest), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k)
GROUP BY doc_id
"""
