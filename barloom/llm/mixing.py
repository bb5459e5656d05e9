"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are sorted by the key, a distributed prefix sum of
their sizes is computed, and the source is cut exactly at its budget. A budget above the source's size first takes
whole epochs.

The key space of a source is divided into equal ranges. The totals of the ranges are summed up first, over a table
with a few rows a source, and the running sum then starts within each range at what the earlier ranges hold. So
neither a hot source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import fresh, row_hash, stored, word_count

#: Weights of the sources in code-point order, null last; they repeat.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: A target stops at so many times its source's size.
MOST_EPOCHS = 2
#: Rows of a key range to aim for, and the least that are worth one where Spark has more shuffle partitions than that needs.
RANGE_ROWS, LEAST_RANGE_ROWS = 50_000, 500
#: Rows alike in doc_id, source and size from which they are dealt over ``SALTS`` keys.
MANY_ALIKE, SALTS = 10_000, 256
#: Hexadecimal digits of the key that number its range.
RANGE_DIGITS = 7


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """Hash-random order of documents: hexadecimal digits, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target.

    A target is min(most * size, level * weight), with the one level at which the targets add up: what resharing the
    excess by weight, until no source is above its limit, arrives at. With sources in order of limit / weight, the
    first k stop at their limits where the level for the rest is not above the next one's limit. The table has one row
    a source, so its windows over all rows are small.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    by_fill = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("limit").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    leveled = ranked.withColumn("level", (total * F.lit(share) - before) / left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    filled = leveled.withColumn("level", level)
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size) -> with source_size, target, epochs (whole passes) and cut_words (words of one more pass).

    A source's epochs * size + cut_words add up to its target, rounded to a word. At most one document a source is cut
    within its text. Null sources form a source of their own; an empty one gets nothing. Rows that repeat are as many
    documents. Documents of one key are taken in order of doc_id, then size. Rows that are alike in doc_id, source and size
    are counted before they meet, so that neither copies of a row nor rows without doc_id are one task's work. Only the three
    columns are read, so others can't clash.
    """
    alike = docs.select("doc_id", "source", "size", random_key(F.col("doc_id"), seed).alias("key")).groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("copies"))
    rows = stored(alike)
    words = F.col("size") * F.col("copies")
    sizes = targets(rows.groupBy("source").agg(F.sum(words).alias("source_size")), weights, share, most)
    # A power of two that grows with the number of rows and of partitions.
    many = rows.count()
    n = max(1, many // RANGE_ROWS, min(many // LEAST_RANGE_ROWS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranges = 1 << (n - 1).bit_length()
    number = F.floor(F.conv(F.substring("key", 1, RANGE_DIGITS), 16, 10).cast("long") * ranges / 16**RANGE_DIGITS).cast("int")
    rows = rows.withColumn("range", number)
    totals = rows.groupBy("source", "range").agg(F.sum(words).alias("words"))
    running = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("source", "range", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("start"))
    plan = starts.alias("s").join(sizes.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "range", "start", "source_size", "target")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("earlier", F.coalesce(F.sum(words).over(within), F.lit(0)))
    joined = summed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("start") - F.col("earlier") - F.col("copy") * F.col("size"))).cast("long")
    return joined.select("doc_id", "d.source", "size", "source_size", "target", epochs.alias("epochs"), cut.alias("cut_words"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Mixing of ``documents``: one row a document with ``taken``, the words that the mix takes of it."""
    mixed = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut_words"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """docs -> each row as often as the mix takes it, with all its columns.

    Documents stay whole: the one at a source's cut is taken once more if at least half of it is within the budget.
    Rows that are alike in doc_id, source and size share evenly what the mix takes of them, in order of a hash of all their
    columns. Texts are shuffled once, by these three and a salt for those of many alike rows. Columns of ``docs`` may have any
    names.
    """
    size, salt, number_, times_, count = fresh(docs, "_size", "_salt", "_number", "_times", "_count")
    sized = docs.withColumn(size, word_count(F.col("text")))
    mixed = mix(sized.select("doc_id", "source", F.col(size).alias("size")))
    once = F.when((F.col("size") > 0) & (2 * F.col("cut_words") >= F.col("size")), 1).otherwise(0)
    taken = mixed.groupBy("doc_id", "source", "size").agg(F.sum(F.col("epochs") + once).alias("all"), F.count("*").alias("alike")).where(F.col("all") > 0)
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "all", "alike")
    key = lambda i, s, n: F.concat_ws("\x1f", F.coalesce(i.cast("string"), F.lit("\x00")), F.coalesce(s, F.lit("\x00")), n)
    few = taken.where(F.col("alike") <= MANY_ALIKE)
    rows = sized.withColumn(number_, key(F.col("doc_id"), F.col("source"), F.col(size)))
    few = few.select(key(F.col("t_id"), F.col("t_source"), F.col("t_size")).alias("k"), F.col("all").alias(times_), F.col("alike").alias(count))
    parts = [rows.join(few, F.col(number_) == F.col("k")).drop("k")]
    many = stored(taken.where(F.col("alike") > MANY_ALIKE))
    if not many.isEmpty():
        # Of so many alike rows each takes the same, by the share of a hash; a rest below one epoch is settled among those of one salt.
        salted = many.select(key(F.col("t_id"), F.col("t_source"), F.col("t_size")).alias("k"), "all", "alike", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        own = rows.withColumn(salt, F.pmod(row_hash(docs), F.lit(SALTS)).cast("int"))
        sizes = own.join(F.broadcast(many.select(key(F.col("t_id"), F.col("t_source"), F.col("t_size")).alias("m"))), F.col(number_) == F.col("m"), "left_semi").groupBy(F.col(number_).alias("k"), F.col(salt).alias("s")).agg(F.count("*").alias("here"))
        upto = F.sum("here").over(W.partitionBy("k").orderBy("s"))
        dealt = sizes.join(salted, ["k", "s"]).withColumn("upto", upto)
        part = lambda n: F.floor(F.col("all") * n / F.col("alike"))
        dealt = dealt.select("k", "s", (part(F.col("upto")) - part(F.col("upto") - F.col("here"))).alias(times_), F.col("here").alias(count))
        parts.append(own.join(dealt, (F.col(number_) == F.col("k")) & (F.col(salt) == F.col("s"))).withColumn(number_, F.concat_ws("\x1f", number_, salt)).drop("k", "s", salt))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    place = F.row_number().over(W.partitionBy(number_).orderBy(row_hash(docs)))
    share = F.floor(F.col(times_) / F.col(count)) + F.when(place <= F.col(times_) % F.col(count), 1).otherwise(0)
    each = met.withColumn(times_, share.cast("int")).where(F.col(times_) > 0)
    return each.withColumn(times_, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 2 * source_size AS lim FROM s),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
          - coalesce(CAST(sum(lim) OVER (ORDER BY lim::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
          / CAST(sum(weight) OVER (ORDER BY lim::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
l AS (SELECT arg_min(level, struct_pack(a := lim::DOUBLE / weight, b := rank)) FILTER (level * weight <= lim) AS level FROM v),
t AS (SELECT v.source, source_size, least(lim::DOUBLE, coalesce(l.level * weight, lim::DOUBLE)) AS target FROM v, l),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS earlier
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, coalesce(budget // nullif(source_size, 0), 0) AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken
FROM e
"""
