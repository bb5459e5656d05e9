"""Filter interaction audit by inclusion-exclusion.

Filters are boolean columns that say whether a document fails. One pass sums, for each part of the corpus and each of the 2^n
sets of filters, the products of their flags: J[S] documents fail all filters of S. All else follows from J by Möbius
inversion, without a further look at documents:

- survivors of a set P: the sum of (-1)^|S| J[S] over S within P;
- what a filter removes behind P: survivors of P less survivors of P and the filter; what of its failures others took before: the rest of J[{f}];
- documents that fail f alone: the sum of (-1)^(|S|-1) J[S] over all S with f;
- the Shapley value of f in the game v(P) = removed by P, whose Harsanyi dividends are (-1)^(|S|-1) J[S], each shared by the members of S.
  Over all n! orders that is the sum of n!/|S| times the dividends of S with f, a whole number.

The same sums, weighted by labels, give the good and toxic documents that are lost.

Texts are compared by 128 bits of a hash. The smallest doc_id of a text is found by a partial aggregation; documents then look it up by
(digest, doc_id), so that rows of one text are dealt by doc_id and none is hot.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import WORD

#: Most filters of an audit: it lists all their orders.
MOST_FILTERS = 7
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def text_failures(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text, lang -> (doc, part, h1, h2, A, B, C, D): four filters on each text alone, and its digest. Null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+").alias("words"))
    n_words = F.regexp_count("text", F.lit(WORD))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    return rows.select(
        "doc", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
        (n_words < LEAST_WORDS).alias("A"),
        # The one empty word of a text without words makes no difference: 100 < 0 is false.
        (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT_PERCENT * n_words).alias("B"),
        (100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length("text")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """(doc, h1, h2, ...) -> also E: a smaller doc has the same text. Null docs are no one's repeats, nor has anyone repeats of them."""
    first = rows.where(F.col("doc").isNotNull()).groupBy("h1", "h2").agg(F.min("doc").alias("doc")).withColumn("is_first", F.lit(True))
    return rows.join(first, ["h1", "h2", "doc"], "left").withColumn("E", F.col("doc").isNotNull() & F.col("is_first").isNull()).drop("is_first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, h1, ...) -> also good and toxic; false where ``labels`` says nothing, true if one of several labels says so."""
    label = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled"))
    label = label.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"), F.lit(0).cast("long").alias("deal"))
    # Rows without a doc meet no label; they are dealt out by their text.
    rows = rows.withColumn("spread", F.when(F.col("doc").isNull(), F.col("h1")).otherwise(0))
    met = rows.join(label, (rows["doc"] == label["labelled"]) & (rows["spread"] == label["deal"]), "left")
    return met.drop("labelled", "deal", "spread").withColumns({k: F.coalesce(F.col(k), F.lit(False)) for k in ("good", "toxic")})


def joint_failures(rows: DataFrame, part: str, filters: str | list[str], weights: dict[str, Column]) -> DataFrame:
    """Boolean columns of filters -> one row a part: for each weight an array of 2^n sums, at S those of rows that fail all filters of S (bit i: the i-th filter)."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders; {MOST_FILTERS} at most")
    flags = [F.coalesce(F.col(f"`{f}`"), F.lit(False)).cast("long") for f in filters]

    def product(of: int, weight: Column) -> Column:
        for i, flag in enumerate(flags):
            if of >> i & 1:
                weight = weight * flag
        return weight

    sets = range(1 << len(filters))
    sums = [F.sum(product(s, w.cast("long"))).alias(f"{name}_{s}") for name, w in weights.items() for s in sets]
    return rows.groupBy(part).agg(*sums).select(part, *[F.array(*[f"{name}_{s}" for s in sets]).alias(name) for name in weights])


def _signed(joint: str, condition: str, weight: str = "1L") -> str:
    """SQL: the sum of (-1)^|S| J[S] times ``weight`` over the sets S that meet ``condition``."""
    return f"aggregate(sequence(0, size({joint}) - 1), 0L, (sum, s) -> sum + if({condition}, if(bit_count(s) % 2 = 0, 1L, -1L) * {weight} * {joint}[s], 0L))"


def report(joint: DataFrame, part: str, filters: str | list[str], lost: dict[str, str]) -> DataFrame:
    """Joint failures -> for each part, order and step: kept, removed, redundant, unique_fails, a column for each of ``lost`` (name: weight), shapley."""
    n = len(filters)
    steps = [(order, step, order[step - 1], sum(1 << f for f in order[: step - 1])) for order in permutations(range(n)) for step in range(1, n + 1)]
    spark = SparkSession.getActiveSession() or joint.sparkSession
    # Literals in the JVM, n! * n of them; the parts of a corpus are few beside its documents.
    listed = ",".join(f"('{''.join(filters[f] for f in order)}',{step},{f},{before})" for order, step, f, before in steps)
    orders = spark.sql(f"SELECT * FROM VALUES {listed} AS t(filter_order, step, f, before)")
    survivors = lambda j: F.expr(f"transform(sequence(0, size({j}) - 1), p -> {_signed(j, '(s & ~p) = 0')})")
    each = joint.select(
        part, F.col("n").alias("joint"), survivors("n").alias("left_n"), *[survivors(w).alias(f"left_{w}") for w in lost.values()],
        F.expr(f"transform(sequence(0, {n - 1}), f -> -{_signed('n', '(s & shiftleft(1, f)) <> 0')})").alias("unique"),
        F.expr(f"transform(sequence(0, {n - 1}), f -> -{_signed('n', '(s & shiftleft(1, f)) <> 0', f'({factorial(n)} div greatest(bit_count(s), 1))')})").alias("value"),
    )
    after, bit = F.expr("before | shiftleft(1, f)"), F.expr("shiftleft(1, f)")
    taken = lambda w: F.col(f"left_{w}")[F.col("before")] - F.col(f"left_{w}")[after]
    return each.crossJoin(F.broadcast(orders)).select(
        part, "filter_order", F.col("step").cast("int").alias("step"), F.col("left_n")[after].alias("kept"), taken("n").alias("removed"),
        (F.col("joint")[bit] - taken("n")).alias("redundant"), F.col("unique")[F.col("f")].alias("unique_fails"),
        *[taken(w).alias(name) for name, w in lost.items()], F.col("value")[F.col("f")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with doc_id, text, lang and labels with doc_id, quality, toxic -> the report of filters A to E by language.

    Only these columns are read, so others can't clash. Null text is empty, null lang the part ''. Repeated rows are as many
    documents; with equal doc_ids none is the other's repeat. The empty table has no parts and no rows.
    """
    rows = with_labels(with_repeats(text_failures(docs)), labels)
    weights = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return report(joint_failures(rows, "part", "ABCDE", weights), "part", "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
flags AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (d.doc_id > first_id)::INT AS fails
  FROM docs d JOIN firsts USING (text) LEFT JOIN labels l ON l.doc_id = d.doc_id
), patterns AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY part, fails
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, s.step, bits[s.step] AS bit, list_sum(bits[1:s.step - 1])::BIGINT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE (fails & (coalesce(before, 0) | bit)) = 0) AS kept,
    sum(n) FILTER (WHERE (fails & coalesce(before, 0)) = 0 AND (fails & bit) > 0) AS removed,
    sum(n) FILTER (WHERE (fails & coalesce(before, 0)) > 0 AND (fails & bit) > 0) AS redundant,
    sum(n) FILTER (WHERE fails = bit) AS unique_fails,
    sum(good) FILTER (WHERE (fails & coalesce(before, 0)) = 0 AND (fails & bit) > 0) AS good_lost,
    sum(toxic) FILTER (WHERE (fails & coalesce(before, 0)) = 0 AND (fails & bit) > 0) AS toxic_lost
  FROM patterns, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
