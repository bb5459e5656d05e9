"""Quality rules with adaptive thresholds.

Each document is measured once. Quantiles of the measures are kept per language and source in mergeable sketches:
counts of logarithmic buckets, so that sketches of parts add up to the sketch of the whole and a quantile has a
relative error of at most ``GAMMA`` - 1. A group's quantiles are drawn towards those of its language, and these towards
those of the whole table, by ``PRIOR`` rows' weight, so that small groups need no rule of their own. A document is
rejected when a measure lies further above the middle of its group than ``SPREADS`` times the way from the middle to
the 85 % quantile. Neither quantile moves much while fewer than 15 % of a group are junk, and what is usual in a source,
such as capitals in German or symbols in code, is usual there.

Everything is DataFrame functions. Arrays of words stay inside their row: nothing is exploded by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import WORD, stored

#: Words of a window whose repetition counts. Three doublings of neighbouring hashes make it.
WINDOW = 8
#: A base rule: fewer words fail.
LEAST_WORDS = 20
#: A base rule: a larger percentage of words in repeated windows fails.
MOST_REPEATED = 30
#: Adaptive measures. The first four are rates in millionths with one event added, over a length with some added, so that
#: short texts aren't judged by one event and a rate varies where most documents have no event. The last is in thousandths.
MEASURES = ("symbols", "echoes", "capitals", "line_copies", "word_length")
#: What is added to the lengths: characters, words, characters, lines.
ADDED = {"symbols": 1000, "echoes": 100, "capitals": 1000, "line_copies": 2}
#: Quantiles of a sketch that make a limit, and how many times their distance is added to the first.
MIDDLE, UPPER, SPREADS = 0.5, 0.85, 6
#: That distance is at least this share of the middle: documents of a very even group may differ somewhat.
LEAST_SPREAD = 0.05
#: Ratio of the limits of a sketch's neighbouring buckets.
GAMMA = 1.02
#: Rows that the parent's quantiles count as when a group's are drawn towards them.
PRIOR = 50
#: Groups of language and source whose thresholds are broadcast; each takes some 200 bytes.
BROADCAST_GROUPS = 50_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _neighbours(hashes: str, step: int) -> Column:
    """One hash for each pair of elements that are ``step`` apart."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def measure(docs: DataFrame) -> DataFrame:
    """docs with ``text`` -> with the base measures and ``adaptive``, a struct of the others.

    Null and empty texts have no words, and zero in the base measures. Windows are compared by a 64-bit hash; within one
    document of n words two windows are confused with a probability below n * n / 2 ** 65.
    Columns of ``docs`` that have a measure's name are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    made = [*BASE, "adaptive", "_capitals", "_words", "_lines", "_h1", "_h2", "_h4", "_h8", "_sorted", "_starts"]
    df = docs.drop(*made).withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), 0), "_lines": F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))})
    df = df.withColumns({
        "_h1": F.transform("_words", lambda x: F.xxhash64(x)),
        "n_words": F.size("_words").cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_words")
    df = df.withColumn("_h2", _neighbours("_h1", 1)).withColumn("_h4", _neighbours("_h2", 2)).withColumn("_h8", _neighbours("_h4", 4))
    # Windows in order of hash; only texts with a repeated window need them.
    numbered = F.zip_with("_h8", F.sequence(F.lit(0), F.size("_h8") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.array_sort(numbered)))
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i"))
    later, earlier = F.concat(F.slice("_sorted", 2, F.size("_sorted") - 1), F.array(none)), F.concat(F.array(none), F.slice("_sorted", 1, F.size("_sorted") - 1))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    marks = F.zip_with(F.zip_with("_sorted", later, lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), same(x, y).alias("twice"))), earlier, lambda x, y: F.when(x["twice"] | same(x, y), x["i"]))
    df = df.withColumn("_starts", F.array_sort(F.filter(marks, lambda x: x.isNotNull())))
    # Each start covers its window up to the next start.
    gaps = F.zip_with("_starts", F.slice("_starts", 2, F.size("_starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    m = F.greatest(F.size("_h1") - 1, F.lit(0))
    echoes = F.size(F.filter(F.zip_with(F.slice("_h1", 1, m), F.slice("_h1", 2, m), lambda a, b: a == b), lambda x: x))
    rate = lambda name, events, length: F.floor((events + 1).cast("long") * 1_000_000 / (length + ADDED[name])).cast("long").alias(name)
    df = df.withColumn("adaptive", F.struct(
        rate("symbols", F.col("n_symbols"), F.col("word_chars")),
        rate("echoes", echoes, F.col("n_words")),
        rate("capitals", F.col("_capitals"), F.col("word_chars")),
        rate("line_copies", F.col("n_dup_lines"), F.size("_lines")),
        F.coalesce(F.floor(F.try_divide(F.col("word_chars") * 1000, F.col("n_words"))), F.lit(0)).cast("long").alias("word_length"),
    ))
    return df.drop("_lines", "_capitals", "_h1", "_h2", "_h4", "_h8", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) -> number of rows that pass the base rules. Sketches of parts merge by adding up the counts."""
    # A filter would be moved below the measures and repeat their expressions.
    each = F.explode(F.when(~base_failed(), F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"adaptive.{m}").alias("x")) for m in MEASURES])))
    rows = measured.select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", "m.x")
    bucket = F.when(F.col("x") <= 0, F.lit(-1)).otherwise(F.ceil(F.ln("x") / F.ln(F.lit(GAMMA)))).cast("int")
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged by the columns ``by`` -> rows, the middle and the upper quantile of each measure, at the limits of buckets."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "measure")
    merged = merged.withColumns({"rows": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))})
    value = F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("rows") * q, value))
    return merged.groupBy(*by, "measure").agg(F.first("rows").alias("rows"), at(MIDDLE).alias("middle"), at(UPPER).alias("upper"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source) -> ``limits``, a map from measure to the largest value that passes."""
    own, lang, whole = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    both = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure"))).join(whole.alias("w"), F.col("o.measure") == F.col("w.measure"))

    def drawn(rows: Column, value: Column, parent: Column) -> Column:
        return (rows * value + PRIOR * parent) / (rows + PRIOR)

    middle, upper = (drawn(F.col("o.rows"), F.col(f"o.{q}"), drawn(F.col("l.rows"), F.col(f"l.{q}"), F.col(f"w.{q}"))) for q in ("middle", "upper"))
    rows = both.select("o.lang", "o.source", F.struct(F.col("o.measure").alias("k"), (middle + SPREADS * F.greatest(upper - middle, middle * LEAST_SPREAD)).alias("v")).alias("e"))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list("e")).alias("limits"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Output of ``measure`` and stored thresholds -> with base_failed and kept. Null languages and sources form groups of their own.

    Thresholds of up to ``BROADCAST_GROUPS`` groups are broadcast; more of them are joined as Spark sees fit.
    """
    limits = limits.select(*[F.col(c).alias(f"_t_{c}") for c in limits.columns])
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    joined = measured.drop(*limits.columns).join(limits, F.col("lang").eqNullSafe(F.col("_t_lang")) & F.col("source").eqNullSafe(F.col("_t_source")), "left")
    over = F.lit(False)
    for m in MEASURES:
        over = over | (F.col(f"adaptive.{m}") > F.element_at("_t_limits", m))
    judged = joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~F.coalesce(over, F.lit(False))})
    return judged.drop(*limits.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with text, lang and source -> all rows and columns, with base measures, ``adaptive``, base_failed and kept.

    Columns of ``docs`` with one of these names are replaced, as is one named _row. Documents are measured twice, for the
    sketches and for the verdicts, so that texts are neither stored nor moved. The verdict refers to a row number, which
    Spark can't make twice: a filter on ``kept`` would else be moved below the measures and repeat their expressions
    many times over.
    """
    measured = measure(docs.drop("base_failed", "kept", "_row"))
    limits = stored(thresholds(stored(sketches(measured))))
    judged = judge(measured.withColumn("_row", F.monotonically_increasing_id()), limits)
    return judged.withColumn("kept", F.col("kept") & (F.col("_row") >= 0)).drop("_row")


def quality_of_documents(docs: DataFrame) -> DataFrame:
    """As ``quality_rules``, without the texts: these are measured once, and the measures stored."""
    measured = stored(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judge(measured, stored(thresholds(stored(sketches(measured)))))


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
n AS (SELECT row_number() OVER () AS r, *, len(w) AS n FROM d),
x AS (SELECT r, unnest(range(0, n - 7)) AS i FROM n WHERE n >= 8),
g AS (SELECT x.r, i, array_to_string(list_slice(w, i + 1, i + 8), ' ') AS g FROM x JOIN n USING (r)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS covered FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT n.r, doc_id, lang, source, n AS n_words, length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
             coalesce(covered, 0) AS n_repeat_words, len(regexp_extract_all(text, '\p{Lu}')) AS caps,
             len(list_filter(range(2, n + 1), lambda i: w[i] = w[i - 1])) AS echoes FROM n LEFT JOIN c ON n.r = c.r),
t AS (SELECT *, (n_symbols + 1) * 1000000 // (word_chars + 1000) AS symbols_m, (echoes + 1) * 1000000 // (n_words + 100) AS echoes_m,
             (caps + 1) * 1000000 // (word_chars + 1000) AS capitals_m, (n_dup_lines + 1) * 1000000 // (n_lines + 2) AS line_copies_m,
             coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS word_length_m, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
u AS (SELECT lang, source, measure, CASE WHEN x <= 0 THEN -1 ELSE CAST(ceil(ln(x) / ln(1.02::DOUBLE)) AS INT) END AS bucket FROM t,
      LATERAL (SELECT unnest(['symbols', 'echoes', 'capitals', 'line_copies', 'word_length']) AS measure, unnest([symbols_m, echoes_m, capitals_m, line_copies_m, word_length_m]) AS x) WHERE NOT base_failed),
o AS (SELECT lang, source, measure, CASE WHEN bucket < 0 THEN 0 ELSE pow(1.02::DOUBLE, bucket) END AS v,
             row_number() OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS k, count(*) OVER (PARTITION BY lang, source, measure) AS rows,
             row_number() OVER (PARTITION BY lang, measure ORDER BY bucket) AS kl, count(*) OVER (PARTITION BY lang, measure) AS rows_l,
             row_number() OVER (PARTITION BY measure ORDER BY bucket) AS ka, count(*) OVER (PARTITION BY measure) AS rows_a FROM u),
q AS (SELECT lang, source, measure, any_value(rows) AS n, min(v) FILTER (k >= rows * 0.5) AS mid, min(v) FILTER (k >= rows * 0.85) AS up FROM o GROUP BY ALL),
ql AS (SELECT lang, measure, any_value(rows_l) AS n, min(v) FILTER (kl >= rows_l * 0.5) AS mid, min(v) FILTER (kl >= rows_l * 0.85) AS up FROM o GROUP BY ALL),
qa AS (SELECT measure, min(v) FILTER (ka >= rows_a * 0.5) AS mid, min(v) FILTER (ka >= rows_a * 0.85) AS up FROM o GROUP BY ALL),
z AS (SELECT q.lang, q.source, q.measure, (q.n * q.mid + 50 * ((ql.n * ql.mid + 50 * qa.mid) / (ql.n + 50))) / (q.n + 50) AS mid,
             (q.n * q.up + 50 * ((ql.n * ql.up + 50 * qa.up) / (ql.n + 50))) / (q.n + 50) AS up
      FROM q JOIN ql ON q.lang IS NOT DISTINCT FROM ql.lang AND q.measure = ql.measure JOIN qa ON q.measure = qa.measure),
y AS (SELECT lang, source, max(mid + 6 * greatest(up - mid, mid * 0.05::DOUBLE)) FILTER (measure = 'symbols') AS a, max(mid + 6 * greatest(up - mid, mid * 0.05::DOUBLE)) FILTER (measure = 'echoes') AS b,
             max(mid + 6 * greatest(up - mid, mid * 0.05::DOUBLE)) FILTER (measure = 'capitals') AS c, max(mid + 6 * greatest(up - mid, mid * 0.05::DOUBLE)) FILTER (measure = 'line_copies') AS d,
             max(mid + 6 * greatest(up - mid, mid * 0.05::DOUBLE)) FILTER (measure = 'word_length') AS e FROM z GROUP BY ALL),
j AS (SELECT t.*, coalesce(symbols_m > a OR echoes_m > b OR capitals_m > c OR line_copies_m > d OR word_length_m > e, false) AS over
      FROM t LEFT JOIN y ON t.lang IS NOT DISTINCT FROM y.lang AND t.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM j
"""
