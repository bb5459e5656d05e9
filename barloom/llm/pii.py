"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Entities that the fixed patterns find are seeds. The words around them induce lexical patterns: two words before, one
before and one after, or one of them with the shape of the value. Patterns and the values that they surround form a
graph. A pattern's score is the share of its values that are believed to be identifiers, with ``SMOOTH`` others added; a
value's belief is the probability that not all of its patterns of high score are wrong. Both are recomputed in turn
until they settle, so that what is discovered supports further patterns. Values with a high belief are identifiers that
no fixed pattern describes. A number that passes the check of cards, but whose neighbours keep the fixed pattern from
it, starts with the belief that such a check deserves.

Everything is DataFrame functions. Texts are read once; what is stored has only spans, values and words beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import checkpointed, stored

#: In their order in results. The last is what contexts add.
KINDS = ("email", "ip", "card", "phone", "context")
#: Possessive repeats never give back what they took; where a run of the first class starts, only its start or the end
#: of the last match is tried. Neither changes what matches, and both keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a context may turn into an identifier: letters and digits with separators inside, a digit among the first 20
#: characters, or digits with brackets and spaces. Where a run starts, only its start is tried.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9._/-]))(?=[A-Za-z._/-]{0,20}[0-9])[A-Za-z0-9]++(?:[._/-]++[A-Za-z0-9]++)*+"
CANDIDATE_HINT = r"[0-9]"
#: Characters of a candidate at least.
LEAST_LENGTH = 5
#: Words on either side of a mention that are kept, the longest that counts in a pattern, and characters of a shape.
NEAR, LONGEST_WORD, SHAPE = 3, 40, 40
#: Believed values that a pattern must surround, values that count as wrong besides its own, and the least score of one that counts.
SUPPORT, SMOOTH, LEAST_SCORE = 3, 1, 0.8
#: Least belief of a discovery, and of a number that passes the check of cards: one in ten numbers does by chance.
LEAST_BELIEF, CHECKED = 0.9, 0.9
#: The rounds end when all beliefs together grow by no more than this share.
SETTLED = 1e-4
#: Values of a pattern from which its edges are dealt over ``SALTS`` keys; the most such patterns, and found values, that are broadcast.
HOT, SALTS, BROADCAST_ROWS = 10_000, 32, 100_000
#: Numbers of a text that are added up one by one; the sums of so many at a time are added up after them.
BLOCK = 256
MENTION = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _valid(kind: int, m: Column) -> Column:
    """Whether a match of the fixed pattern counts."""
    if KINDS[kind] == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    n = F.length(_digits(m))
    if KINDS[kind] == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(m))
    if KINDS[kind] == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spaced(s: Column) -> Column:
    return F.translate(s, "\t\n\r", "   ")


def _bound(x: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of ``x``, which is computed once however often it stands there."""
    return F.element_at(F.transform(F.array(x), lambda v: made(v)), 1)


def _running(numbers: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each number ``merge`` over zero and all those before it. Appending copies an array, so blocks are merged, then what is in them."""

    def before(a: Column, start: Column) -> Column:
        step = lambda done, x: F.struct(merge(done["at"], x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
        return F.aggregate(a, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda done: done["out"])

    last = lambda a: F.floor(F.greatest(F.size(a) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = _bound(numbers, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda i: F.slice(a, i * BLOCK + 1, BLOCK)))
    return _bound(blocks, lambda b: F.flatten(F.zip_with(b, before(F.transform(b, lambda a: F.aggregate(a, F.lit(0), merge)), F.lit(0)), before)))


def mentions(text: Column, kind: int, pattern: str, hint: Column, valid: bool = True) -> Column:
    """Matches of a pattern with their places in code points and the words on both sides, up to the next match; empty where ``hint`` is false.

    The text between matches comes from splitting by the same pattern, so lengths add up to places.
    """

    def one(x: Column, m: Column, i: Column) -> Column:
        before, after = F.get(x["gaps"], i), F.get(x["gaps"], i + 1)
        start = F.get(x["at"], i) + F.length(before)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.substring_index(_spaced(before), " ", -NEAR).alias("left"), F.substring_index(_spaced(after), " ", NEAR).alias("right"))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    lengths = lambda x: F.transform(x["found"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))
    placed = _bound(both, lambda x: F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), _running(lengths(x), lambda a, b: a + b).alias("at")))
    made = _bound(placed, lambda x: F.transform(x["found"], lambda m, i: one(x, m, i)))
    made = F.filter(made, lambda m: _valid(kind, m["value"])) if valid else made
    return F.when(hint, made).otherwise(F.array()).cast(MENTION)


def fixed(text: Column) -> Column:
    """All mentions of the fixed patterns, by kind, then place. Cheap tests skip texts without any."""
    digits = F.regexp_count(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")) > 0
    return F.concat(
        mentions(text, 0, EMAIL, F.contains(text, F.lit("@"))),
        mentions(text, 1, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]"))),
        mentions(text, 2, CARD, digits),
        mentions(text, 3, PHONE, F.contains(text, F.lit("+"))),
    )


def apart(others: Column, base: Column) -> Column:
    """Those of ``others``, which are in order and apart, that no mention of ``base`` overlaps.

    In order of the mentions' starts and the others' ends, the furthest end so far tells whether a mention reaches into one.
    """
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("to"), F.lit(-1).alias("place")))
    ends = F.transform(others, lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("is_base"), c["start"].alias("to"), i.alias("place")))
    reach = lambda x: _running(F.transform(x, lambda e: e["to"] * e["is_base"]), lambda a, b: F.greatest(a, b))
    met = _bound(F.array_sort(F.concat(starts, ends)), lambda x: F.zip_with(x, reach(x), lambda e, r: F.struct(e.alias("e"), r.alias("r"))))
    return F.transform(F.filter(met, lambda m: (m["e"]["is_base"] == 0) & (m["r"] <= m["e"]["to"])), lambda m: F.get(others, m["e"]["place"]))


def scan(docs: DataFrame) -> DataFrame:
    """docs with ``text`` -> without it, with ``base`` and ``others``: mentions of the fixed patterns, and candidates that none of them overlaps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.drop("base", "others").withColumns({"base": fixed(text), "others": mentions(text, 4, CANDIDATE, F.rlike(text, F.lit(CANDIDATE_HINT)), valid=False)})
    pair = F.struct("base", F.filter("others", lambda c: F.length(c["value"]) >= LEAST_LENGTH).alias("others"))
    free = _bound(pair, lambda x: F.when(F.size(x["base"]) > 0, apart(x["others"], x["base"])).otherwise(x["others"]))
    return found.withColumn("others", free).drop("text")


def _patterns(m: Column) -> Column:
    """Lexical patterns of a mention: lower-case words beside it, without what stands around them, and the shape of the value."""
    words = lambda s: F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}:=#]+"), lambda w: (w != "") & (F.length(w) <= LONGEST_WORD))
    before, after = words(m["left"]), words(m["right"])
    shape = F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(m["value"], "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), F.lit(SHAPE))
    last, first = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    made = [
        F.when(F.size(before) >= 2, F.concat_ws(" ", F.lit("<"), F.slice(before, -2, 2))),
        F.concat(F.lit("<> "), last, F.lit(" "), first),
        F.concat(F.lit("<# "), last, F.lit(" "), shape),
        F.concat(F.lit("#> "), shape, F.lit(" "), first),
    ]
    return F.filter(F.array(*made), lambda p: p.isNotNull())


def edges_of(scanned: DataFrame) -> DataFrame:
    """Stored output of ``scan`` -> (pattern, value, prior): once each, however often they meet. A seed's prior is 1."""
    one = scanned.select(F.explode(F.concat("base", "others")).alias("m"))
    checked = F.when(_valid(KINDS.index("card"), F.col("m.value")) & F.rlike("m.value", F.lit("^[0-9]+$")), CHECKED).otherwise(0.0)
    prior = F.when(F.col("m.kind") < len(KINDS) - 1, 1.0).otherwise(checked)
    return one.select("m.value", prior.alias("prior"), F.explode_outer(_patterns(F.col("m"))).alias("pattern")).groupBy("pattern", "value").agg(F.max("prior").alias("prior"))


def believed(edges: DataFrame) -> DataFrame:
    """Stored (pattern, value, prior) -> (value, belief) of all values with a belief above zero.

    Patterns with fewer than ``SUPPORT`` values can never count and are left out. Edges of a pattern with very many values
    carry one of ``SALTS`` keys, by value, so that none of them is one task's work. Beliefs only grow, so they settle.
    """
    prior = edges.groupBy("value").agg(F.max("prior").alias("belief")).where("belief > 0")
    counts = edges.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    counts = checkpointed(counts)
    n = counts.agg(F.sum("n")).first()[0] or 0
    counts = counts.withColumn("salts", F.when(F.col("n") > max(HOT, n // BROADCAST_ROWS), SALTS).otherwise(1))
    hot = counts.where("salts > 1").select("pattern", "salts")
    salted = edges.join(F.broadcast(hot), "pattern", "left").withColumn("salt", F.pmod(F.hash("value"), F.coalesce("salts", F.lit(1)))).drop("salts")
    every = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    graph = stored(salted.join(every, ["pattern", "salt"]).select("pattern", "salt", "value", "n"))
    belief, before = checkpointed(prior), -1.0
    while (total := belief.agg(F.sum("belief")).first()[0] or 0.0) > before * (1 + SETTLED):
        before = total
        partly = graph.join(belief, "value").groupBy("pattern", "salt", "n").agg(F.sum("belief").alias("b"), F.count_if(F.col("belief") >= LEAST_BELIEF).alias("good"))
        scores = partly.groupBy("pattern", "n").agg((F.sum("b") / (F.col("n") + SMOOTH)).alias("score"), F.sum("good").alias("good"))
        scores = scores.where((F.col("score") >= LEAST_SCORE) & (F.col("good") >= SUPPORT)).join(counts.select("pattern", "salts"), "pattern")
        scores = scores.select("pattern", "score", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        doubt = graph.join(scores, ["pattern", "salt"]).groupBy("value").agg(F.sum(F.ln(F.greatest(F.lit(1e-6), 1 - F.col("score")))).alias("doubt"))
        known = prior.withColumnRenamed("belief", "prior").join(doubt, "value", "full")
        belief = checkpointed(known.select("value", (1 - (1 - F.coalesce("prior", F.lit(0.0))) * F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("belief")))
    return belief


def discoveries(scanned: DataFrame) -> DataFrame:
    """Stored output of ``scan`` -> (value) of seeds, and of candidates that the graph of patterns and values makes identifiers."""
    return believed(stored(edges_of(scanned))).where(F.col("belief") >= LEAST_BELIEF).select("value")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs with ``text`` -> its other columns with ``base`` and ``found``, mentions in order of kind, then place.

    Null text counts as empty; an empty table stays empty. A place is a code point, ends are exclusive. Rows are told apart
    by a number that is stored with them, so that repeated rows stay. Columns of ``docs`` named base, others, found, _row or
    _more are replaced.
    """
    rows = stored(scan(docs.drop("found", "_row", "_more").withColumn("_row", F.monotonically_increasing_id())))
    values = checkpointed(discoveries(rows).withColumnRenamed("value", "_value"))
    values = F.broadcast(values) if values.count() <= BROADCAST_ROWS else values
    mention = rows.select("_row", F.explode("others").alias("_m"))
    hits = mention.join(values, F.col("_m.value") == F.col("_value")).groupBy("_row").agg(F.collect_list("_m").alias("_more"))
    return rows.join(hits, "_row", "left").withColumn("found", F.concat("base", F.coalesce(F.array_sort("_more"), F.array().cast(MENTION)))).drop("_row", "_more", "others")


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"], m["end"])), ",")
