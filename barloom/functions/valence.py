"""Valence of short texts by rules: a lexicon, boosters, negations, capitals, contrast and punctuation, all as columns.

A word's valence is shifted by the three words before it and flipped by negations among them; what follows a "but" weighs more than
what precedes it. The sum, sharpened by exclamation and question marks, is scaled to -1..1. Tokens stay in one array, so that
nothing is exploded and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shift of a booster, of capitals among small letters, flip of a negation, weights of boosters two and three words before.
BOOST, CAPITALS, NEGATED = 0.293, 0.733, -0.74
FADE = (1.0, 0.95, 0.9)
#: What an exclamation mark adds, up to how many; what a question mark adds, and three or more of them; scale of the sum.
EXCLAIM, MOST_EXCLAIMS, ASK, MANY_ASKS, SCALE = 0.292, 4, 0.18, 0.96, 15.0
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
#: Words that strengthen, that weaken, that negate.
STRONGER = ("absolutely", "amazingly", "completely", "considerably", "deeply", "especially", "exceptionally", "extremely", "greatly", "highly", "hugely", "incredibly", "particularly", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "very")
WEAKER = ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat")
NEGATIONS = ("aint", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "neither", "never", "no", "nobody", "none", "nope", "nor", "not", "nothing", "nowhere", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt")
#: Words of markets with a valence from -4 to 4: a default that a caller's lexicon replaces.
LEXICON = {
    "beat": 1.8, "benefit": 1.6, "best": 3.2, "better": 1.9, "boom": 2.0, "breakthrough": 2.4, "bullish": 2.2, "gain": 1.8, "gains": 1.8, "good": 1.9, "great": 3.1, "growth": 1.7, "happy": 2.7, "improve": 1.7, "improved": 1.8, "innovative": 1.8,
    "love": 3.2, "opportunity": 1.5, "optimistic": 2.1, "outperform": 2.0, "positive": 2.0, "profit": 1.9, "profits": 1.9, "rally": 1.7, "record": 1.0, "robust": 1.6, "soar": 2.2, "strong": 1.9, "success": 2.7, "surge": 1.8, "upgrade": 1.9, "win": 2.8,
    "bad": -2.5, "bankrupt": -3.2, "bankruptcy": -3.2, "bearish": -2.2, "concern": -1.3, "crash": -2.8, "crisis": -2.8, "cut": -1.1, "decline": -1.6, "default": -2.2, "difficult": -1.5, "disappointing": -2.2, "downgrade": -1.9, "drop": -1.3, "fail": -2.5,
    "fall": -1.2, "fear": -2.2, "fraud": -3.0, "lawsuit": -1.9, "layoffs": -2.1, "lose": -1.9, "loss": -1.8, "losses": -1.8, "miss": -1.4, "negative": -1.9, "plunge": -2.3, "poor": -2.1, "problem": -1.7, "recession": -2.4, "risk": -1.1, "sad": -2.1,
    "scandal": -2.6, "slump": -2.0, "terrible": -3.1, "uncertainty": -1.5, "underperform": -1.9, "warning": -1.4, "weak": -1.9, "worst": -3.1,
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = " \t\n\x0b\x0c\r"
#: Words up to which a text is one array.
_TOKEN = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """Words between white space, punctuation at their ends taken off where more than two characters are left."""
    words = F.split(F.btrim(text, F.lit(SPACE)), _TOKEN)
    bare = lambda w: F.btrim(w, F.lit(PUNCTUATION))
    return F.filter(F.transform(words, lambda w: F.when(F.length(bare(w)) > 2, bare(w)).otherwise(w)), lambda w: w != "")


def valence(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Compound valence of a text from -1 to 1, four decimals; texts without a word of the lexicon, and NULL, have 0.

    Words are compared in lower case. "but" counts at its first place. An apostrophe makes no difference to negations.
    """
    entries = LEXICON if lexicon is None else lexicon
    table = F.create_map(*[F.lit(x) for kv in entries.items() for x in (kv[0], float(kv[1]))])
    boosts = F.create_map(*[F.lit(x) for word, sign in [*((w, 1) for w in STRONGER), *((w, -1) for w in WEAKER)] for x in (word, BOOST * sign)])
    value = lambda low: F.coalesce(F.try_element_at(table, low), F.lit(0.0))
    sign = lambda v, x: F.when(v > 0, x).otherwise(-x)
    # One struct a word: as written, in lower case, its valence, its boost, whether it negates, whether it is all capitals.
    shouted = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    bare = lambda w: F.translate(F.lower(w), "'’", "")
    facts = lambda w: F.struct(
        F.lower(w).alias("low"), value(F.lower(w)).alias("v"), F.coalesce(F.try_element_at(boosts, F.lower(w)), F.lit(0.0)).alias("b"), bare(w).isin(*NEGATIONS).alias("n"), shouted(w).alias("c"),
    )

    def of_word(x: Column, w: Column, i: Column) -> Column:
        start = F.when(w["v"] == 0, 0.0).otherwise(w["v"] + F.when(w["c"] & x["mixed"], sign(w["v"], F.lit(CAPITALS))).otherwise(0.0))

        def back(v: Column, d: Column) -> Column:
            p = F.get(x["words"], i - d)
            boost = sign(v, p["b"])
            boost = boost + F.when(p["c"] & x["mixed"] & (p["b"] != 0), F.when(v > 0, CAPITALS).otherwise(-CAPITALS) * F.signum(p["b"])).otherwise(0.0)
            shifted = v + boost * F.element_at(F.array(*[F.lit(f) for f in FADE]), d)
            return F.when((i < d) | (p["v"] != 0), v).otherwise(F.when(p["n"], shifted * NEGATED).otherwise(shifted))

        moved = F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, back)
        weight = F.when(x["but"] == 0, 1.0).when(i + 1 < x["but"], BEFORE_BUT).when(i + 1 > x["but"], AFTER_BUT).otherwise(1.0)
        return F.when(w["v"] == 0, 0.0).otherwise(moved * weight)

    def scored(x: Column) -> Column:
        total = F.aggregate(F.transform(x["words"], lambda w, i: of_word(x, w, i)), F.lit(0.0), lambda a, v: a + v)
        asks = F.when(x["asks"] > 3, MANY_ASKS).when(x["asks"] > 1, ASK * x["asks"]).otherwise(0.0)
        extra = F.least(x["exclaims"], F.lit(MOST_EXCLAIMS)) * EXCLAIM + asks
        sharp = F.when(total > 0, total + extra).when(total < 0, total - extra).otherwise(0.0)
        return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sharp / F.sqrt(sharp * sharp + SCALE))), 4)

    text = F.coalesce(text, F.lit(""))
    # Arrays of one struct bind what inner functions use, so that it is computed once for a text and not for each word.
    words = F.transform(tokens(text), facts)
    first = F.array(F.struct(words.alias("words"), F.regexp_count(text, F.lit("!")).alias("exclaims"), F.regexp_count(text, F.lit(r"\?")).alias("asks")))
    bound = F.transform(first, lambda x: F.struct(
        x["words"].alias("words"), x["exclaims"].alias("exclaims"), x["asks"].alias("asks"), F.array_position(F.transform(x["words"], lambda w: w["low"]), "but").cast("int").alias("but"),
        (F.exists(x["words"], lambda w: w["c"]) & F.exists(x["words"], lambda w: ~w["c"])).alias("mixed"),
    ))
    return F.transform(bound, scored)[0]


def valence_label(score: Column) -> Column:
    """positive from .05, negative from -.05."""
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").otherwise("neutral")
