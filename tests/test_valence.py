"""The valence rules against a plain loop over words."""

import math
import random

from pyspark.sql import functions as F

from barloom.functions import valence as v


def plain(text, lexicon):
    text = text or ""
    words = []
    for w in [w for w in text.strip(v.SPACE).replace("\t", " ").replace("\n", " ").split(" ") if w]:
        bare = w.strip(v.PUNCTUATION)
        words.append(bare if len(bare) > 2 else w)
    caps = [w.upper() == w and w.lower() != w for w in words]
    mixed = any(caps) and not all(caps)
    low = [w.lower() for w in words]
    but = low.index("but") if "but" in low else None
    total = 0.0
    for i, w in enumerate(low):
        x = lexicon.get(w, 0.0)
        if not x:
            continue
        if caps[i] and mixed:
            x += math.copysign(v.CAPITALS, x)
        for d in (1, 2, 3):
            if i < d or lexicon.get(low[i - d], 0.0):
                continue
            p = low[i - d]
            b = v.BOOST if p in v.STRONGER else -v.BOOST if p in v.WEAKER else 0.0
            if b and caps[i - d] and mixed:
                b += math.copysign(v.CAPITALS, b)
            x += (b if x > 0 else -b) * v.FADE[d - 1]
            if p.replace("'", "").replace("’", "") in v.NEGATIONS:
                x *= v.NEGATED
        if but is not None:
            x *= v.BEFORE_BUT if i < but else v.AFTER_BUT if i > but else 1.0
        total += x
    asks = text.count("?")
    extra = min(text.count("!"), 4) * v.EXCLAIM + (v.MANY_ASKS if asks > 3 else v.ASK * asks if asks > 1 else 0.0)
    if total:
        total += math.copysign(extra, total)
    return total / math.sqrt(total * total + v.SCALE)


def test_thousand_texts(spark):
    rng = random.Random(1)
    words = [*v.LEXICON, *v.STRONGER, *v.WEAKER, *v.NEGATIONS, "don't", "isn’t", "but", "but", "the", "a", "stock", "no", "É", ":)", "--"]
    texts = []
    for _ in range(1000):
        t = []
        for _ in range(rng.randrange(0, 14)):
            w = rng.choice(words)
            w = rng.choice([w, w, w, w.upper(), w.capitalize()])
            t.append(rng.choice(["", "", "", '"', "("]) + w + rng.choice(["", "", "", "!", "?", "...", "??"]))
        texts.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\n"]).join(t) + rng.choice(["", "!!!!!", "????"]))
    texts += [None, "", "!!!", "great", "GREAT", "NOT GREAT", "very good but terrible", "good " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", v.valence(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain(t, v.LEXICON)) <= 0.5001e-4, (t, got[i])
    assert sum(abs(x) > 0.05 for x in got.values()) > 700


def test_other_lexicon_and_labels(spark):
    df = spark.createDataFrame([("foo foo",), ("bar",), ("great",)], "t string").withColumn("s", v.valence(F.col("t"), {"foo": 2, "bar": -0.1}))
    assert [r[0] for r in df.select(v.valence_label(F.col("s"))).collect()] == ["positive", "neutral", "neutral"]
