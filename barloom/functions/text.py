"""Scores and plain text of documents."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.columns import clip

#: Words that count for and against in filings.
POSITIVE = ("growth", "increase", "profit", "revenue", "strong", "positive", "successful", "improvement", "gain", "benefit", "opportunity", "optimistic", "expansion", "exceeded", "outperform", "robust")
NEGATIVE = ("loss", "decline", "decrease", "risk", "challenge", "uncertainty", "negative", "concern", "problem", "difficult", "weak", "poor", "disappointing", "below", "underperform", "volatility")
#: Words that count for and against in posts.
BULLISH = ("buy", "moon", "rocket", "bull", "calls", "up", "green", "gains", "hodl")
BEARISH = ("sell", "crash", "bear", "puts", "down", "red", "loss", "dump", "short")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur anywhere in a text, in any case, also within other words."""
    low = F.lower(text)
    # A plain sum: within a lambda the text would be lower-cased again for each word.
    return reduce(add, [F.contains(low, F.lit(w)).cast("int") for w in words])


def keyword_score(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """Difference of hits against a hundredth of the words, bounded; NULL text scores 0."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    return F.coalesce(clip((hits(text, positive) - hits(text, negative)) / F.greatest(words / 100, F.lit(1.0)), -1, 1), F.lit(0.0))


def label(score: Column, band: float = 0.05) -> Column:
    return F.when(score > band, "positive").when(score < -band, "negative").otherwise("neutral")


def post_label(content: Column) -> Column:
    """bullish or bearish by which words occur more, else neutral."""
    up, down = hits(content, BULLISH), hits(content, BEARISH)
    return F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral")


def html_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, navigation, head and foot, tags to spaces, common entities decoded, white space closed up."""
    x = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|head)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def label_cells(html: Column) -> Column:
    """Two-column table rows as a map from label to value; the first of equal labels counts."""
    cell = r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>"
    names, values = (F.transform(F.regexp_extract_all(html, F.lit(cell), F.lit(i)), lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]*>", ""))) for i in (1, 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))


def paragraphs_with(text: Column, words: tuple[str, ...], least: int = 10_000) -> Column:
    """Long texts keep only paragraphs with a keyword."""
    kept = F.array_join(F.filter(F.split(text, r"\n\s*\n"), lambda p: hits(p, words) > 0), "\n\n")
    return F.when(F.length(text) > least, kept).otherwise(text)
