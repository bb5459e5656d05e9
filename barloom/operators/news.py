"""Articles and lists: union without repeats, filters, pages, search, differences of sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.functions.columns import fill

#: Categories and their sectors.
SECTORS = {
    "technology": "Technology", "tech": "Technology", "business": "Finance", "finance": "Finance", "healthcare": "Healthcare", "health": "Healthcare",
    "energy": "Energy", "automotive": "Automotive", "auto": "Automotive", "consumer": "Consumer", "industrials": "Industrials", "materials": "Materials",
    "realestate": "Real Estate", "utilities": "Utilities", "communication": "Communication", "communications": "Communication",
}


def sector_of(category: Column, table: dict[str, str] = SECTORS) -> Column:
    """Sector of a category without spaces and case; unknown ones pass through."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.replace(category, F.lit(" "), F.lit("")))), category)


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def union_articles(providers: list[DataFrame]) -> DataFrame:
    """Articles of several providers, each URL once, from the first provider that has it. URLs count without case and outer spaces; rows without one go."""
    ranked = [p.withColumn("_provider", F.lit(i)) for i, p in enumerate(providers)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    url = F.lower(F.trim("url"))
    return first_of(both.where(url.isNotNull() & (url != "")), [url], [F.col("_provider"), F.desc("published_at"), F.col("title")]).drop("_provider")


def newest_distinct(feeds: DataFrame, n: int = 6) -> DataFrame:
    """The newest rows with different title and URL."""
    return first_of(feeds, [F.lower(F.concat_ws("|", "title", "url"))], [F.desc("published_at"), F.col("title")]).orderBy(F.desc("published_at"), "title").limit(n)


def first_filled(sources: DataFrame, key: list[str], rank: str, title: str = "title") -> DataFrame:
    """Of each key the rows of its first source that has any, each title once."""
    w = W.partitionBy(*key)
    best = sources.withColumn("_best", F.min(rank).over(w)).where(F.col(rank) == F.col("_best")).drop("_best")
    return first_of(best, [F.col(k) for k in [*key, title]], [F.desc("published_at")])


def page(df: DataFrame, order: list[Column], number: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def filtered(df: DataFrame, sentiment: str | None = None, start: str | None = None, end: str | None = None, sector: str | None = None, search: str | None = None, tickers: list[str] | None = None, tag: str | None = None) -> DataFrame:
    """Articles by label, moments (a day alone is its midnight), sectors (several with commas), text in title or snippet, first ticker, and part of the category's name; without case.

    An article that lacks the column's value is left out by its filter.
    """
    inside = lambda c, part: F.contains(F.lower(c), F.lit(part.lower()))
    if sentiment:
        df = df.where(F.lower("sentiment") == sentiment.lower())
    if start:
        df = df.where(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("published_at") <= F.lit(end).cast("timestamp"))
    if tag:
        df = df.where(inside("industry", tag))
    if sector:
        df = df.where(F.lower(sector_of(F.col("industry"))).isin(*[x.strip().lower() for x in sector.split(",")]))
    if search:
        df = df.where(inside("title", search) | inside(F.coalesce("snippet", F.lit("")), search))
    if tickers:
        df = df.where(F.upper(F.try_element_at("tickers", F.lit(1))).isin(*[t.strip().upper() for t in tickers]))
    return df


def top_posts(posts: DataFrame, keys: list[str], tie: str, k: int = 2) -> DataFrame:
    """Posts (title, body, score) -> with label and signals for and against; the k best by score of each label that takes a side. Posts without a word have none and go."""
    content = F.concat_ws(" ", "title", "body")
    df = posts.where(F.trim(content) != "").withColumns({"label": text.post_label(content), "bullish": text.hits(content, text.BULLISH), "bearish": text.hits(content, text.BEARISH)})
    w = W.partitionBy(*keys, "label").orderBy(fill("score", 0).desc(), tie)
    return df.where("label <> 'neutral'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search_symbols(df: DataFrame, query: str, symbol: str, name: str) -> DataFrame:
    q = F.lit(query.upper())
    return df.where(F.contains(F.upper(symbol), q) | F.contains(F.upper(name), q))


def appended(shown: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of the next page whose URL and title are both new."""
    return more.join(shown.select("url").distinct(), "url", "left_anti").join(shown.select("title").distinct(), "title", "left_anti")


def without(universe: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of the universe that have no row: by anti-join, so rows outside of the universe don't count."""
    return universe.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


#: What an event of high importance touches if no keyword is in its name.
BROAD_MARKET = ("SPY", "QQQ", "IWM", "DIA")


def _grams(name: Column, sizes: list[int]) -> Column:
    """The different substrings of these lengths."""
    of = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def keyword_matches(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """(name) and (keyword) -> (name, keyword) wherever a name contains a keyword, in any case of letters.

    Each keyword is indexed by the one of its trigrams that fewest names have (a shorter keyword by itself). Names meet it by
    equality and are then looked at whole, so that neither side is broadcast nor compared with all of the other. The lengths of grams
    in use, three at most, are all that the driver sees.
    """
    known = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    sizes = sorted(r[0] for r in known.select(F.least(F.length("keyword"), F.lit(3))).distinct().collect())
    low = names.select(F.lower("name").alias("_low")).where("_low IS NOT NULL").distinct()
    if not sizes:
        return names.select("name", F.lit(None).cast("string").alias("keyword")).where(F.lit(False))
    grams = low.select("_low", F.explode(_grams(F.col("_low"), sizes)).alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.least(F.length("keyword"), F.lit(3))
    own = known.select("keyword", F.explode(F.transform(F.sequence(F.lit(1), F.length("keyword") - size + 1), lambda i: F.substr("keyword", i, size))).alias("gram"))
    rarest = own.join(frequency, "gram", "left").groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    met = grams.join(rarest, "gram").where(F.contains("_low", F.col("keyword"))).select("_low", "keyword")
    return names.select("name").distinct().withColumn("_low", F.lower("name")).join(met, "_low").select("name", "keyword")


def matched_events(events: DataFrame, keywords: DataFrame, universe: DataFrame) -> DataFrame:
    """Events (event, importance and others), keywords (keyword, tickers) and a universe (ticker) -> events with the sorted tickers that they touch.

    All keywords in an event's name count. One of high importance without any touches the broad market. Tickers outside of the
    universe go; an event that nothing is left of has an empty array, and so has one without a name.
    """
    names = events.select(F.col("event").alias("name")).where("name IS NOT NULL").distinct()
    inside = universe.select("ticker").distinct()
    each = keywords.select(F.lower("keyword").alias("keyword"), F.explode("tickers").alias("ticker")).distinct()
    touched = keyword_matches(names, keywords).join(each, "keyword").select("name", "ticker").distinct()
    found = touched.join(inside.withColumn("_in", F.lit(True)), "ticker", "left").groupBy(F.col("name").alias("event")).agg(F.array_sort(F.collect_list(F.when(F.col("_in"), F.col("ticker")))).alias("_found"))
    broad = inside.where(F.col("ticker").isin(*BROAD_MARKET)).agg(F.array_sort(F.collect_list("ticker")).alias("_broad"))
    none = F.array().cast("array<string>")
    out = events.join(found, "event", "left").crossJoin(F.broadcast(broad))
    return out.select(*events.columns, F.coalesce("_found", F.when(F.col("importance") == "high", F.col("_broad")), none).alias("tickers"))


def events_of(events: DataFrame, tickers: DataFrame) -> DataFrame:
    """Events with tickers and (ticker) -> a row for each ticker and event that touches it."""
    return events.withColumn("ticker", F.explode("tickers")).join(tickers.select("ticker").distinct(), "ticker", "left_semi")
