"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's. Each URL is expanded into the expressions that a rule could have: suffixes of its host at label
boundaries, times prefixes of its path at slashes. Both tables meet in an equi-join on the first digits of the
expressions' SHA-256; full digests and the rest of a path after its last slash are compared after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import checkpointed, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that the join uses.
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast; more are joined by a shuffle, each rule once for every salt.
BROADCAST_RULES = 100_000
#: Salts of that shuffle, which spread the URLs of one hot expression.
SALTS = 32
#: Pages of one URL from which it is hot.
HOT_URL = 10_000
#: The rules that a query must follow.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host's labels by which the query's method blocks a URL that no rule fits.
HOST_WORDS = ("adult", "casino", "malware", "phish", "porn", "spam", "warez", "xxx")


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path. Both are empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def key_path(path: Column) -> Column:
    """A rule's path up to its last slash."""
    return F.regexp_extract(path, r"^(?s)(.*/)?", 0)


def expressions(host: Column, path: Column, most_labels: int, most_slashes: int) -> Column:
    """Expressions of one URL, longest host first. Deeper ones than any rule has can't match and aren't made."""
    labels = F.split(host, r"\.", -1)
    parts = F.split(path, "/", -1)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(most_slashes), F.size(parts) - 1)),
        lambda j: F.when(j == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, j), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) of URLs -> the longest rule that fits each, for those that have one: host, path, rule, verdict, n (URLs).

    Of rules of one length the lesser in text order wins, and of two verdicts for one rule ``allow``.
    """
    digest = lambda e: F.sha2(e, 256)
    known = rules.select(
        F.col("path").alias("rule_path"), "verdict", F.concat("host", "path").alias("rule"),
        digest(F.concat("host", F.lit("\n"), key_path(F.col("path")))).alias("rule_digest"),
        F.size(F.split("host", r"\.", -1)).alias("labels"), (F.size(F.split("path", "/", -1)) - 1).alias("slashes"),
    )
    n, labels, slashes = known.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    distinct = urls.where(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("n"))
    probes = distinct.select("host", "path", "n", F.explode(expressions(F.col("host"), F.col("path"), labels or 0, slashes or 0)).alias("expression"))
    probes = probes.select("host", "path", F.col("n").alias("pages"), digest(F.col("expression")).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    known = known.drop("labels", "slashes").withColumn("short", F.substring("rule_digest", 1, PREFIX_DIGITS))
    if n <= BROADCAST_RULES:
        met = probes.join(F.broadcast(known), "short")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = probes.withColumn("salt", F.pmod(F.hash("host", "path"), F.lit(SALTS))).join(salted, ["short", "salt"])
    met = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    first = F.min(F.struct((-F.length("rule")).alias("length"), "rule", "verdict"))
    return met.groupBy("host", "path").agg(first.alias("best"), F.first("pages").alias("n")).select("host", "path", "best.rule", "best.verdict", "n")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", words: tuple[str, ...] = ()) -> DataFrame:
    """pages with ``url`` -> with host, path, rule and verdict, one row a page.

    A URL that no rule fits is blocked if a label of its host, cut at hyphens, is one of ``words``, and has the verdict ``default``
    otherwise; so have null, empty and malformed URLs, whose host is empty.
    Columns of ``pages`` named host, path, rule or verdict are replaced.
    """
    host, path = parse(F.col("url"))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    best = best_rules(parsed, rules)
    # URLs without a host have no rule, and those of many pages meet theirs over several keys.
    (salt,) = fresh(parsed, "_salt")
    best = best.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT_URL, SALTS - 1).otherwise(0)))).drop("n")
    hot = parsed.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")).where(F.col("n") > HOT_URL).select("host", "path", F.lit(True).alias("n"))
    hot = checkpointed(hot)
    (mark,) = fresh(parsed, "n")
    hot = hot.withColumnRenamed("n", mark)
    spread = parsed.join(F.broadcast(hot) if hot.count() <= BROADCAST_RULES else hot, ["host", "path"], "left")
    many = F.coalesce(F.col(mark), F.lit(False)) | (F.col("host") == "")
    spread = spread.withColumn(salt, F.when(many, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)).drop(mark)
    found = spread.join(best, ["host", "path", salt], "left").drop(salt)
    bad = F.arrays_overlap(F.split("host", r"[.-]", -1), F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    return found.withColumn("verdict", F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise(F.lit(default))))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
d AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN list_has_any(regexp_split_to_array(host, '[.-]'), ['adult', 'casino', 'malware', 'phish', 'porn', 'spam', 'warez', 'xxx']) THEN 'block'
            ELSE 'allow' END AS verdict
FROM d
"""
