"""Facts of company reports: normalisation, best candidates by period, derived fourth quarters, flow graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import fill, ratio

FACT = "struct<units:map<string,array<struct<val:double,start:string,end:string,filed:string,form:string,frame:string,fy:int,fp:string>>>>"
#: Fixed value: names of frames of one quarter.
QUARTER_FRAME = r"^CY(\d{4})Q([1-4])$"
FORMS = ("10-K", "10-Q", "DEF 14A", "S-8", "8-K", "4")


def facts(companies: DataFrame) -> DataFrame:
    """(symbol, json) -> (symbol, fact, unit, val, start, end, filed, form, frame, fy, fp), one row a reported value."""
    parsed = companies.select("symbol", F.from_json("json", f"map<string,{FACT}>").alias("m"))
    units = parsed.select("symbol", F.explode("m").alias("fact", "f")).select("symbol", "fact", F.explode("f.units").alias("unit", "values"))
    return units.select("symbol", "fact", "unit", F.explode("values").alias("v")).select("symbol", "fact", "unit", "v.*")


def normalise(f: DataFrame) -> DataFrame:
    """Dates, duration (NULL unless the end is after the start), fiscal year and quarter: as given, else by the frame's name; a yearly report's value of a quarter is the fourth's."""
    f = f.withColumns({"start": F.try_to_date("start"), "end": F.try_to_date("end"), "filed": F.try_to_date("filed")})
    f = f.withColumn("days", F.when(F.col("end") > F.col("start"), F.datediff("end", "start")))
    part = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("int")
    fy, frame_q = F.coalesce("fy", part("frame", QUARTER_FRAME, 1)), part("frame", QUARTER_FRAME, 2)
    last = F.when((F.col("form") == "10-K") & (F.upper("fp") == "FY") & is_quarter(), 4)
    return f.withColumns({"year": fy, "quarter": F.coalesce(part(F.upper("fp"), r"^Q([1-4])$", 1), frame_q, last)})


def is_quarter():
    """55 to 125 days; without a duration, a frame of one quarter."""
    return F.when(F.col("days").isNull(), F.coalesce(F.rlike("frame", F.lit(QUARTER_FRAME)), F.lit(False))).otherwise(F.col("days").between(55, 125))


def is_annual():
    """250 to 400 days, or an instant."""
    return F.col("days").isNull() | F.col("days").between(250, 400)


def best_unit(f: DataFrame, unit: str = "USD") -> DataFrame:
    """The preferred unit of each fact: exact, other case, part of a plain name, else the first in order."""
    u = F.col("unit")
    rank = F.when(u == unit, 0).when(F.lower(u) == unit.lower(), 1).when(F.contains(F.lower(u), F.lit(unit.lower())) & ~F.contains(u, F.lit("/")), 2).otherwise(3)
    w = W.partitionBy("symbol", "fact").orderBy(rank, u)
    return f.withColumn("_u", F.dense_rank().over(w)).where("_u = 1").drop("_u")


#: The facts of each metric, the preferred one first.
METRICS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "RevenuesNetOfInterestExpense", "SalesRevenueNet"),
    "grossProfit": ("GrossProfit",), "operatingIncome": ("OperatingIncomeLoss",), "netIncome": ("NetIncomeLoss", "ProfitLoss"), "assets": ("Assets",),
    "liabilities": ("Liabilities",), "equity": ("StockholdersEquity",), "operatingCashFlow": ("NetCashProvidedByUsedInOperatingActivities",),
}


def yearly():
    """Values of yearly reports that span a year or are instants."""
    return F.coalesce((F.col("form") == "10-K") | (F.upper("fp") == "FY"), F.lit(False)) & is_annual() & F.col("val").isNotNull()


def latest_annual(f: DataFrame) -> DataFrame:
    """The newest yearly value of each fact: by end, then filing date."""
    w = W.partitionBy("symbol", "fact").orderBy(F.desc("end"), F.desc("filed"), F.desc("val"))
    return f.where(yearly()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def annual_metrics(f: DataFrame, metrics: dict[str, tuple[str, ...]] = METRICS) -> DataFrame:
    """(symbol, metric, ...): of all facts of a metric the newest yearly value by end, then filing date, then preference; equal ones by value."""
    listed = F.create_map(*[x for m, names in metrics.items() for i, n in enumerate(names) for x in (F.lit(n), F.struct(F.lit(m).alias("metric"), F.lit(i).alias("place")))])
    named = f.where(yearly()).withColumn("_m", F.try_element_at(listed, F.col("fact"))).where("_m IS NOT NULL").withColumns({"metric": F.col("_m.metric"), "_place": F.col("_m.place")})
    w = W.partitionBy("symbol", "metric").orderBy(F.desc_nulls_last("end"), F.desc_nulls_last("filed"), "_place", F.desc("val"))
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_m", "_place")


def best_quarters(f: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One value for each symbol and quarter, or end date where the quarter isn't known: the candidate of the highest score, then the later end and filing, then the preferred fact and the greater value.

    Only facts with a priority are candidates, values of whole years are none. A quarter's length counts 50, its frame 20, a stated quarter 15,
    a quarterly report 10 or a yearly one 6, a filing date 2, and each fact one for every fact behind it.
    """
    p = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    place = F.try_element_at(p, F.col("fact"))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        points(F.col("days").between(55, 125), 50) + points(F.rlike("frame", F.lit(QUARTER_FRAME)), 20) + points(F.rlike(F.upper("fp"), F.lit("^Q[1-4]$")), 15)
        + F.when(F.col("form") == "10-Q", 10).when(F.col("form") == "10-K", 6).otherwise(0) + points(F.col("filed").isNotNull(), 2) + F.greatest(F.lit(0), len(priority) - place)
    )
    known = F.when(F.col("year").isNotNull() & F.col("quarter").isNotNull(), F.concat_ws("-Q", F.col("year").cast("string"), F.col("quarter").cast("string")))
    f = f.where(place.isNotNull() & F.col("val").isNotNull() & (fill(F.upper("fp"), "") != "FY") & is_quarter())
    f = f.withColumns({"period": F.coalesce(known, F.date_format("end", "yyyy-MM-dd"), "frame"), "score": score, "_place": place}).where("period IS NOT NULL")
    w = W.partitionBy("symbol", "period").orderBy(F.desc("score"), F.desc_nulls_last("end"), F.desc_nulls_last("filed"), "_place", F.desc("val"))
    return f.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_place")


def derived_q4(quarters: DataFrame, annual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, year, quarter, val) with three quarters and (keys, year, val) -> the fourth: the year less the others, if that is at most 1.5 times the year."""
    sums = quarters.groupBy(*keys, "year").agg(F.count_distinct(F.when(F.col("quarter").isin(1, 2, 3), F.col("quarter"))).alias("_n"), F.max(F.when(F.col("quarter") == 4, 1)).alias("_four"), F.sum(F.when(F.col("quarter").isin(1, 2, 3), F.col("val"))).alias("_s"))
    met = annual.withColumnRenamed("val", "_fy").join(sums, [*keys, "year"]).where((F.col("_n") == 3) & F.col("_four").isNull())
    q4 = F.col("_fy") - F.col("_s")
    return met.withColumn("val", q4).where(F.abs(q4) <= 1.5 * F.abs("_fy")).select(*keys, "year", F.lit(4).alias("quarter"), "val")


def two_series(a: DataFrame, b: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """Two quarterly series side by side, whichever is there, the newest ``n`` quarters of each key."""
    both = a.withColumnRenamed("val", "a").join(b.withColumnRenamed("val", "b"), [*keys, "year", "quarter"], "full_outer")
    both = both.withColumn("sort", F.make_date("year", F.col("quarter") * 3, F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc("sort"))
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recent_filings(f: DataFrame, forms: tuple[str, ...] = FORMS, n: int = 10) -> DataFrame:
    """(symbol, forms array, dates array) in parallel -> the first ten of the listed forms in their order."""
    each = f.select("symbol", F.posexplode(F.arrays_zip("forms", "dates")).alias("place", "r")).select("symbol", "place", F.col("r.forms").alias("form"), F.col("r.dates").alias("date")).where(F.col("form").isin(*forms))
    return each.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy("place"))).where(F.col("_n") <= n).drop("_n")


#: Share of revenue that segments may leave unexplained.
UNSEGMENTED = 0.05
#: The kinds of nodes, other than segments.
KINDS = {
    "Total Revenue": "revenue", "Other Revenue": "revenue", "Other/Interest Income": "revenue", "Cost of Revenue": "expense", "Operating Expenses": "expense", "R&D": "expense", "SG&A": "expense",
    "Other OpEx": "expense", "Other/Interest Expense": "expense", "Gross Profit": "profit", "Operating Income": "profit", "Income Before Tax": "profit", "Net Income": "profit", "Taxes": "tax",
}
#: Nodes that a statement has even where nothing flows.
ALWAYS = ("Total Revenue", "Cost of Revenue", "Gross Profit", "Operating Expenses", "Operating Income", "Income Before Tax", "Net Income")


def flow_amounts(statements: DataFrame) -> DataFrame:
    """Income statements -> (symbol, segments, other, and the amounts of the flow), none below zero but ``other``.

    Columns that a statement lacks are 0; ``segments`` is a map of names and revenue. Gross profit and cost are each what the
    other leaves of revenue, or come from the gross profit ratio. Operating income is no more than gross profit less operating expenses.
    """
    have = set(statements.columns)
    raw = lambda x: fill(F.col(x).cast("double"), 0.0) if x in have else F.lit(0.0)
    c = lambda x: F.greatest(raw(x), F.lit(0.0))
    rest = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0.0))
    segments = F.col("segments") if "segments" in have else F.lit(None).cast("map<string,double>")
    s = statements.select("symbol", segments.alias("segments"), c("revenue").alias("rev"), c("costOfRevenue").alias("cost"), c("grossProfit").alias("gp"), raw("grossProfitRatio").alias("ratio"), c("operatingExpenses").alias("opex"), c("researchAndDevelopmentExpenses").alias("rd"),
                          c("sellingGeneralAndAdministrativeExpenses").alias("sga"), c("operatingIncome").alias("told"), raw("totalOtherIncomeExpensesNet").alias("other"), c("incomeBeforeTax").alias("before_tax"), c("incomeTaxExpense").alias("tax"), c("netIncome").alias("net"))
    some = F.col("rev") > 0
    s = s.withColumn("gp", F.when((F.col("gp") <= 0) & some & (F.col("cost") > 0), rest("rev", "cost")).otherwise(F.col("gp")))
    s = s.withColumn("cost", F.when((F.col("cost") <= 0) & some & (F.col("gp") > 0), rest("rev", "gp")).otherwise(F.col("cost")))
    by_ratio = (F.col("gp") <= 0) & some & (F.col("ratio") > 0)
    s = s.withColumns({"gp": F.when(by_ratio, F.col("rev") * F.col("ratio")).otherwise(F.col("gp")), "cost": F.when(by_ratio & (F.col("cost") <= 0), F.greatest(F.col("rev") * (1 - F.col("ratio")), F.lit(0.0))).otherwise(F.col("cost"))})
    s = s.withColumns({"op": F.least("told", rest("gp", "opex")), "rest": F.greatest(F.col("opex") - F.col("rd") - F.col("sga"), F.lit(0.0))})
    left = rest("op", "paid")  # of operating income behind other expense
    s = s.withColumn("paid", F.greatest(-F.col("other"), F.lit(0.0))).withColumn("to_tax", F.when(F.col("before_tax") > 0, F.least(left, "before_tax")).otherwise(left))
    return s.withColumn("kept", F.when(F.col("before_tax") > 0, F.least("net", "before_tax")).otherwise(F.col("net")))


def flow_links(statements: DataFrame) -> DataFrame:
    """Income statements -> (symbol, source, target, value) with values above zero.

    Segments flow into revenue; what they leave of it is "Other Revenue" if it is more than ``UNSEGMENTED`` of it. A statement without
    segments has one source. Other income joins operating income before tax, other expense leaves it.
    """
    s = flow_amounts(statements)
    link = lambda a, b, v: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.cast("double").alias("value"))
    c = F.col
    segments = F.filter(F.map_entries("segments"), lambda e: e["value"] > 0)
    total = F.aggregate(segments, F.lit(0.0), lambda a, e: a + e["value"])
    name = lambda e: F.trim(F.regexp_replace(e["key"], "^(.*?) Segment", "$1"))
    other = F.when(c("rev") - total > UNSEGMENTED * c("rev"), c("rev") - total)
    into = F.when(F.size("segments") > 0, F.concat(F.transform(segments, lambda e: F.struct(name(e).alias("source"), F.lit("Total Revenue").alias("target"), e["value"].alias("value"))), F.array(link("Other Revenue", "Total Revenue", other))))
    links = F.concat(
        F.coalesce(into, F.array(link("Sales/Operations", "Total Revenue", c("rev")))),
        F.array(
            link("Total Revenue", "Cost of Revenue", c("cost")), link("Total Revenue", "Gross Profit", c("gp")), link("Gross Profit", "Operating Expenses", c("opex")),
            link("Operating Expenses", "R&D", c("rd")), link("Operating Expenses", "SG&A", c("sga")), link("Operating Expenses", "Other OpEx", c("rest")),
            link("Gross Profit", "Operating Income", c("op")), link("Operating Income", "Other/Interest Expense", c("paid")), link("Other/Interest Income", "Income Before Tax", c("other")),
            link("Operating Income", "Income Before Tax", c("to_tax")), link("Income Before Tax", "Taxes", c("tax")), link("Income Before Tax", "Net Income", c("kept")),
        ),
    )
    return s.select("symbol", F.explode(links).alias("l")).select("symbol", "l.*").where("value > 0")


def flow_nodes(statements: DataFrame) -> DataFrame:
    """Income statements -> (symbol, node, kind, value): what flows in, else what flows out; revenue and gross profit as stated."""
    links = flow_links(statements)
    ends = links.select("symbol", F.inline(F.array(F.struct(F.col("target").alias("node"), F.col("value").alias("_in"), F.lit(None).cast("double").alias("_out")), F.struct(F.col("source").alias("node"), F.lit(None).cast("double").alias("_in"), F.col("value").alias("_out")))))
    fixed = F.array(*[F.struct(F.lit(n).alias("node"), (F.col("rev") if n == "Total Revenue" else F.col("gp") if n == "Gross Profit" else F.lit(None).cast("double")).alias("_told")) for n in ALWAYS])
    told = flow_amounts(statements).select("symbol", F.inline(fixed))
    every = ends.unionByName(told, allowMissingColumns=True).groupBy("symbol", "node").agg(F.max("_told").alias("_told"), F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("node")), F.lit("segment"))
    return every.select("symbol", "node", kind.alias("kind"), F.coalesce("_told", "_in", "_out", F.lit(0.0)).alias("value"))


def node_kinds(links: DataFrame, total: str = "Revenue") -> DataFrame:
    """Nodes that flow into the total are segments."""
    nodes = links.select("symbol", F.col("source").alias("node")).union(links.select("symbol", F.col("target").alias("node"))).distinct()
    segments = links.where(F.col("target") == total).select("symbol", F.col("source").alias("node")).distinct().withColumn("_s", F.lit(True))
    return nodes.join(segments, ["symbol", "node"], "left").select("symbol", "node", F.when(F.col("_s"), "segment").when(F.col("node") == total, "total").otherwise("item").alias("kind"))


def gross_margin(statements: DataFrame) -> DataFrame:
    return statements.withColumn("gross_margin", ratio("grossProfit", "revenue") * 100)
