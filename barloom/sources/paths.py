"""Records in JSON whose shape changed over time: ordered candidate paths over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.columns import any_date

#: Where short-interest records lie, in order, and the names that a field has had.
ROWS = ("data.shortInterestTable.rows", "data", "shortInterestData", "rows", "table", "results")
FIELDS = {
    "settlement_date": ("settlementDate", "date"), "short_interest": ("interest", "shortInterest", "short_interest"), "avg_daily_volume": ("avgDailyShareVolume", "avgDailyShareVolumeInThousands", "avg_volume"),
    "days_to_cover": ("daysToCover", "daysToCoVerShortInterest", "days_to_cover"),
}
NEWEST = 20


def first_array(document: Column, paths: tuple[str, ...] = ROWS) -> Column:
    """The first of these paths of a VARIANT that holds an array with something in it, or an object whose ``rows`` do; else NULL."""
    some = lambda a: F.when(F.size(a) > 0, a)
    get = lambda path: F.try_variant_get(document, f"$.{path}", "array<variant>")
    return F.coalesce(*[x for p in paths for x in (some(get(p)), some(get(f"{p}.rows")))])


def first_text(record: Column, names: tuple[str, ...]) -> Column:
    """The first of these fields of a VARIANT that has a value, as text."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{n}", "string") for n in names])


def number(text: Column) -> Column:
    """A number that may be written with commas and a dollar sign; 0 if nothing is there, NULL if it is no number."""
    bare = F.translate(F.trim(text), ",$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", 0.0).otherwise(bare.try_cast("double"))


def short_interest(documents: DataFrame, key: str, json: str) -> DataFrame:
    """(key, json) -> the newest ``NEWEST`` records of each key: settlement_date (text as it was), short_interest, avg_daily_volume, days_to_cover, place.

    Text that isn't JSON and documents without records give no rows, nor do records that are no objects or whose numbers can't be read.
    Dates come as MM/dd/yyyy or yyyy-MM-dd; those that can't be read sort last.
    """
    rows = documents.select(key, F.posexplode(first_array(F.try_parse_json(json))).alias("place", "_r"))
    fields = {name: first_text(F.col("_r"), names) for name, names in FIELDS.items()}
    records = rows.where(F.schema_of_variant("_r").startswith("OBJECT")).select(key, "place", *[(number(c) if name != "settlement_date" else c).alias(name) for name, c in fields.items()])
    records = records.where("short_interest IS NOT NULL AND avg_daily_volume IS NOT NULL AND days_to_cover IS NOT NULL")
    w = W.partitionBy(key).orderBy(any_date("settlement_date").desc_nulls_last(), "place")
    whole = lambda c: F.col(c).cast("long").alias(c)
    return records.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= NEWEST).select(key, "settlement_date", whole("short_interest"), whole("avg_daily_volume"), "days_to_cover", "place")


def probed(documents: DataFrame, json: str, fields: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """Documents with a column for each field: the first of its paths that has a value of its type, else NULL."""
    v = F.try_parse_json(json)
    return documents.withColumns({name: F.coalesce(*[F.try_variant_get(v, f"$.{p}", kind) for p in paths]) for name, (paths, kind) in fields.items()})
