"""Column helpers with the null rules that the operators share.

A missing value is NULL, never NaN. Divisions by zero give NULL. Bounds leave NULL alone, unlike ``greatest``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: str | Column, low: float, high: float) -> Column:
    """Bounds for a value; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def fill(x: str | Column, value: float | int) -> Column:
    return F.coalesce(col(x), F.lit(value))


def clean(x: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def sign(x: str | Column) -> Column:
    return F.signum(col(x))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or NULL."""
    return F.when(condition, 1).otherwise(0)


def erf(x: Column) -> Column:
    """Error function by the rational approximation 7.1.26 of Abramowitz and Stegun: within 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def gaussian_cdf(mean: Column, deviation: Column, low: float = 0.15, high: float = 0.85) -> Column:
    """Probability that a normal value with this mean and deviation is above zero, bounded."""
    return clip(0.5 * (1 + erf(ratio(mean, deviation * F.sqrt(F.lit(2.0))))), low, high)


def mean_above(x: str | Column, limit: int) -> Column:
    """Aggregate: whether the mean is above a limit. Sums are exact decimals, so that a mean at the limit doesn't depend on the order of rows; values that are
    no decimals of 26 digits, 12 of them behind the point, are left to the plain mean."""
    x = col(x)
    exact = x.try_cast("decimal(26, 12)")
    whole = F.count_if(x.isNotNull() & (exact.isNull() | (exact.cast("double") != x))) == 0
    return F.when(whole, F.try_sum(exact - F.lit(limit)) > 0).otherwise(F.avg(x) > limit)


def half_up(x: Column) -> Column:
    """Rounding to an integer with halves towards plus infinity."""
    return F.floor(x + 0.5)


def scaled_number(s: str | Column) -> Column:
    """Numbers such as ``$1.5B``, ``12,345``, ``3.4%``, with T, B, M or K; NULL if it is none."""
    s = F.upper(F.trim(F.regexp_replace(col(s), r"[$,%\s]", "")))
    unit = F.regexp_extract(s, r"([TBMK])$", 1)
    scale = F.when(unit == "T", 1e12).when(unit == "B", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)
    return F.regexp_replace(s, r"[TBMK]$", "").try_cast("double") * scale


def two_decimals(x: Column) -> Column:
    """Text of a number with two decimals. Its exact binary value is rounded, halves to even, as C does; Java rounds the shortest decimal that reads back.

    From 2^53 up there are no fractions, and Java's text is taken.
    """
    x = x.cast("double")
    a = F.abs(x)
    whole = F.floor(a)
    # The fraction in units of 2^-52: whole from 1 up; below, ``over`` is what is left of it.
    fine = (a - whole) * float(1 << 52)
    over = fine - F.floor(fine)
    cents = F.floor(fine) * 100
    down = F.shiftright(cents, 52)
    beyond = (cents.bitwiseAND((1 << 52) - 1) - (1 << 51)).cast("double") + over * 100
    total = whole * 100 + down + F.when((beyond > 0) | ((beyond == 0) & (down % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise(""), F.call_function("div", total, F.lit(100)).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    return F.when(a < float(1 << 53), text).when(x.isNotNull(), F.format_string("%.2f", x))


def human_money(x: str | Column) -> Column:
    """$ with T, B or M, two decimals; smaller amounts plain."""
    x = col(x)
    a = F.abs(x)
    show = lambda d, u: F.concat(F.lit("$"), two_decimals(x / d), F.lit(u))
    return F.when(a >= 1e12, show(1e12, "T")).when(a >= 1e9, show(1e9, "B")).when(a >= 1e6, show(1e6, "M")).otherwise(show(1.0, ""))


def any_date(s: str | Column) -> Column:
    """Dates written MM/dd/yyyy or yyyy-MM-dd."""
    return F.coalesce(F.try_to_date(col(s), "MM/dd/yyyy"), F.try_to_date(col(s), "yyyy-MM-dd"))


def ticker_id(ticker: str | Column) -> Column:
    """A stable number of a name: the first six hexadecimal digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(col(ticker), 256), 1, 6), 16, 10).cast("long")


#: Funds of the sectors and their numbers.
SECTOR_IDS = {"XLK": 0, "XLF": 1, "XLE": 2, "XLV": 3, "XLP": 4, "XLY": 5, "XLI": 6, "XLC": 7, "XLU": 8, "XLRE": 9, "XLB": 10}
DEFAULT_SECTOR = "XLF"


def sector_id(fund: str | Column) -> Column:
    """Number of a sector's fund; unknown and missing ones have the default's."""
    table = F.create_map(*[F.lit(x) for kv in SECTOR_IDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(col(fund))), F.lit(SECTOR_IDS[DEFAULT_SECTOR]))


def bands(x: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first limit that x reaches, from the greatest down; ``rest`` below all, NULL for NULL."""
    out = None
    for limit, label in limits:
        out = F.when(x >= limit, label) if out is None else out.when(x >= limit, label)
    return F.when(x.isNotNull(), out.otherwise(rest))
