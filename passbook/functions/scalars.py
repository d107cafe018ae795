"""Column functions on dates, amounts and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day count starts here, and a month is counted as this many days.
EPOCH = "2020-01-01"
DAYS_PER_MONTH = 30.44


def day_number(date: Column) -> Column:
    """Days since the fixed epoch."""
    return F.datediff(date, F.lit(EPOCH).cast("date"))


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def calendar_months(start: Column, end: Column) -> Column:
    """Whole calendar months from start to end plus the remaining days over 30.44.

    Month ends clamp (31 Jan + 1 month = 28 or 29 Feb). ``months_between`` is a different
    measure: it counts 31-day months for the remainder.
    """
    span = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    whole = span - F.when(F.add_months(start, span) > end, 1).otherwise(0)
    return whole + F.datediff(end, F.add_months(start, whole)) / F.lit(DAYS_PER_MONTH)


def date_features(date: Column) -> Column:
    """[weekday with Monday 0, day of month from 0, month from 0, years since the epoch]."""
    return F.array(
        F.weekday(date).cast("float"),
        (F.dayofmonth(date) - 1).cast("float"),
        (F.month(date) - 1).cast("float"),
        (day_number(date) / F.lit(365.0)).cast("float"),
    )


def month_and_weekend(date: Column) -> tuple[Column, Column]:
    """Month 1-12, and 1 on Saturday and Sunday."""
    return F.month(date), (F.weekday(date) >= 5).cast("int")


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def signed_log(x: Column) -> Column:
    """sign(x) * log(1 + |x|), with NULL as 0."""
    size = F.log1p(F.abs(x))
    return F.coalesce(F.when(x < 0, -size).otherwise(size), F.lit(0.0))


def amount_bin(x: Column, n_bins: int = 64, low: float = 0.0, high: float = 15.0) -> Column:
    """Clamp to [low, high], scale to the bins and truncate."""
    clamped = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return ((clamped - low) / (high - low) * (n_bins - 1)).cast("int")


def finite_or_zero(x: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def flag_name(name: Column, prefix: str) -> Column:
    """``Buy Now Pay Later`` -> ``EMERGING_BUY_NOW_PAY_LATER``."""
    plain = F.regexp_replace(name, r"[^a-zA-Z0-9\s]", "")
    plain = F.regexp_replace(plain, r"^\s+|\s+$", "")
    return F.concat(F.lit(f"{prefix}_"), F.upper(F.regexp_replace(plain, r"\s+", "_")))


def strip_code_prefix(code: Column) -> Column:
    """Upper-case and drop leading Cs, then leading Gs: ``CG2500`` and ``c2500`` -> ``2500``."""
    code = F.upper(code.cast("string"))
    return F.regexp_replace(F.regexp_replace(code, "^C+", ""), "^G+", "")
