"""Behavioural labels: first use of a category after a baseline, gaps in recurring payments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_months, flag_name

SKIPPED = "SKIPPED_PAYMENT"  # Fixed value.


def account_starts(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First day of each account over the rows given."""
    return txns.groupBy(*by, "accountId").agg(F.min(F.to_date("date")).alias("account_start_date"))


def first_uses(txns: DataFrame, by: Sequence[str] = (), subcategory: str = "subCategoryId") -> DataFrame:
    """First transaction per account and subcategory, with its user.

    The minimum of ``(date, id, user)`` is taken map-side, so a hot account or category costs
    each task one row per group.
    """
    dated = txns.withColumn("_day", F.to_date("date")).filter(F.col("_day").isNotNull())
    return (
        dated.groupBy(*by, "accountId", F.col(subcategory).alias("subcategoryId"))
        .agg(F.min(F.struct("_day", F.col("id").cast("string").alias("id"), "user_name")).alias("_first"))
        .select(
            *by, "accountId", "subcategoryId",
            F.col("_first._day").alias("emerging_date"), F.col("_first.user_name").alias("user_name"),
        )
    )


def detect_emerging(
    txns: DataFrame,
    categories: DataFrame,
    target_groups: Sequence[str],
    primacy_months: float = 3,
    by: Sequence[str] = (),
    starts: DataFrame | None = None,
    subcategory: str = "subCategoryId",
) -> DataFrame:
    """Accounts whose first use of a target subcategory comes ``primacy_months`` after their start.

    All subcategories go through one aggregation of the transactions. The account start is the
    earliest first use over every subcategory, so it needs no second pass; give ``starts`` to
    measure from somewhere else (for example from unfiltered transactions).
    """
    firsts = first_uses(txns, by, subcategory)
    keys = [*by, "accountId"]
    if starts is None:
        whole = Window.partitionBy(*keys)
        dated = firsts.withColumn("account_start_date", F.min("emerging_date").over(whole))
    else:
        dated = firsts.join(starts, keys, "left")
    wanted = categories.filter(F.col("group_id").isin(*target_groups)).select(
        F.col("subcategory_id").alias("subcategoryId"),
        F.col("name").alias("sub_category_name"),
        F.col("group_id").alias("categoryGroupId"),
        F.col("group_name").alias("category_group_name"),
    )
    return (
        dated.join(wanted, "subcategoryId")
        .withColumn(
            "months_since_start", calendar_months(F.col("account_start_date"), F.col("emerging_date"))
        )
        .filter(F.col("months_since_start") >= primacy_months)
        .select(
            *by, "user_name", "accountId",
            flag_name(F.col("sub_category_name"), "EMERGING").alias("flag_name"),
            "categoryGroupId", "category_group_name", "subcategoryId", "sub_category_name",
            "emerging_date", "account_start_date", "months_since_start",
        )
    )


def payment_days(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``(user_name, patternId, day)``: payments on it and the first one's attributes."""
    carried = [
        F.col(c) if c in txns.columns else F.lit(None).cast("string").alias(c)
        for c in ("accountId", "deviceId")
    ]
    usable = txns.filter(F.col("patternId").isNotNull() & F.col("user_name").isNotNull())
    return (
        usable.withColumn("day", F.to_date("date"))
        .groupBy(*by, "user_name", "patternId", "day")
        .agg(
            F.count(F.lit(1)).alias("n_on_day"),
            F.min(F.struct(F.col("id").cast("string").alias("id"), *carried)).alias("_first"),
        )
    )


def payment_gaps(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds the previous payment day, the gap, and the pattern's size and smallest gap.

    Works on payment days: payments on one day are zero days apart, so a pattern of n payments
    on n days has the same gaps as its rows.
    """
    whole = Window.partitionBy(*by, "user_name", "patternId")
    ordered = whole.orderBy(F.col("day").asc_nulls_last())
    gap = F.datediff("day", F.lag("day").over(ordered))
    return (
        days.withColumns(
            {
                "payment_before": F.lag("day").over(ordered),
                "gap_days": gap,
                "n_payments": F.sum("n_on_day").over(whole),
                "n_days": F.count(F.lit(1)).over(whole),
                "_head": F.first("_first").over(ordered),
            }
        )
        .withColumn("min_gap", F.min("gap_days").over(whole))
    )


def detect_skipped_payment(
    txns: DataFrame,
    patterns: DataFrame,
    pattern_types: Sequence[str] = (),
    gap_threshold_days: int = 45,
    min_transactions: int = 4,
    bimonthly_gap_threshold: int = 50,
    monthly_payments: Mapping[str, object] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per gap of at least the threshold between consecutive payments of a pattern.

    ``monthly_payments`` gives one more pattern type its own threshold. A pattern of exactly
    three payments that are all far apart is a two-monthly one and is left out. ``by`` are key columns of the
    payments, such as the bank; patterns that lack them are joined by their id alone.
    """
    if gap_threshold_days < 1:
        raise ValueError("gap_threshold_days must be at least 1")
    monthly = dict(monthly_payments or {})
    own_type, own_gap = monthly.get("pattern_type"), monthly.get("gap_threshold_days")
    types = list(pattern_types)
    if own_type and own_type not in types:
        types.append(own_type)
    keys = [*(c for c in by if c in patterns.columns), "patternId"]
    dim = patterns.groupBy(*keys).agg(F.min("patternTypeBusiness").alias("patternTypeBusiness"))
    if types:
        dim = dim.filter(F.col("patternTypeBusiness").isin(*types))
    gaps = payment_gaps(payment_days(txns, by), by)
    limit = F.lit(gap_threshold_days)
    if own_type and own_gap:
        limit = F.when(F.col("patternTypeBusiness") == own_type, F.lit(int(own_gap))).otherwise(limit)
    two_monthly = (
        (F.col("n_payments") == 3) & (F.col("n_days") == 3) & (F.col("min_gap") > bimonthly_gap_threshold)
    )
    # Only long gaps are joined to the patterns, far fewer rows than payments.
    shortest = min([gap_threshold_days, *([int(own_gap)] if own_type and own_gap else [])])
    candidates = gaps.filter(
        (F.col("n_payments") >= min_transactions) & (F.col("gap_days") >= shortest) & ~two_monthly
    )
    joined = candidates.join(dim, keys, "inner" if types else "left")
    return joined.filter(F.col("gap_days") >= limit).select(
        *by, "user_name",
        F.col("_head.accountId").alias("accountId"),
        F.lit(SKIPPED).alias("flag_name"),
        "patternId", "patternTypeBusiness",
        F.col("_head.deviceId").alias("deviceId"),
        F.date_format("payment_before", "yyyy-MM-dd").alias("payment_before_gap"),
        F.date_format("day", "yyyy-MM-dd").alias("payment_after_gap"),
        "gap_days",
    )


def label_summary(txns: DataFrame, emerging: DataFrame, skipped: DataFrame) -> DataFrame:
    """Users and flag counts per bank, with a ``TOTAL`` row."""
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    users = txns.select("bank", "user_name").filter(F.col("user_name").isNotNull()).distinct()
    parts = (
        users.select("bank", one.alias("u"), zero.alias("e"), zero.alias("s"))
        .unionAll(emerging.select("bank", zero, one, zero))
        .unionAll(skipped.select("bank", zero, zero, one))
    )
    return (
        parts.rollup("bank")
        .agg(
            F.sum("u").alias("users"),
            F.sum("e").alias("emerging_flags"),
            F.sum("s").alias("skipped_flags"),
            F.grouping_id().alias("_g"),
        )
        .select(
            F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("bank")).alias("bank"),
            "users", "emerging_flags", "skipped_flags",
            (F.col("emerging_flags") + F.col("skipped_flags")).alias("total_flags"),
        )
    )
