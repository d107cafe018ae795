"""Points in time: eligibility, cutoffs, slicing and features at a cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import day_number
from .clean import active_days
from .examples import N_BALANCE, day_dates

# Fixed values.
MIN_SPAN_DAYS = 90
MIN_ACTIVE_DAYS = 9
LARGE_DEBIT = -500.0


def calendars(txns: DataFrame) -> DataFrame:
    """Sorted active day numbers per account; at most one per calendar day."""
    days = active_days(txns).filter(F.col("day").isNotNull())
    return days.groupBy(F.col("accountId").alias("account_id")).agg(
        F.sort_array(F.collect_list(day_number(F.col("day")))).alias("day_dates")
    )


def calendars_of_examples(examples: DataFrame) -> DataFrame:
    return examples.select("account_id", day_dates(F.col("days")).alias("day_dates"))


def negative_cutoffs(
    cal: DataFrame,
    horizons: Sequence[int],
    min_span: int = MIN_SPAN_DAYS,
    min_active: int = MIN_ACTIVE_DAYS,
    calendar_days: bool = False,
) -> DataFrame:
    """Per account and horizon T: status and the cutoff day.

    ``status`` is ``kept``, ``span`` or ``active``. The cutoff drops the last T active days, or
    with ``calendar_days`` steps back T days from the last one. No shuffle: it only reads each
    account's own calendar.
    """
    n = F.size("day_dates")
    last = F.element_at("day_dates", -1)
    span = last - F.element_at("day_dates", 1) + 1
    at = cal.withColumn("T", F.explode(F.array(*[F.lit(int(t)) for t in horizons])))
    status = (
        F.when(n == 0, "active")
        .when(span < min_span, "span")
        .when(n < min_active, "active")
        .when(n - F.col("T") < 1, "active")
        .otherwise("kept")
    )
    cutoff = (last - F.col("T")) if calendar_days else F.get("day_dates", n - F.col("T") - 1)
    return at.select(
        "account_id", "T", status.alias("status"), F.when(status == "kept", cutoff).alias("cutoff_day")
    )


def skip_counts(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.groupBy("T", "status").agg(F.count(F.lit(1)).alias("n"))


def event_days(flags: DataFrame, load_order: Sequence[str]) -> DataFrame:
    """``(global_id, flag_name) -> event_day``; of duplicates the last in load order wins."""
    return flags.groupBy(F.col("global_id").alias("account_id"), F.col("flag_name").alias("flag")).agg(
        F.max_by(day_number(F.to_date("emerging_date")), F.struct(*load_order)).alias("event_day")
    )


def positive_cutoffs(events: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """T calendar days before each event."""
    return events.withColumn("T", F.explode(F.array(*[F.lit(int(t)) for t in horizons]))).withColumn(
        "cutoff_day", F.col("event_day") - F.col("T")
    )


def slice_days(days: Column, cutoff: Column, keep_first: bool = True) -> Column:
    """Days up to and including the cutoff; with none left, the first day (or nothing)."""
    kept = F.filter(days, lambda d: d["day_offset"] <= cutoff)
    return F.when(F.size(kept) == 0, F.slice(days, 1, 1)).otherwise(kept) if keep_first else kept


def slice_examples(examples: DataFrame, cutoffs: DataFrame, keep_first: bool = True) -> DataFrame:
    """One sliced example per cutoff row of its account."""
    joined = examples.join(cutoffs, "account_id")
    return joined.withColumn("days", slice_days(F.col("days"), F.col("cutoff_day"), keep_first)).withColumn(
        "n_days", F.size("days")
    )


def baseline_features(examples: DataFrame, out: str = "features") -> DataFrame:
    """13 numbers per example: six from the amounts, then the last known balance vector.

    Amounts are the standardised ones the example carries.
    """
    empty = F.array().cast("array<float>")
    amounts = F.flatten(
        F.transform(
            "days",
            lambda d: F.concat(F.coalesce(d["pos"]["amounts"], empty), F.coalesce(d["neg"]["amounts"], empty)),
        )
    )
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x.cast("double"))
    debits = F.filter(amounts, lambda x: x < 0)
    credits = F.filter(amounts, lambda x: x > 0)
    has_balance = "balance" in [
        f.name for f in examples.schema["days"].dataType.elementType["pos"].dataType.fields
    ]
    zeros = F.array_repeat(F.lit(0.0), N_BALANCE)
    balance = zeros
    if has_balance:
        first = lambda d: F.coalesce(F.get(d["pos"]["balance"], 0), F.get(d["neg"]["balance"], 0))
        known = F.filter(F.transform("days", first), lambda b: b.isNotNull())
        last = F.try_element_at(known, F.lit(-1))
        balance = F.coalesce(F.transform(last, lambda x: x.cast("double")), zeros)
    six = F.array(
        F.size(amounts).cast("double"),
        F.col("n_days").cast("double"),
        add(debits),
        add(credits),
        F.when(F.size(debits) > 0, add(debits) / F.size(debits)).otherwise(F.lit(0.0)),
        F.size(F.filter(debits, lambda x: x < LARGE_DEBIT)).cast("double"),
    )
    return examples.withColumn(out, F.concat(six, balance))


def baseline_aggregates(rows: DataFrame, keys: Sequence[str] = ("accountId",), amount: str = "amount") -> DataFrame:
    """The six amount features straight from transaction rows (``date`` gives the active days)."""
    x = F.col(amount)
    per_day = rows.groupBy(*keys, F.to_date("date").alias("_day")).agg(
        F.count(amount).alias("n"),
        F.sum(F.when(x < 0, x)).alias("deb"),
        F.sum(F.when(x > 0, x)).alias("cre"),
        F.sum(F.when(x < 0, 1)).alias("n_deb"),
        F.sum(F.when(x < LARGE_DEBIT, 1)).alias("n_large"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per_day.groupBy(*keys).agg(
        F.sum("n").alias("txn_count"),
        F.count(F.lit(1)).alias("n_days"),
        zero(F.sum("deb")).cast("double").alias("total_debit"),
        zero(F.sum("cre")).cast("double").alias("total_credit"),
        zero(F.sum("deb") / F.sum("n_deb")).cast("double").alias("avg_debit"),
        zero(F.sum("n_large")).alias("n_large_debits"),
    )


def last_balance_vector(rows: DataFrame, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """Balance vector of the last day that has one, credit stream first, from exploded examples."""
    first_stream = F.when(F.col("stream") == "pos", 1).otherwise(0)
    return (
        rows.filter(F.col("balance").isNotNull())
        .groupBy(*keys)
        .agg(F.max_by("balance", F.struct("day_offset", first_stream, -F.col("rn"))).alias("balance"))
    )
