"""Nested training examples: account -> day -> credit/debit stream -> transaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import date_features, day_number, month_and_weekend
from .balance import account_key
from .clean import active_days
from .vocab import UNK_ID, encode, feature_columns

STD_EPS = 1e-9  # Fixed value.
N_BALANCE, N_DATE = 7, 4
STREAMS = ("pos", "neg")
# How the two example layouts differ: what a zero amount is, and which rows a cap keeps.
VARIANTS = {
    "arrival": {"zero_is_debit": True, "largest_first": False},
    "magnitude": {"zero_is_debit": False, "largest_first": True},
}


def kept_days(txns: DataFrame, min_days: int, max_days: int) -> DataFrame:
    """The last ``max_days`` active days of accounts that have at least ``min_days``.

    Windows run over distinct days, so an account's partition is bounded by the calendar.
    """
    whole = Window.partitionBy("accountId")
    days = active_days(txns).filter(F.col("day").isNotNull())
    ranked = days.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_back": F.row_number().over(whole.orderBy(F.col("day").desc())),
        }
    )
    return ranked.filter((F.col("_n") >= min_days) & (F.col("_back") <= max_days)).drop("_n", "_back")


def stream_of(amount: Column, zero_is_debit: bool) -> Column:
    debit = amount <= 0 if zero_is_debit else amount < 0
    return F.when(amount > 0, "pos").when(debit, "neg")


def top_of_stream(
    txns: DataFrame, max_txns: int, variant: str = "arrival", arrival: str | None = None
) -> DataFrame:
    """At most ``max_txns`` rows per account, day and stream, with their place ``rn``.

    Either the first to arrive (ties by id) or the largest in size. The cap is applied before
    the shuffle, so each task sends at most that many rows per stream.
    """
    rule = VARIANTS[variant]
    arrival = arrival or ("ts" if "ts" in txns.columns else "date")
    rows = txns.withColumns(
        {"day": F.to_date("date"), "stream": stream_of(F.col("amount"), rule["zero_is_debit"])}
    ).filter(F.col("stream").isNotNull() & F.col("day").isNotNull())
    first = F.abs("amount").desc() if rule["largest_first"] else F.col(arrival).asc()
    w = Window.partitionBy("accountId", "day", "stream").orderBy(first, F.col("id").cast("string"))
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_txns)


def standardize_amounts(
    rows: DataFrame, keys: Sequence[str] = ("accountId", "day", "stream"), out: str = "amount_std"
) -> DataFrame:
    """sign(x) * (log1p|x| - mean) / (std + eps) within each stream (already capped)."""
    w = Window.partitionBy(*keys)
    size = F.log1p(F.abs(F.col("amount")))
    scaled = (size - F.avg(size).over(w)) / (F.stddev_pop(size).over(w) + F.lit(STD_EPS))
    return rows.withColumn(out, F.signum(F.col("amount")) * scaled)


def _stream_struct(rows: Column, dates: Column, balance: Column | None) -> Column:
    """Sorted transaction structs to one struct of arrays; NULL for an empty stream.

    What is the same for the whole day is repeated, not recomputed per transaction.
    """
    pick = lambda name: F.transform(rows, lambda r: r[name]).alias(name)
    volume = F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["size"])
    fields = [
        pick("cat_group"),
        pick("cat_sub"),
        pick("cat_cp"),
        F.transform(rows, lambda r: r["amount_std"].cast("float")).alias("amounts"),
        F.array_repeat(dates, F.size(rows)).alias("dates"),
    ]
    if balance is not None:
        fields.append(F.array_repeat(balance, F.size(rows)).alias("balance"))
    fields += [F.size(rows).alias("n_txns"), F.log1p(volume).cast("float").alias("log_total_volume")]
    return F.when(F.size(rows) > 0, F.struct(*fields))


def build_examples(
    txns: DataFrame,
    vocab: DataFrame | None = None,
    balance: DataFrame | None = None,
    variant: str = "arrival",
    max_days: int = 180,
    max_txns: int = 20,
    min_days: int = 9,
) -> DataFrame:
    """One row per account: ``account_id, n_days, days``.

    ``vocab`` is a vocabulary table (without one every token is unknown) and ``balance`` a frame
    of ``(accountId, date, balance ARRAY)``; days it does not have get zeros. Caps are applied
    before anything is collected, so a row holds at most
    ``max_days * 2 * max_txns`` transactions.
    """
    typed = txns.withColumn("accountId", F.col("accountId").cast("string"))
    capped = standardize_amounts(top_of_stream(typed, max_txns, variant))
    columns = feature_columns(typed)
    tokens = {f: F.col(f"`{c}`") if c else F.lit("UNK") for f, c in columns.items()}
    flat = capped.select(
        "accountId", "day", "stream", "rn", "amount_std", F.abs("amount").alias("size"),
        *[t.cast("string").alias(f"tok_{f}") for f, t in tokens.items()],
    )
    if vocab is None:
        coded = flat.withColumns({f: F.lit(UNK_ID) for f in tokens})
    else:
        coded = encode(flat, vocab, {f: f"tok_{f}" for f in tokens})
    row = F.struct("rn", *tokens, "amount_std", "size")
    per_day = coded.groupBy("accountId", "day").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("stream") == s, row))).alias(s) for s in STREAMS]
    )
    days = kept_days(typed, min_days, max_days).join(per_day, ["accountId", "day"], "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), N_BALANCE)
    vector = None
    if balance is not None:
        side = balance.select(
            F.col("accountId").alias("_acc"),
            F.col("date").alias("_date"),
            F.transform("balance", lambda x: x.cast("float")).alias("_balance"),
        )
        days = days.join(
            side, (account_key() == F.col("_acc")) & (F.col("day") == F.col("_date")), "left"
        ).drop("_acc", "_date")
        vector = F.coalesce(F.col("_balance"), zeros)
    month, weekend = month_and_weekend(F.col("day"))
    packed = days.select(
        "accountId",
        F.struct(
            day_number(F.col("day")).alias("day_offset"),
            month.alias("month"),
            weekend.alias("is_weekend"),
            *[_stream_struct(F.col(s), date_features(F.col("day")), vector).alias(s) for s in STREAMS],
        ).alias("d"),
    )
    return packed.groupBy(F.col("accountId").alias("account_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n_days"), F.sort_array(F.collect_list("d")).alias("days")
    )


def day_dates(days: Column) -> Column:
    return F.transform(days, lambda d: d["day_offset"])


def explode_examples(examples: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Examples back to one row per transaction, for joins and audits; ``carried`` columns are repeated on each."""
    days = examples.select(*carried, "account_id", F.inline("days"))
    streams = days.select(
        *carried, "account_id", "day_offset", "month", "is_weekend",
        F.inline(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("s")) for s in STREAMS])),
    ).filter(F.col("s").isNotNull())
    has_balance = "balance" in [f.name for f in streams.schema["s"].dataType.fields]
    names = ["cat_group", "cat_sub", "cat_cp", "amounts", "dates", *(["balance"] if has_balance else [])]
    return streams.select(
        *carried, "account_id", "day_offset", "month", "is_weekend", "stream",
        F.col("s.n_txns").alias("n_txns"), F.col("s.log_total_volume").alias("log_total_volume"),
        F.posexplode(F.arrays_zip(*[F.col(f"s.{n}").alias(n) for n in names])),
    ).select(
        *carried, "account_id", "day_offset", "month", "is_weekend", "stream", "n_txns", "log_total_volume",
        (F.col("pos") + 1).alias("rn"), *[F.col(f"col.{n}").alias(n) for n in names],
    )


def audit_examples(examples: DataFrame) -> DataFrame:
    """NaN and NULL values per account, day, stream and field, where there are any."""
    rows = explode_examples(examples)
    fields = [F.struct(F.lit("amounts").alias("field"), F.array("amounts").alias("vals"))]
    if "balance" in rows.columns:
        fields.append(F.struct(F.lit("balance").alias("field"), F.col("balance").alias("vals")))
    bad = lambda test: F.size(F.filter("vals", test)).cast("long")
    return (
        rows.select("account_id", "day_offset", "stream", F.inline(F.array(*fields)))
        .groupBy("account_id", "day_offset", "stream", "field")
        .agg(
            F.sum(bad(lambda v: F.isnan(v))).alias("n_nan"),
            F.sum(bad(lambda v: v.isNull())).alias("n_null"),
        )
        .filter((F.col("n_nan") > 0) | (F.col("n_null") > 0))
    )


def _pad(values: Column, length: Column, filler: Column) -> Column:
    return F.concat(values, F.array_repeat(filler, length - F.size(values)))


def pad_batches(examples: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad every example to its batch's rectangle, with masks.

    Only the three maxima per batch are aggregated and joined back; the nested rows themselves
    move once, by account batch.
    """
    longest = lambda s: F.array_max(
        F.transform("days", lambda d: F.coalesce(d[s]["n_txns"], F.lit(0)))
    )
    dims = examples.groupBy(batch).agg(
        F.max(F.size("days")).alias("max_days"),
        *[F.greatest(F.lit(1), F.max(longest(s))).alias(f"max_tx_{s}") for s in STREAMS],
    )
    joined = examples.join(dims, batch)
    width = F.col("max_days")
    stream_type = {f.name: f for f in examples.schema["days"].dataType.elementType["pos"].dataType.fields}
    zero_int, zero_float = F.lit(0), F.lit(0.0).cast("float")
    fillers = {
        "cat_group": zero_int, "cat_sub": zero_int, "cat_cp": zero_int, "amounts": zero_float,
        "dates": F.array_repeat(zero_float, N_DATE),
        "balance": F.array_repeat(zero_float, N_BALANCE),
    }
    fillers = {k: v for k, v in fillers.items() if k in stream_type}

    def rectangle(s: str) -> Column:
        depth = F.col(f"max_tx_{s}")
        per_day = lambda fn: F.transform("days", fn)
        cols = []
        for name, fill in fillers.items():
            blank = F.array_repeat(fill, depth)
            filled = per_day(lambda d: F.when(d[s].isNull(), blank).otherwise(_pad(d[s][name], depth, fill)))
            cols.append(_pad(filled, width, blank).alias(name))
        off = F.array_repeat(F.lit(False), depth)
        on = lambda d: F.coalesce(d[s]["n_txns"], F.lit(0))
        mask = per_day(
            lambda d: F.concat(F.array_repeat(F.lit(True), on(d)), F.array_repeat(F.lit(False), depth - on(d)))
        )
        cols.append(_pad(mask, width, off).alias("mask"))
        cols.append(_pad(per_day(lambda d: d[s].isNotNull()), width, F.lit(False)).alias("has_data"))
        volume = per_day(lambda d: F.coalesce(d[s]["log_total_volume"], zero_float))
        cols.append(_pad(volume, width, zero_float).alias("log_total_volume"))
        return F.struct(*cols).alias(s)

    number = lambda name: _pad(F.transform("days", lambda d: d[name]), width, F.lit(0))
    return joined.select(
        batch, "account_id", "max_days", "max_tx_pos", "max_tx_neg",
        rectangle("pos"), rectangle("neg"),
        F.concat(
            F.array_repeat(F.lit(True), F.size("days")), F.array_repeat(F.lit(False), width - F.size("days"))
        ).alias("day_mask"),
        number("day_offset").alias("day_dates"),
        number("month").alias("day_month"),
        number("is_weekend").alias("day_weekend"),
    )
