"""Running, daily and rolling balances reconstructed from one snapshot per account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import signed_log
from ..session import stored
from .keys import first_in_group, require_columns, tie_break
from .ordered import ROWS_PER_CHUNK, add_running, chunk_totals, cuts_at_or_below

TXN_REQUIRED = ("accountId", "id", "date", "amount", "direction")
ACC_REQUIRED = ("accountId", "availableBalance", "balanceDateTime")
PENDING_ID = "PENDING_ROLLBACK"  # Fixed value.
NO_ACCOUNT = "NAN"  # Fixed value: the key of rows without an account id.
FLIP_SHARE = 0.99  # Fixed value: share of wrong-signed rows above which all signs flip.
FEATURES = ("start", "end", "min", "max", "avg", "std", "starting")


def account_key(col: str | Column = "accountId") -> Column:
    """Account ids compare as upper-case text; rows without one share a marker."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.upper(col.cast("string")), F.lit(NO_ACCOUNT))


def latest_snapshot(accounts: DataFrame) -> DataFrame:
    """The account row with the latest snapshot day."""
    require_columns(accounts, ACC_REQUIRED, "accounts")
    acc = accounts.withColumn("accountId", account_key()).withColumn(
        "balanceDateTime", F.to_date("balanceDateTime")
    )
    order = tie_break(
        acc,
        [F.col("balanceDateTime").desc_nulls_last(), F.col("availableBalance").asc_nulls_last()],
        skip=("accountId", "balanceDateTime", "availableBalance"),
    )
    return first_in_group(acc, ["accountId"], order)


def dedupe_transactions(txns: DataFrame) -> DataFrame:
    """Canonical keys and days, and one row per ``(accountId, id)``."""
    require_columns(txns, TXN_REQUIRED, "transactions")
    typed = (
        txns.withColumn("accountId", account_key())
        .withColumn("id", F.col("id").cast("string"))
        .withColumn("date", F.to_date("date"))
        .withColumn("amount", F.nanvl(F.col("amount").cast("double"), F.lit(None).cast("double")))
    )
    lead = ("date", "amount", "direction")
    order = tie_break(
        typed, [F.col(c).asc_nulls_last() for c in lead], skip=("accountId", "id", *lead)
    )
    return first_in_group(typed, ["accountId", "id"], order)


def _sign_counts() -> list[Column]:
    """Aggregates: rows of either direction, and how many of them have the other one's sign."""
    debit, credit = F.col("direction") == "D", F.col("direction") == "C"
    count = lambda c: F.count(F.when(c, 1))
    return [
        count(debit).alias("n_debit"), count(debit & (F.col("amount") > 0)).alias("debit_wrong"),
        count(credit).alias("n_credit"), count(credit & (F.col("amount") < 0)).alias("credit_wrong"),
    ]


SIGN_COUNTS = ("n_debit", "debit_wrong", "n_credit", "credit_wrong")


def _flip(n: dict[str, Column]) -> Column:
    """True when nearly all debits are positive or nearly all credits negative."""
    share = lambda wrong, rows: F.coalesce(wrong / F.when(rows > 0, rows) > FLIP_SHARE, F.lit(False))
    return share(n["debit_wrong"], n["n_debit"]) | share(n["credit_wrong"], n["n_credit"])


def with_flip(rows: DataFrame, counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``_flip`` to ``rows``, from a table that carries the sign counts (of days, or of anything else)."""
    flips = counted.groupBy(*by).agg(_flip({c: F.sum(c) for c in SIGN_COUNTS}).alias("_flip"))
    return rows.join(flips, list(by), "left") if by else rows.withColumn("_flip", flips.scalar())


def _signed(column: str) -> Column:
    return F.when(F.col("_flip"), -F.col(column)).otherwise(F.col(column))


def normalize_signs(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flip every amount when the sign convention is reversed, per ``by`` group or overall."""
    marked = with_flip(txns, txns.groupBy(*by).agg(*_sign_counts()), by)
    return marked.withColumn("amount", _signed("amount")).drop("_flip")


def ledger_days(txns: DataFrame, sign_by: Sequence[str] = ()) -> DataFrame:
    """The state that all daily balances are made of: one row per account and day (and ``sign_by``) with the sum of its
    amounts and its sign counts.

    Transactions are read once, deduplicated and summed; the days are written to the shared folder. Whether signs are
    flipped, which accounts there are and which day is the last all follow from them, as a flip of a sum is the sum of
    flips.
    """
    keep = [*TXN_REQUIRED, *[c for c in sign_by if c not in TXN_REQUIRED]]
    rows = dedupe_transactions(txns.select(*keep))
    return stored(rows.groupBy("accountId", "date", *sign_by).agg(F.sum("amount").alias("day_sum"), *_sign_counts()), "days")


def _day_sums(
    txns: DataFrame, accounts: DataFrame, include_pending: bool, sign_by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``accountId, date, day_sum`` with signs put right and pending amounts added, and the snapshots. Reads each input
    once."""
    state, snaps = ledger_days(txns, sign_by), stored(latest_snapshot(accounts), "snapshots")
    days = with_flip(state, state, sign_by).select("accountId", "date", _signed("day_sum").alias("day_sum"))
    if include_pending and "estimatedPendingAmount" in accounts.columns:
        waiting = pending_rows(state, snaps).select("accountId", "date", F.col("amount").alias("day_sum"))
        days = days.unionByName(waiting)
    # a day has several rows where signs are counted by group, or where an amount is pending
    days = days.groupBy("accountId", "date").agg(F.sum("day_sum").alias("day_sum"))
    return days, snaps.select("accountId", "availableBalance", "balanceDateTime")


def pending_rows(txns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One synthetic row per account that has transactions and a non-zero pending amount."""
    amount = F.col("estimatedPendingAmount").cast("double")
    seen = txns.select(account_key().alias("accountId")).distinct()
    return (
        snapshots.filter(amount.isNotNull() & ~F.isnan(amount) & (amount != 0))
        .join(seen, "accountId", "left_semi")
        .select(
            "accountId",
            F.lit(PENDING_ID).alias("id"),
            F.col("balanceDateTime").alias("date"),
            amount.alias("amount"),
            F.when(amount > 0, "D").otherwise("C").alias("direction"),
        )
    )


def opening_balances(totals: DataFrame, snaps: DataFrame, total: str, order: Sequence[str]) -> DataFrame:
    """``opening`` balance before each day (or part of a day): snapshot - history + what came before.

    ``totals`` holds one row per account and day (or chunk of a day), so the windows see about
    one row per calendar day however many transactions the account has.
    """
    grid = totals.join(snaps, "accountId", "left")
    whole = Window.partitionBy("accountId")
    before = whole.orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("date") <= F.col("balanceDateTime"), F.col(total))
    history = F.coalesce(F.sum(known).over(whole), F.lit(0.0))
    earlier = F.coalesce(F.sum(total).over(before), F.lit(0.0))
    return grid.withColumn("opening", F.col("availableBalance") - history + earlier).drop(
        "availableBalance", "balanceDateTime"
    )


def historical_sums(txns: DataFrame, accounts: DataFrame, include_pending: bool = True) -> DataFrame:
    """Per account: sum of amounts up to the snapshot day, and the balance before everything."""
    days, snaps = _day_sums(txns, accounts, include_pending, ())
    hist = F.when(F.col("date") <= F.col("balanceDateTime"), F.col("day_sum"))
    return (
        days.join(snaps, "accountId", "left")
        .groupBy("accountId")
        .agg(
            F.coalesce(F.sum(hist), F.lit(0.0)).alias("historical_total"),
            F.max("availableBalance").alias("availableBalance"),
        )
        .withColumn("initial_balance", F.col("availableBalance") - F.col("historical_total"))
    )


def running_balance(
    txns: DataFrame,
    accounts: DataFrame,
    include_pending: bool = True,
    sign_by: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``balance_after`` for every transaction, in ``(accountId, date, id)`` order.

    NULL where the account has no snapshot or the row has no amount. Each input is read once: the deduplicated rows
    are written to the shared folder, and signs, pending rows, cuts and totals are made from there.
    """
    rows, snaps = stored(dedupe_transactions(txns), "ledger"), stored(latest_snapshot(accounts), "snapshots")
    raw_ids = rows.select("accountId", "date", "id")
    rows = with_flip(rows, rows.groupBy(*sign_by).agg(*_sign_counts()), sign_by)
    rows = rows.withColumn("amount", _signed("amount")).drop("_flip")
    if include_pending and "estimatedPendingAmount" in accounts.columns:
        rows = rows.unionByName(pending_rows(raw_ids, snaps), allowMissingColumns=True)
    snaps = snaps.select("accountId", "availableBalance", "balanceDateTime")
    # Undated rows come last, in a day of their own.
    day = F.coalesce(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(2**31 - 1))
    chunked, totals = chunk_totals(
        rows.withColumn("_day", day),
        ["accountId"],
        ["id"],
        {"amount": F.col("amount")},
        coarse=["_day"],
        rows_per_chunk=rows_per_chunk,
        cut_source=raw_ids.withColumn("_day", day).drop("date"),
    )
    dated = totals.withColumn(
        "date", F.when(F.col("_day") < 2**31 - 1, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")))
    )
    offsets = opening_balances(dated, snaps, "_t_amount", ["_day", "_chunk"]).select(
        "accountId", "_day", "_chunk", "opening"
    )
    running = {"_running": (F.col("amount"), "opening")}
    return (
        add_running(chunked, offsets, ["accountId"], ["id"], running, coarse=["_day"])
        .withColumn("balance_after", F.when(F.col("amount").isNotNull(), F.col("_running")))
        .drop("_running", "_day")
    )


def daily_balances(
    txns: DataFrame, accounts: DataFrame, include_pending: bool = True, sign_by: Sequence[str] = ()
) -> DataFrame:
    """Closing balance per account and active day, plus the latest day of the whole data.

    The close of a day is its opening balance plus the day's sum, so only per-day sums are
    shuffled, never the ordered transactions. Each input is read once.
    """
    days, snaps = _day_sums(txns, accounts, include_pending, sign_by)
    days = stored(days, "signed-days")
    running_date = days.agg(F.max("date").alias("d")).scalar()
    return (
        opening_balances(days, snaps, "day_sum", ["date"])
        .filter(F.col("date").isNotNull())
        .select(
            "accountId", "date", (F.col("opening") + F.col("day_sum")).alias("balance"),
        )
        .withColumn("running_date", running_date)
    )


def balance_on(probes: DataFrame, daily: DataFrame) -> DataFrame:
    """Closing balance on exactly the probe's day, NULL where there is none."""
    keyed = probes.withColumn("_acc", account_key()).withColumn("_day", F.to_date("date"))
    right = daily.select(F.col("accountId").alias("_acc"), F.col("date").alias("_day"), "balance")
    return keyed.join(right, ["_acc", "_day"], "left").drop("_acc", "_day")


def starting_balance_on(probes: DataFrame, daily: DataFrame, strict: bool = False) -> DataFrame:
    """Latest close strictly before the probe's day.

    Without an earlier day this is the account's earliest close, or NULL if ``strict``; an
    unknown account gives NULL. Probes are reduced to distinct account days before the window,
    so its partitions hold at most two rows per calendar day.
    """
    keyed = probes.withColumn("_acc", account_key()).withColumn("_day", F.to_date("date"))
    asked = keyed.select("_acc", "_day").distinct().withColumn("_bal", F.lit(None).cast("double"))
    known = daily.select(
        F.col("accountId").alias("_acc"), F.col("date").alias("_day"), F.col("balance").alias("_bal")
    )
    merged = asked.withColumn("_asked", F.lit(1)).unionByName(known.withColumn("_asked", F.lit(0)))
    per_acc = Window.partitionBy("_acc").orderBy(F.datediff("_day", F.lit("1970-01-01").cast("date")))
    earlier = per_acc.rangeBetween(Window.unboundedPreceding, -1)
    whole = per_acc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close = F.last("_bal", ignorenulls=True).over(earlier)
    if not strict:
        close = F.coalesce(close, F.first("_bal", ignorenulls=True).over(whole))
    answers = (
        merged.withColumn("starting_balance", close)
        .filter("_asked = 1")
        .select("_acc", "_day", "starting_balance")
    )
    return keyed.join(answers, ["_acc", "_day"], "left").drop("_acc", "_day")


#: Blocks of 2 ** LEVELS days, the largest ones that a range of days is cut into, span 90 years.
LEVELS = 15


def _leaf(balance: Column) -> Column:
    """The summary of one day: ``n, mean, dev`` (squared deviations from it), ``low, high``. Two summaries merge into one."""
    return F.struct(
        F.lit(1).cast("long").alias("n"), balance.alias("mean"), F.lit(0.0).alias("dev"), balance.alias("low"), balance.alias("high")
    )


def _merge(a: Column, b: Column) -> Column:
    """One summary of two: means and deviations by their counts; of one where the other is NULL."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"),
        (a["dev"] + b["dev"] + apart * apart * a["n"] * b["n"] / n).alias("dev"),
        F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def account_history(daily: DataFrame) -> DataFrame:
    """One row per account: ``_days`` and ``_bals``, its days that have a balance in order, and ``_levels``, the summaries of
    2, 4, 8, ... of them that follow each other, up to all.

    A row holds as many days and as many summaries as the account has active days, so it is bounded by the calendar: 90 years
    of days are some 2 MB.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    known = daily.filter(F.col("date").isNotNull() & F.col("balance").isNotNull())
    rows = known.groupBy(F.col("accountId").alias("_acc")).agg(
        F.sort_array(F.collect_list(F.struct(day.alias("day"), F.col("balance").cast("double").alias("bal")))).alias("_rows")
    )
    pairs = lambda level: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
        lambda i: _merge(F.get(level, i * 2), F.get(level, i * 2 + 1)),
    )
    leaves = F.array(F.transform("_rows", lambda r: _leaf(r["bal"])))
    every = F.aggregate(
        F.sequence(F.lit(1), F.length(F.bin(F.size("_rows") - 1))), leaves, lambda acc, _: F.concat(acc, F.array(pairs(F.element_at(acc, -1))))
    )
    return rows.select(
        "_acc", F.transform("_rows", lambda r: r["day"]).alias("_days"), F.transform("_rows", lambda r: r["bal"]).alias("_bals"),
        F.slice(every, 2, F.size(every) - 1).alias("_levels"),
    )


def _blocks_between(lo: Column, hi: Column, levels: Column) -> Column:
    """The fewest blocks of 1, 2, 4, ... up to 2 ** ``levels`` places, starting at multiples of their length, that make up the
    places from ``lo`` until before ``hi``: at most two of a length, except the longest."""
    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        block = lambda at: F.array(F.struct(level.alias("_level"), at.alias("_block")))
        none = F.slice(block(lo), 1, 0)
        odd_lo, odd_hi = (lo < hi) & (lo.bitwiseAND(1) == 1), hi.bitwiseAND(1) == 1
        after = F.when(odd_lo, lo + 1).otherwise(lo)
        odd_hi = odd_hi & (after < hi)
        before = F.when(odd_hi, hi - 1).otherwise(hi)
        taken = F.concat(acc["taken"], F.when(odd_lo, block(lo)).otherwise(none), F.when(odd_hi, block(hi - 1)).otherwise(none))
        return F.struct(F.shiftright(after, 1).alias("lo"), F.shiftright(before, 1).alias("hi"), taken.alias("taken"))

    empty = F.slice(F.array(F.struct(F.lit(0).alias("_level"), lo.alias("_block"))), 1, 0)
    first = F.struct(lo.alias("lo"), hi.alias("hi"), empty.alias("taken"))
    small = F.aggregate(F.sequence(F.lit(0), levels - 1), first, step)
    rest = F.when(
        small["lo"] < small["hi"],
        F.transform(F.sequence(small["lo"], small["hi"] - 1), lambda at: F.struct(levels.alias("_level"), at.alias("_block"))),
    ).otherwise(empty)
    return F.concat(small["taken"], rest)


def _range_blocks(start: Column, end: Column) -> Column:
    """The fewest blocks that make up the days from ``start`` to ``end``."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    return _blocks_between(number(start), number(end) + 1, F.lit(LEVELS))


def window_stats(probes: DataFrame, daily: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Balance statistics over ``[start, end]`` for each probe; all NULL when the range has no day with a balance.

    An account's days travel once, as one row with mergeable summaries of them, and so does a probe, to the row of its account:
    nothing is sent for each block. A range of n active days is put together there from at most 2 log2 n summaries,
    however long it is. An account with very many probes is left to adaptive execution, which deals them to several tasks.
    """
    number = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    keyed = probes.withColumns({"_acc": account_key(), "_from": number(start), "_to": number(end)})
    joined = keyed.join(stored(account_history(daily), "history"), "_acc", "left")
    places = joined.withColumns(
        {"_lo": cuts_at_or_below(F.col("_days"), F.col("_from") - 1), "_hi": cuts_at_or_below(F.col("_days"), F.col("_to"))}
    )
    blocks = _blocks_between(F.col("_lo"), F.col("_hi"), F.size("_levels"))
    summary = lambda b: F.when(b["_level"] == 0, _leaf(F.get("_bals", b["_block"]))).otherwise(
        F.get(F.get("_levels", b["_level"] - 1), b["_block"])
    )
    none = F.when(F.lit(False), _leaf(F.lit(0.0)))
    some = F.col("_from").isNotNull() & F.col("_to").isNotNull() & (F.col("_lo") < F.col("_hi"))
    whole = F.when(some, F.aggregate(blocks, none, lambda acc, b: _merge(acc, summary(b))))
    stats = places.withColumns(
        {"_all": whole, "_first": F.when(some, F.get("_bals", F.col("_lo"))), "_last": F.when(some, F.get("_bals", F.col("_hi") - 1))}
    )
    return stats.withColumns(
        {
            "start_balance": F.col("_first"), "end_balance": F.col("_last"),
            "min_balance": F.col("_all.low"), "max_balance": F.col("_all.high"), "avg_balance": F.col("_all.mean"),
            "balance_volatility": F.sqrt(F.col("_all.dev") / F.col("_all.n")),
            "balance_change": F.col("_last") - F.col("_first"),
        }
    ).drop("_acc", "_from", "_to", "_days", "_bals", "_levels", "_lo", "_hi", "_all", "_first", "_last")


def rolling_features(daily: DataFrame, back: int = 8, until: int = 1, strict: bool = False) -> DataFrame:
    """Balance features of each active day over the days ``[d - back, d - until]``.

    Columns ``start, end, min, max, avg, std, starting``, NULL when the window has no day. The
    default window ends yesterday, so a day never sees its own close (except ``starting`` on an
    account's first day, unless ``strict``).
    """
    per_acc = Window.partitionBy("accountId").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date")))
    win = per_acc.rangeBetween(-back, -until)
    whole = per_acc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starting = F.lag("balance").over(per_acc)
    if not strict:
        starting = F.coalesce(starting, F.first("balance").over(whole))
    return daily.select(
        "accountId",
        "date",
        F.first("balance").over(win).alias("start"),
        F.last("balance").over(win).alias("end"),
        F.min("balance").over(win).alias("min"),
        F.max("balance").over(win).alias("max"),
        F.avg("balance").over(win).alias("avg"),
        F.stddev_pop("balance").over(win).alias("std"),
        starting.alias("starting"),
    )


def feature_vector(rolled: DataFrame, log: bool) -> DataFrame:
    """The seven rolling features as one array, zeros for NULLs, log-scaled on request."""
    value = (lambda c: signed_log(F.col(c))) if log else (lambda c: F.coalesce(F.col(c), F.lit(0.0)))
    return rolled.select("accountId", "date", F.array(*[value(c) for c in FEATURES]).alias("balance"))
