"""Queries on running, daily and rolling balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators.keys import column_report
from ..plans import views as V
from .registry import query
from .sqlviews import ACCT, BANKED, LEDGER, LEDGER_SHORT, TXN_LONG, with_views


@query(
    "daily_balances",
    "accountId:s date:s balance:f4 running_date:s",
    with_views(LEDGER) + " SELECT * FROM daily",
)
def daily_balances(spark, sf):
    return B.daily_balances(V.txn_long(spark, sf), V.acct(spark, sf))


@query(
    "running_balance",
    "accountId:s id:s date:s direction:s amount:f4 balance_after:f4",
    with_views(LEDGER) + " SELECT * FROM ledger",
)
def running_balance(spark, sf):
    return B.running_balance(V.txn_long(spark, sf), V.acct(spark, sf))


@query(
    "balance_unknown_account",
    "accountId:s id:s balance_after:f4",
    with_views(TXN_LONG) + ' SELECT "accountId", id, NULL AS balance_after FROM txn_long',
)
def balance_unknown_account(spark, sf):
    """Accounts that do not occur in the account table have no balance."""
    accounts = V.acct(spark, sf).withColumn("accountId", F.concat(F.lit("other"), F.col("accountId")))
    return B.running_balance(V.txn_long(spark, sf), accounts)


@query(
    "latest_snapshot",
    "accountId:s availableBalance:f2 balanceDateTime:s",
    """SELECT CAST(o_custkey AS VARCHAR) AS "accountId", o_totalprice AS "availableBalance",
              CAST(o_orderdate AS DATE) AS "balanceDateTime"
       FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_totalprice) = 1""",
)
def latest_snapshot(spark, sf):
    snaps = V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("accountId"),
        F.col("o_totalprice").alias("availableBalance"),
        F.col("o_orderdate").alias("balanceDateTime"),
    )
    return B.latest_snapshot(snaps)


@query(
    "normalize_signs",
    "id:s amount:f2",
    with_views(TXN_LONG)
    + """, u AS (SELECT id, direction, abs(amount) AS amount FROM txn_long),
      f AS (SELECT coalesce(avg(CASE WHEN amount > 0 THEN 1.0 ELSE 0.0 END) FILTER (direction = 'D') > 0.99, false)
                OR coalesce(avg(CASE WHEN amount < 0 THEN 1.0 ELSE 0.0 END) FILTER (direction = 'C') > 0.99, false) AS flip
            FROM u)
      SELECT id, CASE WHEN (SELECT flip FROM f) THEN -amount ELSE amount END AS amount FROM u""",
)
def normalize_signs(spark, sf):
    return B.normalize_signs(V.txn_unsigned(spark, sf))


@query(
    "normalize_signs_by_bank",
    "id:s bank:s amount:f2",
    with_views(TXN_LONG, BANKED)
    + """, u AS (SELECT id, bank, direction, CASE WHEN bank < 'B' THEN abs(amount) ELSE amount END AS amount FROM txn_banked),
      f AS (SELECT bank, coalesce(avg(CASE WHEN amount > 0 THEN 1.0 ELSE 0.0 END) FILTER (direction = 'D') > 0.99, false)
                OR coalesce(avg(CASE WHEN amount < 0 THEN 1.0 ELSE 0.0 END) FILTER (direction = 'C') > 0.99, false) AS flip
            FROM u GROUP BY bank)
      SELECT id, u.bank, CASE WHEN flip THEN -amount ELSE amount END AS amount FROM u JOIN f ON u.bank = f.bank""",
)
def normalize_signs_by_bank(spark, sf):
    t = V.txn_banked(spark, sf)
    mixed = t.withColumn("amount", F.when(F.col("bank") < "B", F.abs("amount")).otherwise(F.col("amount")))
    return B.normalize_signs(mixed, by=["bank"])


@query(
    "pending_rows",
    "accountId:s id:s date:s amount:f2 direction:s",
    with_views(LEDGER) + " SELECT * FROM pend",
)
def pending_rows(spark, sf):
    return B.pending_rows(V.txn_long(spark, sf), B.latest_snapshot(V.acct(spark, sf)))


@query(
    "historical_sums",
    "accountId:s historical_total:f4 initial_balance:f4",
    with_views(LEDGER)
    + """ SELECT "accountId",
             coalesce(sum(CASE WHEN date <= "balanceDateTime" THEN amount END), 0) AS historical_total,
             max("availableBalance") - coalesce(sum(CASE WHEN date <= "balanceDateTime" THEN amount END), 0)
               AS initial_balance
           FROM ledger GROUP BY "accountId" """,
)
def historical_sums(spark, sf):
    return B.historical_sums(V.txn_long(spark, sf), V.acct(spark, sf))


def _daily(spark, sf):
    return B.daily_balances(V.txn_long(spark, sf), V.acct(spark, sf))


#: Days that the ranges of balance_window_stats look back, by turns: a quarter, three years, all of it, one day.
LENGTHS = (90, 1000, 2600, 0)


def _probes(spark, sf):
    o = V.table(spark, sf, "orders")
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("probe"),
        F.col("o_custkey").alias("accountId"),
        day.alias("date"),
        F.date_sub(day, LENGTHS[0]).alias("start_date"),
        day.alias("end_date"),
    )


PROBES = """,
probes AS (
  SELECT o_orderkey AS probe, CAST(o_custkey AS VARCHAR) AS "accountId",
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) AS date FROM orders)"""


@query(
    "balance_on_date",
    "probe:i date:s balance:f4",
    with_views(LEDGER)
    + PROBES
    + ' SELECT probe, p.date, d.balance FROM probes p LEFT JOIN daily d ON p."accountId" = d."accountId" AND p.date = d.date',
)
def balance_on_date(spark, sf):
    return B.balance_on(_probes(spark, sf), _daily(spark, sf))


@query(
    "starting_balance_as_of",
    "probe:i date:s starting_balance:f4",
    with_views(LEDGER)
    + PROBES
    + """, firsts AS (SELECT "accountId", arg_min(balance, date) AS first_balance FROM daily GROUP BY "accountId"),
      hits AS (
        SELECT probe, p.date, p."accountId", d.balance
        FROM probes p ASOF LEFT JOIN daily d ON p."accountId" = d."accountId" AND p.date > d.date)
      SELECT probe, h.date, coalesce(h.balance, f.first_balance) AS starting_balance
      FROM hits h LEFT JOIN firsts f ON h."accountId" = f."accountId" """,
)
def starting_balance_as_of(spark, sf):
    return B.starting_balance_on(_probes(spark, sf), _daily(spark, sf))


@query(
    "balance_window_stats",
    "probe:i start_balance:f4 end_balance:f4 balance_change:f4 min_balance:f4 max_balance:f4 avg_balance:f7 balance_volatility:f3",
    with_views(LEDGER)
    + PROBES
    + """ SELECT probe, arg_min(balance, d.date) AS start_balance, arg_max(balance, d.date) AS end_balance,
             arg_max(balance, d.date) - arg_min(balance, d.date) AS balance_change,
             min(balance) AS min_balance, max(balance) AS max_balance, avg(balance) AS avg_balance,
             stddev_pop(balance) AS balance_volatility
           FROM probes p LEFT JOIN daily d
             ON p."accountId" = d."accountId" AND d.date BETWEEN p.date - [90, 1000, 2600, 0][p.probe % 4 + 1] AND p.date
           GROUP BY probe""",
)
def balance_window_stats(spark, sf):
    """Ranges of a day, a quarter and of years."""
    back = F.get(F.array(*[F.lit(n) for n in LENGTHS]), (F.col("probe") % 4).cast("int"))
    return B.window_stats(_probes(spark, sf).withColumn("start_date", F.date_sub("end_date", back)), _daily(spark, sf))


def _daily_short(spark, sf):
    return B.daily_balances(V.txn_short(spark, sf), V.acct_events(spark, sf))


@query(
    "rolling_balance_features",
    "accountId:s date:s start:f4 end:f4 min:f4 max:f4 avg:f7 std:f4 starting:f4",
    with_views(LEDGER_SHORT) + " SELECT * FROM rolled_short",
)
def rolling_balance_features(spark, sf):
    return B.rolling_features(_daily_short(spark, sf))


@query(
    "starting_balance_on_grid",
    "accountId:s date:s starting:f4 strict_starting:f4",
    with_views(LEDGER_SHORT)
    + """ SELECT "accountId", date, starting,
             lag(g.balance) OVER (PARTITION BY "accountId" ORDER BY date) AS strict_starting
           FROM rolled_short JOIN grid_short g USING ("accountId", date)""",
)
def starting_balance_on_grid(spark, sf):
    daily = _daily_short(spark, sf)
    strict = B.rolling_features(daily, strict=True).select(
        "accountId", "date", F.col("starting").alias("strict_starting")
    )
    return B.rolling_features(daily).join(strict, ["accountId", "date"])


def _slog(col: str) -> str:
    return f'coalesce(CASE WHEN "{col}" < 0 THEN -ln(1 + abs("{col}")) ELSE ln(1 + abs("{col}")) END, 0)'


@query(
    "signed_log_balance_features",
    "accountId:s date:s f0:f6 f1:f6 f2:f6 f3:f6 f4:f6 f5:f5 f6:f6",
    with_views(LEDGER_SHORT)
    + ' SELECT "accountId", date, '
    + ", ".join(f"{_slog(c)} AS f{i}" for i, c in enumerate(B.FEATURES))
    + " FROM rolled_short",
)
def signed_log_balance_features(spark, sf):
    vec = B.feature_vector(B.rolling_features(_daily_short(spark, sf)), log=True)
    return vec.select("accountId", "date", *[F.col("balance")[i].alias(f"f{i}") for i in range(7)])


@query(
    "missing_columns",
    "table:s column:s state:s n_rows:i n_filled:i",
    with_views(TXN_LONG, ACCT)
    + """ SELECT 'transactions' AS "table", 'direction' AS "column", 'absent' AS state, count(*) AS n_rows, 0 AS n_filled FROM txn_long
          UNION ALL SELECT 'transactions', 'amount', 'empty', count(*), 0 FROM txn_long
          UNION ALL SELECT 'accounts', 'balanceDateTime', 'absent', count(*), 0 FROM acct""",
)
def missing_columns(spark, sf):
    """What a balance run would find wrong with tables that lack columns or hold nothing in them."""
    txns = V.txn_long(spark, sf).drop("direction").withColumn("amount", F.when(F.col("amount") > 1e12, F.col("amount")))
    accounts = V.acct(spark, sf).drop("balanceDateTime")
    return column_report({"transactions": (txns, B.TXN_REQUIRED), "accounts": (accounts, B.ACC_REQUIRED)})
