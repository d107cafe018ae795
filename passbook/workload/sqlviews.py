"""SQL text of the ledger views, for the oracle statements."""

TXN_LONG = """
txn_long AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS "accountId",
         'U' || o_custkey AS user_name, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderstatus = 'O' THEN 'C' ELSE 'D' END AS direction,
         CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END AS amount,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'C1202' WHEN '2' THEN 'C1203'
              WHEN '3' THEN 'C2202' WHEN '4' THEN 'C2501' WHEN '5' THEN 'C2211' END AS "subCategoryId",
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CG1200' WHEN '2' THEN 'CG1200'
              WHEN '3' THEN 'CG2200' WHEN '4' THEN 'CG2500' WHEN '5' THEN 'CG2200' END AS "categoryGroupId",
         o_custkey || ':' || o_orderpriority AS "patternId",
         'DEV' || (o_orderkey % 97) AS "deviceId"
  FROM orders)"""

ACCT = """
acct AS (
  SELECT CAST(c_custkey AS VARCHAR) AS "accountId",
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Checking' ELSE c_mktsegment END AS type,
         c_acctbal AS "availableBalance", DATE '1999-01-01' AS "balanceDateTime",
         CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 7 - 3 AS DOUBLE) * 10 ELSE 0 END
           AS "estimatedPendingAmount"
  FROM customer)"""

BANKED = """
bank_of AS (
  SELECT CAST(c_custkey AS VARCHAR) AS "accountId", r_name AS bank
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
txn_banked AS (SELECT t.*, b.bank FROM txn_long t JOIN bank_of b USING ("accountId"))"""

TXN_SHORT = """
txn_short AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS "accountId",
         'U' || user_id AS user_name, CAST(ts AS DATE) AS date, ts,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'D' ELSE 'C' END AS direction,
         CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END AS amount,
         event_type AS "subCategoryId",
         CASE WHEN event_type IN ('purchase', 'error') THEN 'spend' ELSE 'income' END AS "categoryGroupId",
         json_extract_string(props, '$.k') AS counter_party
  FROM events)"""

ACCT_EVENTS = """
acct_events AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS "accountId",
         CAST(user_id * 10 + 100 AS DOUBLE) AS "availableBalance", DATE '2024-01-15' AS "balanceDateTime"
  FROM events)"""

PATTERNS = """
patterns AS (
  SELECT DISTINCT o_custkey || ':' || o_orderpriority AS "patternId",
         CASE o_custkey % 3 WHEN 0 THEN 'DateOfMonth' WHEN 1 THEN 'NoisyDateOfMonth'
              ELSE 'MonthlyPayments' END AS "patternTypeBusiness",
         'DEV' || o_custkey AS "deviceId"
  FROM orders)"""

SCORES = """
scores AS (
  SELECT d.lang AS grp, CAST(l.doc_id AS VARCHAR) AS id, l.quality AS label,
         ((l.doc_id * 7919 + d.n_chars) % 101) / CAST(101 AS DOUBLE) AS score
  FROM labels l JOIN documents d USING (doc_id))"""

# Running balance after each transaction of txn_long, pending rows included.
LEDGER = (
    TXN_LONG
    + ","
    + ACCT
    + """,
pend AS (
  SELECT "accountId", 'PENDING_ROLLBACK' AS id, "balanceDateTime" AS date,
         "estimatedPendingAmount" AS amount,
         CASE WHEN "estimatedPendingAmount" > 0 THEN 'D' ELSE 'C' END AS direction
  FROM acct WHERE "estimatedPendingAmount" <> 0
    AND "accountId" IN (SELECT "accountId" FROM txn_long)),
entries AS (
  SELECT "accountId", id, date, amount, direction FROM txn_long
  UNION ALL SELECT "accountId", id, date, amount, direction FROM pend),
ledger AS (
  SELECT e.*, a."availableBalance", a."balanceDateTime",
         a."availableBalance"
         - coalesce(sum(CASE WHEN e.date <= a."balanceDateTime" THEN e.amount END)
                    OVER (PARTITION BY e."accountId"), 0)
         + sum(e.amount) OVER (PARTITION BY e."accountId" ORDER BY e.date, e.id
                               ROWS UNBOUNDED PRECEDING) AS balance_after
  FROM entries e LEFT JOIN acct a USING ("accountId")),
daily AS (
  SELECT "accountId", date, arg_max(balance_after, id) AS balance,
         (SELECT max(date) FROM entries) AS running_date
  FROM ledger GROUP BY "accountId", date)"""
)

# Daily balances of the event ledger.
LEDGER_SHORT = (
    TXN_SHORT
    + ","
    + ACCT_EVENTS
    + """,
ledger_short AS (
  SELECT t.*, a."availableBalance"
         - coalesce(sum(CASE WHEN t.date <= a."balanceDateTime" THEN t.amount END)
                    OVER (PARTITION BY t."accountId"), 0)
         + sum(t.amount) OVER (PARTITION BY t."accountId" ORDER BY t.date, t.id
                               ROWS UNBOUNDED PRECEDING) AS balance_after
  FROM txn_short t LEFT JOIN acct_events a USING ("accountId")),
daily_short AS (
  SELECT "accountId", date, arg_max(balance_after, id) AS balance
  FROM ledger_short GROUP BY "accountId", date),
grid_short AS (SELECT *, date - DATE '1970-01-01' AS dn FROM daily_short),
rolled_short AS (
  SELECT "accountId", date, dn,
         first_value(balance) OVER w AS start, last_value(balance) OVER w AS "end",
         min(balance) OVER w AS min, max(balance) OVER w AS max, avg(balance) OVER w AS avg,
         stddev_pop(balance) OVER w AS std,
         coalesce(lag(balance) OVER (PARTITION BY "accountId" ORDER BY dn),
                  first_value(balance) OVER (PARTITION BY "accountId" ORDER BY dn)) AS starting
  FROM grid_short
  WINDOW w AS (PARTITION BY "accountId" ORDER BY dn RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING))"""
)


def with_views(*views: str) -> str:
    return "WITH " + ",".join(v.strip("\n") for v in views)
