"""Queries on behavioural labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import calendar_months, flag_name, iso_date
from ..operators import clean as C
from ..operators import labels as L
from ..plans import views as V
from ..plans.labels import generate_labels
from ..sources import categories as cat
from .registry import query
from .sqlviews import ACCT, BANKED, PATTERNS, TXN_LONG, with_views

GROUPS = tuple(cat.DEFAULT_GROUPS)
CATEGORIES_SQL = "categories(subcategory_id, name, group_id, group_name) AS (VALUES " + ", ".join(
    f"('{code}', '{name}', 'CG{code[1:3]}00', '{cat.DEFAULT_GROUPS[f'CG{code[1:3]}00']}')"
    for code, name in cat.DEFAULT_NAMES.items()
) + ")"

MONTHS = """
  ({m} + date_diff('day', CAST({a} + to_months({m}) AS DATE), {b}) / CAST(30.44 AS DOUBLE))"""


def months_sql(a: str, b: str) -> str:
    span = f"CAST((year({b}) - year({a})) * 12 + month({b}) - month({a}) AS INTEGER)"
    whole = f"CAST({span} - CASE WHEN CAST({a} + to_months({span}) AS DATE) > {b} THEN 1 ELSE 0 END AS INTEGER)"
    return MONTHS.format(m=whole, a=a, b=b)


FLAG_SQL = "'EMERGING_' || upper(regexp_replace(trim(regexp_replace(name, '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+', '_', 'g'))"

FILTERED = """
filtered AS (
  SELECT t.* FROM {txns} t JOIN acct a USING ("accountId")
  WHERE a.type = 'Checking' AND t.direction = 'D')"""


def _emerging_sql(txns: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return FILTERED.format(txns=txns) + f""",
starts AS (SELECT {b}"accountId", min(date) AS start FROM filtered GROUP BY {b}"accountId"),
firsts AS (
  SELECT {b}"accountId", "subCategoryId", date, user_name FROM filtered
  QUALIFY row_number() OVER (PARTITION BY {b}"accountId", "subCategoryId" ORDER BY date, id) = 1),
emerging AS (
  SELECT {('f.' + by + ', ') if by else ''}f.user_name, f."accountId", {FLAG_SQL} AS flag_name, c.group_id AS "categoryGroupId",
         c.group_name AS category_group_name, c.subcategory_id AS "subcategoryId", c.name AS sub_category_name,
         f.date AS emerging_date, s.start AS account_start_date, {months_sql('s.start', 'f.date')} AS months_since_start
  FROM firsts f JOIN starts s ON f."accountId" = s."accountId" {f'AND f.{by} = s.{by}' if by else ''}
  JOIN categories c ON c.subcategory_id = f."subCategoryId"
  WHERE {months_sql('s.start', 'f.date')} >= 3)"""


def _skipped_sql(source: str, by: str = "", min_txn: int = 4) -> str:
    b = f"{by}, " if by else ""
    return f"""
pays AS (
  SELECT {b}user_name, t."patternId", p."patternTypeBusiness", date, id, t."accountId", t."deviceId",
         lag(date) OVER w AS prev, count(*) OVER g AS n,
         first_value(t."accountId") OVER w AS acc0, first_value(t."deviceId") OVER w AS dev0
  FROM {source} t JOIN patterns p ON t."patternId" = p."patternId"
  WINDOW w AS (PARTITION BY {b}user_name, t."patternId" ORDER BY date, id),
         g AS (PARTITION BY {b}user_name, t."patternId")),
gaps AS (
  SELECT *, date_diff('day', prev, date) AS gap,
         min(date_diff('day', prev, date)) OVER (PARTITION BY {b}user_name, "patternId") AS min_gap FROM pays),
skipped AS (
  SELECT {b}user_name, acc0 AS "accountId", 'SKIPPED_PAYMENT' AS flag_name, "patternId", "patternTypeBusiness",
         dev0 AS "deviceId", prev AS payment_before_gap, date AS payment_after_gap, gap AS gap_days
  FROM gaps
  WHERE n >= {min_txn} AND gap >= CASE WHEN "patternTypeBusiness" = 'MonthlyPayments' THEN 50 ELSE 45 END
    AND NOT (n = 3 AND min_gap > 50))"""


EMERGING_SHAPE = (
    "user_name:s accountId:s flag_name:s categoryGroupId:s category_group_name:s subcategoryId:s "
    "sub_category_name:s emerging_date:s account_start_date:s months_since_start:f6"
)
SKIPPED_SHAPE = (
    "user_name:s accountId:s flag_name:s patternId:s patternTypeBusiness:s deviceId:s "
    "payment_before_gap:s payment_after_gap:s gap_days:i"
)


def _filtered(spark, sf):
    return C.filter_accounts(V.txn_long(spark, sf), V.acct(spark, sf))


@query(
    "detect_emerging",
    EMERGING_SHAPE,
    with_views(TXN_LONG, ACCT, CATEGORIES_SQL, _emerging_sql("txn_long")) + " SELECT * FROM emerging",
)
def detect_emerging(spark, sf):
    return L.detect_emerging(_filtered(spark, sf), cat.default_categories(spark), GROUPS, 3)


@query(
    "detect_emerging_unfiltered_start",
    EMERGING_SHAPE,
    with_views(TXN_LONG, ACCT, CATEGORIES_SQL, _emerging_sql("txn_long")).replace(
        "FROM filtered GROUP BY", "FROM txn_long GROUP BY"
    )
    + " SELECT * FROM emerging",
)
def detect_emerging_unfiltered_start(spark, sf):
    starts = L.account_starts(V.txn_long(spark, sf))
    return L.detect_emerging(_filtered(spark, sf), cat.default_categories(spark), GROUPS, 3, starts=starts)


@query(
    "account_start_dates",
    "accountId:s account_start_date:s",
    with_views(TXN_LONG, ACCT, FILTERED.format(txns="txn_long"))
    + ' SELECT "accountId", min(date) AS account_start_date FROM filtered GROUP BY "accountId"',
)
def account_start_dates(spark, sf):
    return L.account_starts(_filtered(spark, sf))


@query(
    "first_category_use",
    "accountId:s subcategoryId:s emerging_date:s user_name:s",
    with_views(TXN_LONG)
    + """ SELECT "accountId", "subCategoryId" AS "subcategoryId", date AS emerging_date, user_name FROM txn_long
          QUALIFY row_number() OVER (PARTITION BY "accountId", "subCategoryId" ORDER BY date, id) = 1""",
)
def first_category_use(spark, sf):
    return L.first_uses(V.txn_long(spark, sf))


@query(
    "first_use_with_start",
    "accountId:s subcategoryId:s emerging_date:s account_start_date:s",
    with_views(TXN_LONG)
    + """, f AS (SELECT "accountId", "subCategoryId" AS "subcategoryId", min(date) AS emerging_date
                 FROM txn_long GROUP BY ALL)
          SELECT *, min(emerging_date) OVER (PARTITION BY "accountId") AS account_start_date FROM f""",
)
def first_use_with_start(spark, sf):
    t = V.txn_long(spark, sf)
    return L.first_uses(t).join(L.account_starts(t), "accountId", "left")


@query(
    "calendar_months",
    "id:s months:f6 event_day:s",
    with_views(TXN_LONG)
    + f""", s AS (SELECT "accountId", min(date) AS start FROM txn_long GROUP BY "accountId")
       SELECT id, {months_sql('s.start', 't.date')} AS months, strftime(t.date, '%Y-%m-%d') AS event_day
       FROM txn_long t JOIN s USING ("accountId")""",
)
def months_since_start(spark, sf):
    t = V.txn_long(spark, sf)
    return t.join(L.account_starts(t), "accountId").select(
        "id",
        calendar_months(F.col("account_start_date"), F.col("date")).alias("months"),
        iso_date(F.col("date")).alias("event_day"),
    )


@query(
    "detect_skipped_payment",
    SKIPPED_SHAPE,
    with_views(TXN_LONG, PATTERNS, _skipped_sql("txn_long")) + " SELECT * FROM skipped",
)
def detect_skipped_payment(spark, sf):
    return L.detect_skipped_payment(
        V.txn_long(spark, sf), V.patterns(spark, sf), cat.DEFAULT_PATTERN_TYPES,
        monthly_payments=cat.DEFAULT_MONTHLY,
    )


@query(
    "skipped_payment_bimonthly_rule",
    SKIPPED_SHAPE,
    with_views(TXN_LONG, PATTERNS, _skipped_sql("txn_long", min_txn=3)) + " SELECT * FROM skipped",
)
def skipped_payment_bimonthly_rule(spark, sf):
    return L.detect_skipped_payment(
        V.txn_long(spark, sf), V.patterns(spark, sf), cat.DEFAULT_PATTERN_TYPES, min_transactions=3,
        monthly_payments=cat.DEFAULT_MONTHLY,
    )


@query(
    "payment_gaps",
    "user_name:s patternId:s day:s gap_days:i n_payments:i",
    with_views(TXN_LONG)
    + """, d AS (SELECT user_name, "patternId", date AS day, count(*) AS k FROM txn_long GROUP BY ALL)
      SELECT user_name, "patternId", day,
             date_diff('day', lag(day) OVER (PARTITION BY user_name, "patternId" ORDER BY day), day) AS gap_days,
             sum(k) OVER (PARTITION BY user_name, "patternId") AS n_payments
      FROM d""",
)
def payment_gaps(spark, sf):
    return L.payment_gaps(L.payment_days(V.txn_long(spark, sf)))


@query(
    "pattern_first_attributes",
    "user_name:s patternId:s accountId:s deviceId:s",
    with_views(TXN_LONG)
    + """ SELECT user_name, "patternId", "accountId", "deviceId" FROM txn_long
          QUALIFY row_number() OVER (PARTITION BY user_name, "patternId" ORDER BY date, id) = 1""",
)
def pattern_first_attributes(spark, sf):
    days = L.payment_days(V.txn_long(spark, sf))
    first = days.groupBy("user_name", "patternId").agg(F.min_by("_first", "day").alias("f"))
    return first.select("user_name", "patternId", "f.accountId", "f.deviceId")


@query(
    "patterns_joined",
    "id:s patternId:s patternTypeBusiness:s",
    with_views(TXN_LONG, PATTERNS)
    + ' SELECT id, t."patternId", "patternTypeBusiness" FROM txn_long t LEFT JOIN patterns p ON t."patternId" = p."patternId"',
)
def patterns_joined(spark, sf):
    return V.txn_long(spark, sf).join(V.patterns(spark, sf).drop("deviceId"), "patternId", "left")


def _banked(spark, sf):
    return generate_labels(
        V.txn_banked(spark, sf),
        V.acct(spark, sf),
        V.patterns(spark, sf).join(
            V.txn_banked(spark, sf).select("patternId", "bank").distinct(), "patternId"
        ),
        cat.default_categories(spark),
    )


_BANKED_SQL = with_views(
    TXN_LONG, BANKED, ACCT, PATTERNS, CATEGORIES_SQL, _emerging_sql("txn_banked", "bank"),
    _skipped_sql("filtered", "bank"),
)


@query("emerging_flags_by_bank", "bank:s " + EMERGING_SHAPE, _BANKED_SQL + " SELECT * FROM emerging")
def emerging_flags_by_bank(spark, sf):
    return _banked(spark, sf)["emerging"]


@query("skipped_flags_by_bank", "bank:s " + SKIPPED_SHAPE, _BANKED_SQL + " SELECT * FROM skipped")
def skipped_flags_by_bank(spark, sf):
    return _banked(spark, sf)["skipped"]


@query(
    "label_summary_by_bank",
    "bank:s users:i emerging_flags:i skipped_flags:i total_flags:i",
    _BANKED_SQL
    + """, per_bank AS (
        SELECT bank, count(DISTINCT user_name) AS users,
               (SELECT count(*) FROM emerging e WHERE e.bank = t.bank) AS emerging_flags,
               (SELECT count(*) FROM skipped s WHERE s.bank = t.bank) AS skipped_flags
        FROM txn_banked t GROUP BY bank),
      both_levels AS (
        SELECT * FROM per_bank
        UNION ALL SELECT 'TOTAL', sum(users), sum(emerging_flags), sum(skipped_flags) FROM per_bank)
      SELECT *, emerging_flags + skipped_flags AS total_flags FROM both_levels""",
)
def label_summary_by_bank(spark, sf):
    return _banked(spark, sf)["summary"]


def _shared(spark, sf):
    """The label run of banks that use the same account, user and pattern ids; patterns carry no bank."""
    local = (F.col("accountId").cast("long") % 50).cast("string")
    pattern = lambda number: F.concat(number, F.lit(":"), F.split("patternId", ":")[1])
    txns = V.txn_banked(spark, sf)
    bank_of = txns.select("accountId", "bank").distinct()
    accounts = V.acct(spark, sf).join(bank_of, "accountId").withColumn("accountId", local)
    first = (F.split("patternId", ":")[0].cast("long") % 50).cast("string")
    patterns = V.patterns(spark, sf).withColumn("patternId", pattern(first))
    txns = txns.withColumns({"user_name": F.concat(F.lit("U"), local), "patternId": pattern(local), "accountId": local})
    return generate_labels(txns, accounts, patterns, cat.default_categories(spark))


_LOCAL = 'CAST("accountId" AS BIGINT) % 50'
_SHARED_SQL = with_views(
    TXN_LONG, BANKED, ACCT, PATTERNS, CATEGORIES_SQL,
    f"""
txn_shared AS (
  SELECT * REPLACE (CAST({_LOCAL} AS VARCHAR) AS "accountId", 'U' || ({_LOCAL}) AS user_name,
                    ({_LOCAL}) || ':' || split_part("patternId", ':', 2) AS "patternId") FROM txn_banked),
acct_shared AS (
  SELECT bank, CAST({_LOCAL} AS VARCHAR) AS "accountId", min(type) AS type
  FROM acct JOIN (SELECT DISTINCT "accountId", bank FROM txn_banked) USING ("accountId") GROUP BY ALL),
patterns_shared AS (
  SELECT (CAST(split_part("patternId", ':', 1) AS BIGINT) % 50) || ':' || split_part("patternId", ':', 2) AS "patternId",
         min("patternTypeBusiness") AS "patternTypeBusiness" FROM patterns GROUP BY 1)""",
    _emerging_sql("txn_shared", "bank").replace('JOIN acct a USING ("accountId")', 'JOIN acct_shared a USING (bank, "accountId")'),
    _skipped_sql("filtered", "bank").replace("JOIN patterns p", "JOIN patterns_shared p"),
)


@query("emerging_flags_shared_ids", "bank:s " + EMERGING_SHAPE, _SHARED_SQL + " SELECT * FROM emerging")
def emerging_flags_shared_ids(spark, sf):
    return _shared(spark, sf)["emerging"]


@query("skipped_flags_shared_ids", "bank:s " + SKIPPED_SHAPE, _SHARED_SQL + " SELECT * FROM skipped")
def skipped_flags_shared_ids(spark, sf):
    return _shared(spark, sf)["skipped"]


@query(
    "label_summary_shared_ids",
    "bank:s users:i emerging_flags:i skipped_flags:i total_flags:i",
    _SHARED_SQL
    + """, per_bank AS (
        SELECT bank, count(DISTINCT user_name) AS users,
               (SELECT count(*) FROM emerging e WHERE e.bank = t.bank) AS emerging_flags,
               (SELECT count(*) FROM skipped s WHERE s.bank = t.bank) AS skipped_flags
        FROM txn_shared t GROUP BY bank),
      both_levels AS (
        SELECT * FROM per_bank
        UNION ALL SELECT 'TOTAL', sum(users), sum(emerging_flags), sum(skipped_flags) FROM per_bank)
      SELECT *, emerging_flags + skipped_flags AS total_flags FROM both_levels""",
)
def label_summary_shared_ids(spark, sf):
    return _shared(spark, sf)["summary"]


@query(
    "flag_names",
    "name:s flag:s n:i",
    f"SELECT p_name || ' & ' || p_type AS name, {FLAG_SQL.replace('name', chr(34) + 'label' + chr(34))} AS flag, count(*) AS n "
    "FROM (SELECT *, p_name || ' & ' || p_type AS label FROM part) GROUP BY ALL",
)
def flag_names(spark, sf):
    label = F.concat("p_name", F.lit(" & "), "p_type")
    return V.table(spark, sf, "part").groupBy(
        label.alias("name"), flag_name(label, "EMERGING").alias("flag")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_accounts",
    "id:s accountId:s type:s",
    with_views(TXN_LONG, ACCT, FILTERED.format(txns="txn_long"))
    + " SELECT id, \"accountId\", 'Checking' AS type FROM filtered",
)
def filter_accounts(spark, sf):
    return _filtered(spark, sf)


@query(
    "account_types_joined",
    "id:s type:s",
    with_views(TXN_LONG, ACCT) + ' SELECT id, type FROM txn_long LEFT JOIN acct USING ("accountId")',
)
def account_types_joined(spark, sf):
    return C.filter_accounts(V.txn_long(spark, sf), V.acct(spark, sf), account_type=None, direction=None)


@query(
    "filter_kept_ratio",
    "n_before:i n_after:i kept_pct:f6",
    with_views(TXN_LONG, ACCT, FILTERED.format(txns="txn_long"))
    + """ SELECT (SELECT count(*) FROM txn_long) AS n_before, (SELECT count(*) FROM filtered) AS n_after,
                 (SELECT count(*) FROM filtered) * 100.0 / (SELECT count(*) FROM txn_long) AS kept_pct""",
)
def filter_kept_ratio(spark, sf):
    return C.kept_ratio(V.txn_long(spark, sf), _filtered(spark, sf))


@query(
    "target_group_rows",
    "id:s subCategoryId:s",
    with_views(TXN_LONG, CATEGORIES_SQL)
    + """ SELECT id, "subCategoryId" FROM txn_long
          WHERE "subCategoryId" IN (SELECT subcategory_id FROM categories WHERE group_id IN ('CG1200', 'CG2500'))""",
)
def target_group_rows(spark, sf):
    return C.in_target_groups(V.txn_long(spark, sf), cat.default_categories(spark), ["CG1200", "CG2500"])


@query(
    "category_names",
    "id:s sub_category_name:s",
    with_views(TXN_LONG, CATEGORIES_SQL)
    + ' SELECT id, name AS sub_category_name FROM txn_long LEFT JOIN categories ON subcategory_id = "subCategoryId"',
)
def category_names(spark, sf):
    return C.add_category_names(V.txn_long(spark, sf), cat.default_categories(spark))


@query(
    "category_group_volume",
    "group_name:s n:i amount:f2",
    with_views(TXN_LONG, CATEGORIES_SQL)
    + ' SELECT group_name, count(*) AS n, sum(amount) AS amount FROM txn_long JOIN categories ON subcategory_id = "subCategoryId" GROUP BY group_name',
)
def category_group_volume(spark, sf):
    dim = F.broadcast(cat.default_categories(spark))
    t = V.txn_long(spark, sf)
    return t.join(dim, t["subCategoryId"] == dim["subcategory_id"]).groupBy("group_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )
