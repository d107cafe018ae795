"""Queries on readers, writers, consolidation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import amount_bin, finite_or_zero
from ..operators import clean as C
from ..plans import views as V
from ..session import scratch_path, stored
from ..sources import manifest as M
from ..sources import sinks as S
from ..sources import tables as T
from .labels import CATEGORIES_SQL, _emerging_sql
from .registry import query
from .sqlviews import ACCT, BANKED, PATTERNS, TXN_LONG, TXN_SHORT, with_views

BANKS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _stored_csv(spark, df, name):
    path = scratch_path(spark, name)
    S.write_csv(df, path)
    return path


def _raw_txns(spark, sf):
    """Transactions under the names and gaps a bank export has."""
    t = V.txn_long(spark, sf)
    n = F.col("id").cast("long")
    return t.select(
        "id", "accountId", "user_name",
        F.col("date").cast("string").alias("transactionDate"),
        F.col("amount").alias("transactionAmount"),
        "direction",
        F.when(n % 11 == 0, "NA").otherwise(F.col("categoryGroupId")).alias("bankCategoryGroupId"),
        F.col("subCategoryId").alias("bankSubCategoryId"),
        "deviceId",
        F.concat(F.lit('Pay "'), F.col("user_name"), F.lit('", ref\n'), F.col("id")).alias("description"),
        F.when(n % 7 == 0, "Pending").otherwise("Cleared").alias("status"),
        F.when(n % 13 == 0, "true").when(n % 17 == 0, "").otherwise("false").alias("isForeignCurrency"),
    )


RAW_SQL = """,
raw AS (
  SELECT id, "accountId", user_name, date, amount, direction,
         CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN NULL ELSE "categoryGroupId" END AS "categoryGroupId",
         "subCategoryId", "deviceId", 'Pay "' || user_name || '", ref' || chr(10) || id AS description,
         CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'Pending' ELSE 'Cleared' END AS status,
         CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN true WHEN CAST(id AS BIGINT) % 17 = 0 THEN NULL ELSE false END AS fx
  FROM txn_long)"""


@query(
    "load_transactions_csv",
    "id:s accountId:s date:s amount:f2 description:s",
    with_views(TXN_LONG) + RAW_SQL + """ SELECT id, "accountId", date || ' 00:00:00' AS date, amount, description FROM raw""",
)
def load_transactions_csv(spark, sf):
    return T.load_transactions(spark, _stored_csv(spark, _raw_txns(spark, sf), "txns"), line_breaks=True)


@query(
    "load_transactions_parquet",
    "id:s accountId:s date:s amount:f2",
    with_views(TXN_LONG) + """ SELECT id, "accountId", date || ' 00:00:00' AS date, amount FROM txn_long""",
)
def load_transactions_parquet(spark, sf):
    path = scratch_path(spark, "txns") + ".parquet"
    S.save_table(_raw_txns(spark, sf), path)
    return T.load_transactions(spark, path)


@query(
    "load_label_transactions",
    "id:s accountId:s date:s categoryGroupId:s",
    with_views(TXN_LONG)
    + RAW_SQL
    + """ SELECT id, "accountId", CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN date || ' 00:00:00' END AS date,
                 "categoryGroupId" FROM raw""",
)
def load_label_transactions(spark, sf):
    raw = _raw_txns(spark, sf).withColumnsRenamed({"transactionDate": "date", "transactionAmount": "amount"})
    odd = raw.withColumn("date", F.when(F.col("id").cast("long") % 5 == 0, "not a date").otherwise(F.col("date")))
    return T.load_label_transactions(spark, _stored_csv(spark, odd.unionAll(odd), "labels"), line_breaks=True)


@query(
    "load_accounts",
    "accountId:s type:s availableBalance:f2",
    with_views(ACCT) + ' SELECT "accountId", type, "availableBalance" FROM acct',
)
def load_accounts(spark, sf):
    return T.load_accounts(spark, _stored_csv(spark, V.acct(spark, sf), "accounts"))


@query(
    "load_accounts_pruned", "id:s type:s", with_views(ACCT) + ' SELECT "accountId" AS id, type FROM acct'
)
def load_accounts_pruned(spark, sf):
    acc = V.acct(spark, sf).withColumnRenamed("accountId", "id")
    return T.load_accounts(spark, _stored_csv(spark, acc, "accounts"), ["id", "type"])


@query(
    "load_recurring_patterns",
    "patternId:s patternTypeBusiness:s deviceId:s",
    with_views(PATTERNS) + " SELECT * FROM patterns",
)
def load_recurring_patterns(spark, sf):
    extra = V.patterns(spark, sf).withColumn("note", F.lit("x"))
    return T.load_recurring_patterns(spark, _stored_csv(spark, extra, "patterns"))


def _banks(spark, sf):
    t = V.txn_banked(spark, sf)
    return {b: t.filter(F.col("bank") == b).drop("bank") for b in BANKS}


@query(
    "join_banks_with_cutoffs",
    "id:s accountId:s date:s",
    with_views(TXN_LONG, BANKED)
    + """ SELECT id, bank || '_' || "accountId" AS "accountId", date FROM txn_banked
          WHERE date < CASE WHEN bank = 'ASIA' THEN DATE '1997-06-01' ELSE DATE '1999-01-01' END""",
)
def join_banks_with_cutoffs(spark, sf):
    banks = [{"name": b, "txns": df} for b, df in _banks(spark, sf).items()]
    banks[2]["cutoff_date"] = "1997-06-01"
    return T.join_banks(banks, "1999-01-01")[0]


@query(
    "join_bank_accounts",
    "accountId:s type:s",
    with_views(ACCT) + """ SELECT 'A_' || "accountId" AS "accountId", type FROM acct
      UNION ALL SELECT 'B_' || "accountId", type FROM acct""",
)
def join_bank_accounts(spark, sf):
    acc, t = V.acct(spark, sf), V.txn_long(spark, sf)
    banks = [
        {"name": "A", "txns": t, "accounts": acc.withColumnRenamed("accountId", "Account ID")},
        {"name": "B", "txns": t, "accounts": acc.withColumnRenamed("accountId", "id")},
        {"name": "C", "txns": t, "accounts": acc.withColumnRenamed("accountId", "holder")},
    ]
    return T.join_banks(banks)[1]


def _consolidated(spark, sf):
    t = V.txn_banked(spark, sf)
    n = F.col("id").cast("long")
    raw = t.withColumns(
        {
            "status": F.when(n % 7 == 0, "Pending").otherwise("Cleared"),
            "isForeignCurrency": F.when(n % 13 == 0, True).when(n % 17 == 0, None).otherwise(False),
            "amount": F.when(n % 19 == 0, 0.0).when(n % 23 == 0, None).otherwise(F.col("amount")),
        }
    )
    banks = {b: raw.filter(F.col("bank") == b).drop("bank") for b in BANKS}
    banks["EUROPE"] = banks["EUROPE"].drop("status")
    return T.consolidate_transactions(banks)


CONSOLIDATED_SQL = """,
cons AS (
  SELECT bank || '_' || id AS id, id AS original_id, bank || '_' || "accountId" AS "accountId", bank, date,
         CASE WHEN CAST(id AS BIGINT) % 19 = 0 THEN 0.0 WHEN CAST(id AS BIGINT) % 23 = 0 THEN NULL ELSE amount END AS amount,
         "subCategoryId", NULL AS description
  FROM txn_banked
  WHERE bank <> 'EUROPE' AND CAST(id AS BIGINT) % 7 <> 0 AND CAST(id AS BIGINT) % 13 <> 0
    AND CAST(id AS BIGINT) % 19 <> 0)"""


@query(
    "consolidate_transactions",
    "id:s original_id:s accountId:s bank:s date:s amount:f2 subCategoryId:s description:s",
    with_views(TXN_LONG, BANKED) + CONSOLIDATED_SQL + " SELECT * FROM cons",
)
def consolidate_transactions(spark, sf):
    path = scratch_path(spark, "consolidated")
    S.write_by_bank(_consolidated(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "consolidate_accounts",
    "id:s original_id:s type:s bank:s availableBalance:f2 currency:s",
    with_views(TXN_LONG, BANKED, ACCT)
    + """ SELECT bank || '_' || "accountId" AS id, "accountId" AS original_id, type, bank, "availableBalance",
                 NULL AS currency FROM acct JOIN bank_of USING ("accountId")""",
)
def consolidate_accounts(spark, sf):
    c, n, r = (V.table(spark, sf, t) for t in ("customer", "nation", "region"))
    bank_of = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("c_custkey").cast("string").alias("accountId"), F.col("r_name").alias("bank")
    )
    acc = V.acct(spark, sf).join(bank_of, "accountId").withColumnRenamed("accountId", "id")
    return T.consolidate_accounts({b: acc.filter(F.col("bank") == b).drop("bank") for b in BANKS})


@query(
    "emerging_flags_written",
    "user_name:s accountId:s flag_name:s emerging_date:s",
    with_views(TXN_LONG, ACCT, CATEGORIES_SQL, _emerging_sql("txn_long"))
    + ' SELECT user_name, "accountId", flag_name, emerging_date FROM emerging',
)
def emerging_flags_written(spark, sf):
    from .labels import detect_emerging

    path = scratch_path(spark, "flags")
    flags = detect_emerging(spark, sf)
    if not S.write_flags(flags, path):
        return flags
    return T.read_csv(spark, path)


@query(
    "flag_directories",
    "flag:s accountId:s n:i",
    with_views(TXN_LONG)
    + ' SELECT "subCategoryId" AS flag, "accountId", count(*) AS n FROM txn_long GROUP BY ALL',
)
def flag_directories(spark, sf):
    """All flag directories are one partitioned frame, grouped by flag instead of looped over."""
    root = scratch_path(spark, "by_flag")
    t = V.txn_long(spark, sf).withColumn("flag", F.col("subCategoryId"))
    t.write.mode("overwrite").partitionBy("flag").parquet(root)
    return S.read_flag_directories(spark, root).groupBy("flag", "accountId").agg(F.count(F.lit(1)).alias("n"))


@query(
    "resume_skips_existing",
    "accountId:s n:i",
    with_views(TXN_LONG) + ' SELECT "accountId", count(*) AS n FROM txn_long GROUP BY ALL',
)
def resume_skips_existing(spark, sf):
    """A second write to an existing output changes nothing."""
    path = scratch_path(spark, "stage")
    counts = V.txn_long(spark, sf).groupBy("accountId").agg(F.count(F.lit(1)).alias("n"))
    S.write_if_absent(counts, path)
    S.write_if_absent(counts.withColumn("n", F.lit(-1).cast("long")), path)
    return spark.read.parquet(path)


@query(
    "resume_rebuilds_half_written",
    "step:i wrote:i accountId:s n:i",
    with_views(TXN_LONG)
    + """, counts AS (SELECT "accountId", count(*) AS n FROM txn_long GROUP BY ALL),
      later AS (SELECT "accountId", count(*) AS n FROM txn_long WHERE CAST(id AS BIGINT) % 3 <> 0 GROUP BY ALL)
      SELECT step, wrote, c.* FROM counts c, (VALUES (0, 1), (1, 0), (2, 1)) v(step, wrote)
      UNION ALL SELECT 3, 1, l.* FROM later l""",
)
def resume_rebuilds_half_written(spark, sf):
    """A stage four times: built, found finished, rebuilt after its entry is lost and half of its rows, and rebuilt because
    its input has changed."""
    path, txns = scratch_path(spark, "stage"), V.txn_long(spark, sf).select("accountId", "id")
    counts = lambda df: df.groupBy("accountId").agg(F.count(F.lit(1)).alias("n"))
    states = []
    for step, source in enumerate((txns, txns, txns, txns.filter(F.col("id").cast("long") % 3 != 0))):
        if step == 2:
            M.remove(spark, M.Manifest(spark, path).root)
            half = stored(spark.read.parquet(path).filter(F.crc32("accountId") % 2 == 0), "half")
            half.write.mode("overwrite").parquet(path)
        wrote = M.run_stage([source], path, lambda source=source: counts(source))
        states.append(stored(spark.read.parquet(path), "state").withColumns({"step": F.lit(step), "wrote": F.lit(int(wrote))}))
    return states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3])


@query(
    "flags_for_evaluation",
    "global_id:s flag_name:s emerging_date:s",
    with_views(TXN_LONG, BANKED, ACCT, CATEGORIES_SQL, _emerging_sql("txn_banked", "bank"))
    + """ SELECT bank || '_' || "accountId" AS global_id, flag_name, emerging_date FROM emerging""",
)
def flags_for_evaluation(spark, sf):
    from .labels import emerging_flags_by_bank

    return S.load_flags_for_evaluation(emerging_flags_by_bank(spark, sf))


@query(
    "alias_resolution",
    "id:s grp:s cp:s missing:s",
    with_views(TXN_LONG) + """ SELECT id, "categoryGroupId" AS grp, "deviceId" AS cp, 'UNK' AS missing FROM txn_long""",
)
def alias_resolution(spark, sf):
    t = V.txn_long(spark, sf).withColumnRenamed("categoryGroupId", "bankCategoryGroupId")
    return t.select(
        "id",
        C.resolve(t, C.ALIASES["categoryGroupId"]).alias("grp"),
        C.resolve(t, C.ALIASES["counterParty"]).alias("cp"),
        C.resolve(t, ("no_such_column",)).alias("missing"),
    )


@query(
    "account_alias_rename",
    "accountId:s type:s",
    with_views(ACCT) + ' SELECT "accountId", type FROM acct',
)
def account_alias_rename(spark, sf):
    return C.account_alias(V.acct(spark, sf).withColumnRenamed("accountId", "accountID"))


@query(
    "schema_patch",
    "id:s direction:s",
    with_views(TXN_LONG) + " SELECT id, CASE WHEN amount > 0 THEN 'Credit' ELSE 'Debit' END AS direction FROM txn_long",
)
def schema_patch(spark, sf):
    return C.patch_schema(V.txn_long(spark, sf).withColumnRenamed("id", "trId").drop("direction"))


@query(
    "keep_list_projection",
    "id:s type:s status:s availableBalance:f2",
    with_views(ACCT) + ' SELECT "accountId" AS id, type, NULL AS status, "availableBalance" FROM acct',
)
def keep_list_projection(spark, sf):
    return C.keep_columns(V.acct(spark, sf).withColumnRenamed("accountId", "id"), C.ACC_KEEP)


@query(
    "namespaced_ids",
    "id:s accountId:s original_id:s",
    with_views(TXN_LONG, BANKED)
    + """ SELECT bank || '_' || id AS id, bank || '_' || "accountId" AS "accountId", id AS original_id FROM txn_banked""",
)
def namespaced_ids(spark, sf):
    return C.namespace_ids(V.txn_banked(spark, sf), F.col("bank"), ["id", "accountId"], keep_original="id")


@query(
    "normalized_account_keys",
    "id:s accountId:s",
    with_views(TXN_LONG) + """ SELECT id, upper(user_name || 'x') AS "accountId" FROM txn_long""",
)
def normalized_account_keys(spark, sf):
    from ..operators.balance import account_key

    return V.txn_long(spark, sf).select("id", account_key(F.concat("user_name", F.lit("x"))).alias("accountId"))


@query(
    "parsed_dates",
    "id:s day:s tried:s",
    with_views(TXN_SHORT)
    + " SELECT id, date AS day, CASE WHEN CAST(id AS BIGINT) % 3 <> 0 THEN date END AS tried FROM txn_short",
)
def parsed_dates(spark, sf):
    t = V.txn_short(spark, sf)
    text = F.when(F.col("id").cast("long") % 3 == 0, "garbage").otherwise(F.col("date").cast("string"))
    return t.select("id", F.to_date("ts").alias("day"), F.to_date(F.try_to_timestamp(text)).alias("tried"))


@query(
    "finite_values",
    "l_orderkey:i l_linenumber:i x:f6 n:i",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_linenumber IN (1, 2, 3) THEN 0 ELSE l_extendedprice END AS x, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def finite_values(spark, sf):
    li = V.table(spark, sf, "lineitem")
    x = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
        .when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    )
    return li.groupBy("l_orderkey", "l_linenumber", finite_or_zero(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "quality_filter",
    "id:s amount:f2",
    with_views(TXN_LONG)
    + """ SELECT id, CASE WHEN CAST(id AS BIGINT) % 23 = 0 THEN NULL ELSE amount END AS amount FROM txn_long
          WHERE CAST(id AS BIGINT) % 7 <> 0 AND CAST(id AS BIGINT) % 13 <> 0 AND CAST(id AS BIGINT) % 19 <> 0""",
)
def quality_filter(spark, sf):
    n = F.col("id").cast("long")
    raw = V.txn_long(spark, sf).withColumns(
        {
            "status": F.when(n % 7 == 0, "Pending").otherwise("Cleared"),
            "isForeignCurrency": F.when(n % 13 == 0, True).when(n % 17 == 0, None).otherwise(False),
            "amount": F.when(n % 19 == 0, 0.0).when(n % 23 == 0, None).otherwise(F.col("amount")),
        }
    )
    return C.quality_filter(raw)


@query(
    "before_cutoff",
    "id:s date:s",
    with_views(TXN_LONG) + " SELECT id, date FROM txn_long WHERE date < DATE '1998-10-03'",
)
def before_cutoff(spark, sf):
    return C.before_cutoff(V.txn_long(spark, sf), "1998-10-03")


@query(
    "restricted_accounts",
    "id:s accountId:s",
    with_views(TXN_LONG, ACCT)
    + """ SELECT id, "accountId" FROM txn_long WHERE "accountId" IN (SELECT "accountId" FROM acct WHERE type = 'Checking')""",
)
def restricted_accounts(spark, sf):
    ids = V.acct(spark, sf).filter("type = 'Checking'")
    return C.restrict_accounts(V.txn_long(spark, sf), ids)


@query(
    "min_active_days",
    "id:s accountId:s",
    with_views(TXN_LONG)
    + """ SELECT id, "accountId" FROM txn_long WHERE "accountId" IN (
            SELECT "accountId" FROM txn_long GROUP BY "accountId" HAVING count(DISTINCT date) >= 9)""",
)
def min_active_days(spark, sf):
    return C.min_active_days(V.txn_long(spark, sf), 9)


@query(
    "censored_subcategory",
    "id:s subCategoryId:s",
    with_views(TXN_LONG)
    + """, raw AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN NULL ELSE lower("subCategoryId") END AS "subCategoryId" FROM txn_long)
          SELECT * FROM raw WHERE "subCategoryId" IS NULL OR "subCategoryId" <> 'c2202' """,
)
def censored_subcategory(spark, sf):
    code = F.when(F.col("id").cast("long") % 11 != 0, F.lower("subCategoryId"))
    return C.censor_subcategory(V.txn_long(spark, sf).withColumn("subCategoryId", code), "CG2202")


@query(
    "deduplicated_rows",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                  ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1""",
)
def deduplicated_rows(spark, sf):
    return C.dedupe_by(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query(
    "deduplicated_copies",
    "text_key:s doc_id:i",
    "SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)",
)
def deduplicated_copies(spark, sf):
    """Whole texts compared; a group of copies sends one row per task."""
    d = V.table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id")
    return C.dedupe_by(d, ["text_key"], ["doc_id"])


@query(
    "dataset_profile",
    "n_rows:i min_date:s max_date:s n_users:i n_accounts:i",
    with_views(TXN_LONG)
    + """ SELECT count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date,
                 count(DISTINCT user_name) AS n_users, count(DISTINCT "accountId") AS n_accounts FROM txn_long""",
)
def dataset_profile(spark, sf):
    return C.profile(V.txn_long(spark, sf), distinct={"n_users": "user_name", "n_accounts": "accountId"})


@query(
    "account_type_counts",
    "type:s n:i",
    with_views(ACCT) + " SELECT type, count(*) AS n FROM acct GROUP BY type",
)
def account_type_counts(spark, sf):
    return C.value_counts(V.acct(spark, sf), "type")


@query(
    "pattern_type_counts",
    "patternTypeBusiness:s n:i",
    with_views(PATTERNS) + ' SELECT "patternTypeBusiness", count(*) AS n FROM patterns GROUP BY ALL',
)
def pattern_type_counts(spark, sf):
    return C.value_counts(V.patterns(spark, sf), "patternTypeBusiness")


@query(
    "active_days",
    "accountId:s day:s",
    with_views(TXN_SHORT) + ' SELECT DISTINCT "accountId", date AS day FROM txn_short',
)
def active_days(spark, sf):
    return C.active_days(V.txn_short(spark, sf))


@query(
    "sorted_ledger",
    "accountId:s id:s place:i",
    with_views(TXN_LONG)
    + """ SELECT "accountId", id, row_number() OVER (PARTITION BY "accountId" ORDER BY date, id) AS place FROM txn_long""",
)
def sorted_ledger(spark, sf):
    from ..operators.ordered import rank_rows

    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    return rank_rows(V.txn_long(spark, sf).withColumn("_day", day), ["accountId"], ["_day", "id"], "place")


@query(
    "bank_union",
    "bank:s n:i amount:f2",
    with_views(TXN_LONG, BANKED) + " SELECT bank, count(*) AS n, sum(amount) AS amount FROM txn_banked GROUP BY bank",
)
def bank_union(spark, sf):
    parts = [df.withColumn("bank", F.lit(b)) for b, df in _banks(spark, sf).items()]
    parts[1] = parts[1].drop("deviceId")
    return T.union_all(parts).groupBy("bank").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(
    "amount_bins",
    "bin:i n:i",
    """SELECT CAST(trunc(greatest(0, least(15, ln(1 + l_extendedprice))) / CAST(15 AS DOUBLE) * 63) AS BIGINT) AS bin,
              count(*) AS n FROM lineitem GROUP BY ALL""",
)
def amount_bins(spark, sf):
    x = F.log1p("l_extendedprice")
    return V.table(spark, sf, "lineitem").groupBy(amount_bin(x).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "code_prefixes",
    "code:s bare:s n:i",
    with_views(TXN_LONG)
    + """ SELECT lower("categoryGroupId") AS code,
             regexp_replace(regexp_replace(upper("categoryGroupId"), '^C+', ''), '^G+', '') AS bare, count(*) AS n
          FROM txn_long GROUP BY ALL""",
)
def code_prefixes(spark, sf):
    from ..functions.scalars import strip_code_prefix

    code = F.lower("categoryGroupId")
    return V.txn_long(spark, sf).groupBy(code.alias("code"), strip_code_prefix(code).alias("bare")).agg(
        F.count(F.lit(1)).alias("n")
    )
