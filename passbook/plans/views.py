"""Ledger-shaped views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which category an order priority stands for.
CATEGORY_OF_PRIORITY = {"1": "C1202", "2": "C1203", "3": "C2202", "4": "C2501", "5": "C2211"}
SNAPSHOT_DATE = "1999-01-01"
EVENT_SNAPSHOT_DATE = "2024-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signed account transactions over six years."""
    o = table(spark, sf_dir, "orders")
    credit = F.col("o_orderstatus") == "O"
    lead = F.substring("o_orderpriority", 1, 1)
    sub = F.lit(None).cast("string")
    for digit, code in CATEGORY_OF_PRIORITY.items():
        sub = F.when(lead == digit, code).otherwise(sub)
    cust = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        cust.alias("accountId"),
        F.concat(F.lit("U"), cust).alias("user_name"),
        F.to_date("o_orderdate").alias("date"),
        F.when(credit, "C").otherwise("D").alias("direction"),
        F.when(credit, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"),
        sub.alias("subCategoryId"),
        F.concat(F.lit("CG"), F.substring(sub, 2, 2), F.lit("00")).alias("categoryGroupId"),
        F.concat_ws(":", cust, "o_orderpriority").alias("patternId"),
        F.concat(F.lit("DEV"), (F.col("o_orderkey") % 97).cast("string")).alias("deviceId"),
    )


def txn_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_long(spark, sf_dir).withColumn("amount", F.abs("amount"))


def txn_banked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn_long`` with the customer's region as the bank."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region")
    bank = (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").cast("string").alias("accountId"), F.col("r_name").alias("bank"))
    )
    return txn_long(spark, sf_dir).join(bank, "accountId")


def txn_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dense transactions over thirty days."""
    e = table(spark, sf_dir, "events")
    spend = F.col("event_type").isin("purchase", "error")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("accountId"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_name"),
        F.to_date("ts").alias("date"),
        "ts",
        F.when(spend, "D").otherwise("C").alias("direction"),
        F.when(spend, -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.col("event_type").alias("subCategoryId"),
        F.when(spend, "spend").otherwise("income").alias("categoryGroupId"),
        F.get_json_object("props", "$.k").alias("counter_party"),
    )


def acct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts with a snapshot and, for one in five, a pending amount."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    pending = F.when(key % 5 == 0, (key % 7 - 3).cast("double") * 10).otherwise(F.lit(0.0))
    return c.select(
        key.cast("string").alias("accountId"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Checking").otherwise(F.col("c_mktsegment")).alias("type"),
        F.col("c_acctbal").alias("availableBalance"),
        F.lit(SNAPSHOT_DATE).cast("date").alias("balanceDateTime"),
        pending.alias("estimatedPendingAmount"),
    )


def acct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per event user with a made snapshot."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias("accountId"),
        (F.col("user_id") * 10 + 100).cast("double").alias("availableBalance"),
        F.lit(EVENT_SNAPSHOT_DATE).cast("date").alias("balanceDateTime"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring patterns: one per customer and order priority."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    turn = F.col("o_custkey") % 3
    return o.select(
        F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority").alias("patternId"),
        F.when(turn == 0, "DateOfMonth").when(turn == 1, "NoisyDateOfMonth").otherwise("MonthlyPayments").alias(
            "patternTypeBusiness"
        ),
        F.concat(F.lit("DEV"), F.col("o_custkey").cast("string")).alias("deviceId"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a fixed score, and the quality flag as label."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(docs, "doc_id").select(
        F.col("lang").alias("grp"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("quality").cast("int").alias("label"),
        (F.pmod(F.col("doc_id") * 7919 + F.col("n_chars"), F.lit(101)) / F.lit(101.0)).alias("score"),
    )


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with an account type in place of the label number."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
