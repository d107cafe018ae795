"""Readers for transactions, accounts and recurring patterns, and their consolidation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import (
    ACC_KEEP,
    TXN_KEEP,
    account_alias,
    before_cutoff,
    canonical,
    dedupe_by,
    keep_columns,
    missing_to_null,
    namespace_ids,
    quality_filter,
)


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Quoted CSV with header, every column as text, missing-value texts as NULL.

    Ids stay text, so ``101`` never turns into ``101.0``. Files are split among tasks. With ``line_breaks`` values
    may hold line ends inside quotes; each file is then read by one task.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=line_breaks)
    return missing_to_null(raw)


def read_any(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Parquet by extension, otherwise CSV."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, line_breaks)


def _typed(df: DataFrame, strict_dates: bool) -> DataFrame:
    out = {}
    kinds = dict(df.dtypes)
    if kinds.get("date") == "string":
        out["date"] = F.to_timestamp("date") if strict_dates else F.try_to_timestamp("date")
    if kinds.get("amount") == "string":
        out["amount"] = F.col("amount").cast("double")
    if kinds.get("isForeignCurrency") == "string":
        out["isForeignCurrency"] = F.col("isForeignCurrency").cast("boolean")
    return df.withColumns(out) if out else df


def load_transactions(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Transactions with standard ``date`` and ``amount``; a date that does not parse is an error."""
    return _typed(canonical(read_any(spark, path, line_breaks), ["date", "amount"]), strict_dates=True)


def load_label_transactions(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Transactions for labelling: one row per id, and NULL for a date that does not parse."""
    raw = canonical(read_any(spark, path, line_breaks), ["categoryGroupId", "subCategoryId"])
    return dedupe_by(_typed(raw, strict_dates=False), ["id"], ["date"])


def load_accounts(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, line_breaks: bool = False
) -> DataFrame:
    """Accounts, all columns or a projection."""
    df = read_any(spark, path, line_breaks)
    casts = {c: F.col(c).cast("double") for c in ("balance", "availableBalance", "estimatedPendingAmount")
             if dict(df.dtypes).get(c) == "string"}
    df = df.withColumns(casts) if casts else df
    return df.select(*columns) if columns else df


def load_recurring_patterns(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    return read_any(spark, path, line_breaks).select("patternId", "patternTypeBusiness", "deviceId")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing in one frame is NULL there."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def join_banks(
    banks: Sequence[Mapping[str, object]], cutoff: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Union the banks' transactions and accounts with account ids prefixed by the bank.

    Each entry has ``name``, ``txns`` and optionally ``accounts`` (frames) and ``cutoff_date``,
    which overrides the common cutoff. Accounts without a recognisable id are skipped.
    """
    txns, accounts = [], []
    for bank in banks:
        name = str(bank["name"])
        rows = before_cutoff(bank["txns"], bank.get("cutoff_date", cutoff))
        txns.append(namespace_ids(rows, name, ["accountId"]))
        acc = bank.get("accounts")
        acc = account_alias(acc) if acc is not None else None
        if acc is not None:
            accounts.append(namespace_ids(acc, name, ["accountId"]))
    return union_all(txns), (union_all(accounts) if accounts else None)


def load_joint_bank_data(
    spark: SparkSession, configs: Sequence[Mapping[str, str]], cutoff: str | None = None, line_breaks: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """``join_banks`` over files: entries with ``name``, ``txn_file``, ``acc_file``, ``cutoff_date``."""
    banks = []
    for c in configs:
        entry: dict[str, object] = {"name": c["name"], "txns": load_transactions(spark, c["txn_file"], line_breaks)}
        if c.get("acc_file"):
            entry["accounts"] = load_accounts(spark, c["acc_file"], line_breaks=line_breaks)
        if "cutoff_date" in c:
            entry["cutoff_date"] = c["cutoff_date"]
        banks.append(entry)
    return join_banks(banks, cutoff)


def consolidate_transactions(banks: Mapping[str, DataFrame], keep: Sequence[str] = TXN_KEEP) -> DataFrame:
    """Kept columns of every bank, cleaned, with ``bank``, ``original_id`` and prefixed ids."""
    parts = []
    for bank, df in banks.items():
        kept = keep_columns(canonical(df, ["categoryGroupId", "subCategoryId"]), keep)
        clean = quality_filter(kept).withColumn("bank", F.lit(bank))
        parts.append(namespace_ids(clean, bank, ["id", "accountId"], keep_original="id"))
    return union_all(parts)


def consolidate_accounts(banks: Mapping[str, DataFrame], keep: Sequence[str] = ACC_KEEP) -> DataFrame:
    parts = []
    for bank, df in banks.items():
        kept = keep_columns(df, keep).withColumn("bank", F.lit(bank))
        parts.append(namespace_ids(kept, bank, ["id"], keep_original="id"))
    return union_all(parts)
