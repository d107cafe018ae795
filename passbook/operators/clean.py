"""Projection, schema patching, filters and dimension lookups that prepare ledger tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_code_prefix
from .keys import first_in_group

# Names under which a column may come, best first. ``*`` stands for any prefix.
ALIASES: dict[str, tuple[str, ...]] = {
    "categoryGroupId": ("*CategoryGroupId", "p_categoryGroupId", "categoryGroupId"),
    "subCategoryId": ("*SubCategoryId", "p_subCategoryId", "subCategoryId"),
    "counterParty": ("deviceId", "counter_party", "counterParty"),
    "accountId": ("accountId", "account_id", "accountID", "Account ID", "id"),
    "date": ("date", "transactionDate"),
    "amount": ("amount", "transactionAmount"),
    "id": ("id", "trId"),
}
# Text that counts as missing when a file is read.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Columns kept when sources are consolidated.
TXN_KEEP = (
    "id", "accountId", "date", "amount", "description", "categoryGroupId", "subCategoryId", "deviceId",
    "direction", "status", "isForeignCurrency",
)
ACC_KEEP = ("id", "type", "status", "currency", "balance", "availableBalance", "balanceDateTime")


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate the frame has. A pattern that several columns match is an error."""
    for pattern in candidates:
        found = [name for name in df.columns if fnmatchcase(name, pattern)]
        if len(found) > 1:
            raise ValueError(f"{pattern} matches several columns: {found}")
        if found:
            return found[0]
    return None


def resolve(df: DataFrame, candidates: Sequence[str], default: str | None = "UNK") -> Column:
    """Column for the first candidate present, else the default as a literal."""
    name = find_column(df, candidates)
    return F.col(f"`{name}`") if name else F.lit(default).cast("string")


def canonical(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename each alias to its canonical name where the canonical name is absent."""
    renames = {}
    for name in names:
        if name not in df.columns:
            found = find_column(df, ALIASES[name])
            if found and found not in renames:
                renames[found] = name
    return df.withColumnsRenamed(renames)


def account_alias(df: DataFrame) -> DataFrame | None:
    """Rename whatever names the account to ``accountId``; None when nothing does."""
    renamed = canonical(df, ["accountId"])
    return renamed if "accountId" in renamed.columns else None


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text that stands for missing becomes NULL, so does NaN."""
    out = {}
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "string":
            out[name] = F.when(~col.isin(*MISSING_TEXT), col)
        elif kind in ("double", "float"):
            out[name] = F.when(~F.isnan(col), col)
    return df.withColumns(out) if out else df


def patch_schema(df: DataFrame) -> DataFrame:
    """Add ``id`` from ``trId`` and ``direction`` from the amount's sign where they are absent."""
    out = df
    if "id" not in df.columns and "trId" in df.columns:
        out = out.withColumn("id", F.col("trId"))
    if "direction" not in df.columns and "amount" in df.columns:
        out = out.withColumn("direction", F.when(F.col("amount") > 0, "Credit").otherwise("Debit"))
    return out


def keep_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Exactly these columns, NULL where the frame lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in keep])


def namespace_ids(df: DataFrame, bank: str | Column, columns: Sequence[str], keep_original: str | None = None) -> DataFrame:
    """Prefix ids with the bank; ``keep_original`` names a column to copy into ``original_id``."""
    bank_col = F.lit(bank) if isinstance(bank, str) else bank
    new = {c: F.concat(bank_col, F.lit("_"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in columns}
    if keep_original:
        new["original_id"] = F.col(keep_original)
    return df.withColumns(new)


def quality_filter(df: DataFrame) -> DataFrame:
    """Cleared, not foreign currency, not zero; an unknown currency flag or amount is kept."""
    foreign = F.coalesce(F.col("isForeignCurrency").cast("boolean"), F.lit(False))
    amount = F.col("amount").cast("double")
    return df.filter((F.col("status") == "Cleared") & ~foreign & (amount.isNull() | (amount != 0)))


def before_cutoff(df: DataFrame, cutoff: str | Column | None) -> DataFrame:
    """Rows strictly before the cutoff day."""
    if cutoff is None:
        return df
    limit = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    return df.filter(F.col("date") < limit)


def filter_accounts(
    txns: DataFrame,
    accounts: DataFrame | None,
    account_type: str | None = "Checking",
    direction: str | None = "D",
    by: Sequence[str] = (),
) -> DataFrame:
    """Keep transactions of accounts of one type and of one direction.

    ``by`` names key columns that both sides have beside the account, such as the bank: equal ids of two banks
    are then two accounts. The direction is filtered before the join, and with a type only matching
    accounts are joined, so the join moves no row that is dropped later. Duplicate account ids do not
    fan out: the account with the smallest type wins.
    """
    out = txns if direction is None else txns.filter(F.col("direction") == direction)
    if accounts is None:
        return out
    key = "id" if "id" in accounts.columns else "accountId"
    keys = [*by, "accountId"]
    types = accounts.groupBy(*by, F.col(key).cast("string").alias("accountId")).agg(F.min("type").alias("type"))
    typed = out.withColumn("accountId", F.col("accountId").cast("string"))
    if account_type is None:
        return typed.join(types, keys, "left")
    return typed.join(types.filter(F.col("type") == account_type), keys, "inner")


def kept_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of a filter's input and output, and the share kept in percent."""
    tagged = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return tagged.agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after")).withColumn(
        "kept_pct", F.col("n_after") * 100.0 / F.col("n_before")
    )


def in_target_groups(txns: DataFrame, categories: DataFrame, groups: Sequence[str], column: str = "subCategoryId") -> DataFrame:
    """Transactions whose subcategory belongs to a target group."""
    wanted = categories.filter(F.col("group_id").isin(*groups)).select(F.col("subcategory_id").alias(column))
    return txns.join(wanted, column, "left_semi")


def add_category_names(txns: DataFrame, categories: DataFrame, column: str = "subCategoryId") -> DataFrame:
    """``sub_category_name`` from the category table, NULL when unknown."""
    names = categories.select(F.col("subcategory_id").alias(column), F.col("name").alias("sub_category_name"))
    return txns.join(names, column, "left")


def restrict_accounts(txns: DataFrame, ids: DataFrame) -> DataFrame:
    return txns.join(ids.select("accountId").distinct(), "accountId", "left_semi")


def active_days(txns: DataFrame) -> DataFrame:
    """Distinct ``(accountId, day)``; duplicates are dropped before the shuffle."""
    return txns.select("accountId", F.to_date("date").alias("day")).distinct()


def min_active_days(txns: DataFrame, min_days: int) -> DataFrame:
    """Transactions of accounts with at least ``min_days`` active days."""
    busy = (
        active_days(txns).filter(F.col("day").isNotNull()).groupBy("accountId").count()
        .filter(F.col("count") >= min_days)
    )
    return txns.join(busy, "accountId", "left_semi")


def censor_subcategory(txns: DataFrame, code: str) -> DataFrame:
    """Drop one subcategory, comparing codes without their C/G prefix; NULL codes stay."""
    target = str(code).upper().lstrip("C").lstrip("G")
    bare = strip_code_prefix(resolve(txns, ALIASES["subCategoryId"], None))
    return txns.filter(~bare.eqNullSafe(F.lit(target)))


def dedupe_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order (remaining columns break ties)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return first_in_group(df, keys, [F.col(c).asc_nulls_last() for c in [*order, *rest]])


def profile(df: DataFrame, date: str = "date", distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Row count, first and last day, and exact distinct counts.

    Each distinct count is two aggregations over its own column, so no row is expanded.
    """
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("min_date"), F.max(date).alias("max_date")
    )
    counts = {
        out: df.select(col).filter(F.col(col).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
        for out, col in (distinct or {}).items()
    }
    return base.withColumns(counts) if counts else base


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
