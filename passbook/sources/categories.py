"""The category dimension and its default content."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "subcategory_id string, name string, group_id string, group_name string"

# The default category table, by group.
DEFAULT_GROUPS = {
    "CG2500": "Credit Card Payments",
    "CG1200": "Savings & Investments",
    "CG2200": "Loan & Mortgage",
}
DEFAULT_NAMES = {
    "C2501": "Credit Card Payments",
    "C2502": "Travel Credit Card",
    "C2503": "Student Credit Card",
    "C2504": "Secured Credit Card",
    "C2505": "Business Credit Card",
    "C2506": "Rewards Credit Card",
    "C1201": "Other Savings & Investments",
    "C1202": "Investments",
    "C1203": "Savings",
    "C1204": "Crypto Exchanges",
    "C1205": "Retirement Investments",
    "C1206": "Savings/College Funds",
    "C1207": "Term Deposit",
    "C2201": "Line of Credit",
    "C2202": "Mortgage",
    "C2203": "Car Finance",
    "C2204": "Personal Loan",
    "C2205": "Student Loan",
    "C2206": "Equipment Finance",
    "C2207": "Payday & Pawn & Title Loans",
    "C2208": "Healthcare Finance",
    "C2209": "Other Loans",
    "C2210": "Loans",
    "C2211": "Buy Now Pay Later",
    "C2212": "Payday Loans",
    "C2213": "Commercial Loans",
    "C2214": "Title Loans",
    "C2215": "Debt Collection Agencies",
}
# Default label parameters.
DEFAULT_PARAMETERS = {
    "primacy_period_months": 3,
    "gap_threshold_days": 45,
    "min_transactions": 4,
    "bimonthly_gap_threshold": 50,
}
DEFAULT_FILTERS = {"account_type": "Checking", "direction": "D"}
DEFAULT_PATTERN_TYPES = ("DateOfMonth", "NoisyDateOfMonth")
DEFAULT_MONTHLY = {"pattern_type": "MonthlyPayments", "gap_threshold_days": 50}


def default_categories(spark: SparkSession) -> DataFrame:
    rows = []
    for code, name in DEFAULT_NAMES.items():
        group = f"CG{code[1:3]}00"
        rows.append((code, name, group, DEFAULT_GROUPS[group]))
    return spark.createDataFrame(rows, SCHEMA)


def categories_from_config(spark: SparkSession, config: Mapping) -> DataFrame:
    """Category table from a parsed configuration; a category without a name keeps its id."""
    rows = [
        (code, info.get("name", code), info.get("group", ""), info.get("group_name", ""))
        for code, info in (config.get("categories") or {}).items()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def categories_from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Category table from a YAML file on any file system Spark can read."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return categories_from_config(spark, yaml.safe_load(text))
