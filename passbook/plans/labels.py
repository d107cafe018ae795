"""Label generation over all banks as one plan, with the bank as a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators.clean import filter_accounts
from ..operators.labels import detect_emerging, detect_skipped_payment, label_summary
from ..sources import categories as C


def generate_labels(
    txns: DataFrame,
    accounts: DataFrame | None,
    patterns: DataFrame | None,
    categories: DataFrame,
    target_groups: Sequence[str] = tuple(C.DEFAULT_GROUPS),
    filters: Mapping[str, str | None] = C.DEFAULT_FILTERS,
    parameters: Mapping[str, float] = C.DEFAULT_PARAMETERS,
    pattern_types: Sequence[str] = C.DEFAULT_PATTERN_TYPES,
    monthly_payments: Mapping[str, object] | None = C.DEFAULT_MONTHLY,
) -> dict[str, DataFrame | None]:
    """``emerging``, ``skipped`` and ``summary`` frames of banked transactions.

    Filters come first: they decide where an account starts. With a ``bank`` in the transactions it is part of
    every key, so banks may use the same ids. Accounts or patterns without a bank are joined by their id alone,
    for ids that are told apart otherwise, but payments are still those of one bank.
    """
    by = ["bank"] if "bank" in txns.columns else []
    of = lambda df: [c for c in by if df is not None and c in df.columns]
    rows = filter_accounts(txns, accounts, filters.get("account_type"), filters.get("direction"), of(accounts))
    emerging = detect_emerging(
        rows, categories, target_groups, parameters.get("primacy_period_months", 4), by=by
    )
    skipped = None
    if patterns is not None:
        skipped = detect_skipped_payment(
            rows,
            patterns,
            pattern_types,
            int(parameters.get("gap_threshold_days", 45)),
            int(parameters.get("min_transactions", 4)),
            int(parameters.get("bimonthly_gap_threshold", 50)),
            monthly_payments,
            by=by,
        )
    out: dict[str, DataFrame | None] = {"emerging": emerging, "skipped": skipped, "summary": None}
    if by and skipped is not None:
        out["summary"] = label_summary(txns, emerging, skipped)
    return out
