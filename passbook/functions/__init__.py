from .hashing import stable_hash, uniform
from .scalars import (
    amount_bin,
    calendar_months,
    date_features,
    day_gap,
    day_number,
    finite_or_zero,
    flag_name,
    iso_date,
    month_and_weekend,
    signed_log,
    strip_code_prefix,
)
from .stats import f1_score, hypergeometric_confidence, ratio_or_zero
from .vectors import cosine, dot, l2_norm, l2_normalize

__all__ = [
    "amount_bin", "calendar_months", "cosine", "date_features", "day_gap", "day_number", "dot",
    "f1_score", "finite_or_zero", "flag_name", "hypergeometric_confidence", "iso_date", "l2_norm",
    "l2_normalize", "month_and_weekend", "ratio_or_zero", "signed_log", "stable_hash",
    "strip_code_prefix", "uniform",
]
