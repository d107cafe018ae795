"""Ranking-metric arithmetic."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_score(precision: Column, recall: Column) -> Column:
    return ratio_or_zero(2 * precision * recall, precision + recall)


def _log_pmf(x: int, total: int, good: int, drawn: int) -> float:
    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    return choose(good, x) + choose(total - good, drawn - x) - choose(total, drawn)


def _sum_terms(first: int, last: int, total: int, good: int, drawn: int) -> float:
    """Sum of the probabilities first..last, walking outwards from ``first`` until they vanish."""
    step = 1 if last >= first else -1
    term = math.exp(_log_pmf(first, total, good, drawn))
    acc, x = term, first
    while x != last:
        if step > 0:
            term *= (good - x) * (drawn - x) / ((x + 1) * (total - good - drawn + x + 1))
        else:
            term *= x * (total - good - drawn + x) / ((good - x + 1) * (drawn - x + 1))
        x += step
        acc += term
        if term < acc * 1e-18:
            break
    return acc


def confidence_of(found: int, total: int, good: int, drawn: int) -> float:
    """100 * (1 - P[X >= found]) for X hypergeometric; 0 when nothing was found."""
    if found == 0 or good == 0:
        return 0.0
    low, high = max(0, drawn + good - total), min(good, drawn)
    if found <= low:
        return 0.0
    if found > high:
        return 100.0
    mean = drawn * good / total
    if found > mean:
        return 100.0 * (1.0 - min(1.0, _sum_terms(found, high, total, good, drawn)))
    return 100.0 * min(1.0, _sum_terms(found - 1, low, total, good, drawn))


@F.pandas_udf(DoubleType())
def hypergeometric_confidence(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    """Runs on metric rows (a few per group and depth), never on scored rows."""
    for found, total, good, drawn in batches:
        rows = zip(found, total, good, drawn)
        yield pd.Series(np.array([confidence_of(*(int(v) for v in row)) for row in rows], dtype=float))
