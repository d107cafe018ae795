import datetime as dt

import pytest
from pyspark.sql import functions as F

from passbook.functions.scalars import calendar_months, flag_name, strip_code_prefix
from passbook.operators import clean as C
from passbook.operators import labels as L
from passbook.sources import categories as cat

D = dt.date
TXN = "id string, accountId string, user_name string, date date, amount double, direction string, subCategoryId string, patternId string, deviceId string"
PAT = "patternId string, patternTypeBusiness string, deviceId string"


def _txn(i, acc, day, sub="C1203", pattern="P", user="u"):
    return (str(i), acc, user, day, -1.0, "D", sub, pattern, "dev")


def test_flag_names(spark):
    names = ["Buy Now Pay Later", "Savings & Investment", "  Bad   Spacing  "]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.f for r in df.select(flag_name(F.col("n"), "EMERGING").alias("f")).collect()]
    assert got == ["EMERGING_BUY_NOW_PAY_LATER", "EMERGING_SAVINGS_INVESTMENT", "EMERGING_BAD_SPACING"]


def test_emerging(spark):
    rows = [
        _txn(1, "A", D(2024, 1, 1), "other"), _txn(2, "A", D(2024, 6, 1), "C1203"),
        _txn(3, "B", D(2024, 1, 1), "other"), _txn(4, "B", D(2024, 2, 1), "C1203"), _txn(5, "B", D(2024, 9, 1), "C1203"),
    ]
    df = spark.createDataFrame(rows, TXN)
    got = L.detect_emerging(df, cat.default_categories(spark), ["CG1200"], 3).collect()
    assert [(r.accountId, r.flag_name, r.emerging_date) for r in got] == [("A", "EMERGING_SAVINGS", D(2024, 6, 1))]
    assert got[0].months_since_start == pytest.approx(5.0)
    empty = L.detect_emerging(df.limit(0), cat.default_categories(spark), ["CG1200"], 3)
    assert empty.count() == 0


def test_months_clamp_and_remainder(spark):
    pairs = [(D(2023, 1, 31), D(2023, 2, 28), 1.0), (D(2023, 1, 30), D(2023, 3, 1), 1 + 1 / 30.44), (D(2022, 5, 5), D(2024, 5, 4), 23 + 29 / 30.44)]
    df = spark.createDataFrame(pairs, "a date, b date, want double")
    for r in df.select("*", calendar_months(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want), r


def _skipped(spark, days, pat="DateOfMonth", **kw):
    df = spark.createDataFrame([_txn(i, "A", d) for i, d in enumerate(days)], TXN)
    pats = spark.createDataFrame([("P", pat, "dev"), ("P", pat, "dev")], PAT)
    return L.detect_skipped_payment(df, pats, ["DateOfMonth"], **kw).collect()


def test_skipped_payment(spark):
    days = [D(2022, 12, 1), D(2023, 1, 1), D(2023, 3, 1)]
    got = _skipped(spark, days, min_transactions=3)
    assert [(r.payment_before_gap, r.payment_after_gap, r.gap_days) for r in got] == [("2023-01-01", "2023-03-01", 59)]
    assert _skipped(spark, days) == []  # fewer than four payments


def test_two_monthly_pattern_is_left_out(spark):
    assert _skipped(spark, [D(2023, 1, 1), D(2023, 3, 1), D(2023, 5, 1)], min_transactions=3) == []


def test_same_day_payments_count_as_zero_gaps(spark):
    got = _skipped(spark, [D(2023, 1, 1), D(2023, 1, 1), D(2023, 3, 10)], min_transactions=3)
    assert [r.gap_days for r in got] == [68]


def test_monthly_type_has_its_own_threshold(spark):
    days = [D(2023, 1, 1), D(2023, 2, 1), D(2023, 3, 1), D(2023, 4, 18)]
    kw = {"monthly_payments": cat.DEFAULT_MONTHLY}
    assert len(_skipped(spark, days, "DateOfMonth", **kw)) == 1
    assert _skipped(spark, days, "MonthlyPayments", **kw) == []
    assert _skipped(spark, days, "Unwanted", **kw) == []


def test_duplicate_accounts_do_not_fan_out(spark):
    df = spark.createDataFrame([_txn(1, "A", D(2024, 1, 1))], TXN)
    acc = spark.createDataFrame([("A", "Checking"), ("A", "Checking")], "id string, type string")
    assert C.filter_accounts(df, acc).count() == 1
    assert C.filter_accounts(df, acc, direction="C").count() == 0


def test_code_prefix_and_censoring(spark):
    df = spark.createDataFrame([("CG2500",), ("c2500",), ("2500",), (None,), ("GC1",)], "subCategoryId string")
    bare = [r.b for r in df.select(strip_code_prefix(F.col("subCategoryId")).alias("b")).collect()]
    assert bare == ["2500", "2500", "2500", None, "C1"]
    kept = [r.subCategoryId for r in C.censor_subcategory(df, "C2500").collect()]
    assert sorted(kept, key=str) == ["GC1", None]
