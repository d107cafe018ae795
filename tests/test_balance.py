import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from passbook.functions.scalars import signed_log
from passbook.operators import balance as B

TXN = "accountId string, id string, date date, amount double, direction string"
ACC = "accountId string, availableBalance double, balanceDateTime date"
D = dt.date


def _run(spark, txns, accounts, acc_schema=ACC, **kw):
    out = B.running_balance(spark.createDataFrame(txns, TXN), spark.createDataFrame(accounts, acc_schema), **kw)
    return [(r.id, r.amount, r.balance_after) for r in out.orderBy("accountId", "date", "id").collect()]


def test_running_balance(spark):
    txns = [("A", "1", D(2024, 1, 1), -100.0, "D"), ("A", "2", D(2024, 1, 2), -50.0, "D"), ("A", "3", D(2024, 1, 3), 200.0, "C")]
    assert [r[2] for r in _run(spark, txns, [("a", 1050.0, D(2024, 1, 5))])] == [900.0, 850.0, 1050.0]


def test_sign_flip(spark):
    txns = [("A", "1", D(2024, 1, 1), 100.0, "D"), ("A", "2", D(2024, 1, 2), 200.0, "D")]
    got = _run(spark, txns, [("A", 700.0, D(2024, 1, 5))])
    assert got == [("1", -100.0, 900.0), ("2", -200.0, 700.0)]


def test_no_account_and_null_snapshot(spark):
    txns = [("A", "1", D(2024, 1, 1), -1.0, "D")]
    assert _run(spark, txns, [("B", 1.0, D(2024, 1, 1))])[0][2] is None
    assert _run(spark, txns, [("A", None, D(2024, 1, 1))])[0][2] is None


def test_pending_row(spark):
    acc = ACC + ", estimatedPendingAmount double"
    txns = [("A", "1", D(2024, 1, 1), -10.0, "D")]
    got = _run(spark, txns, [("A", 1000.0, D(2024, 1, 5), -50.0), ("B", 5.0, D(2024, 1, 5), -50.0)], acc)
    assert got == [("1", -10.0, 1050.0), (B.PENDING_ID, -50.0, 1000.0)]
    assert len(_run(spark, txns, [("A", 1000.0, D(2024, 1, 5), -50.0)], acc, include_pending=False)) == 1


def test_after_snapshot_only_future_and_unsorted(spark):
    txns = [("A", "1", D(2024, 1, 5), 10.0, "C"), ("A", "2", D(2024, 1, 15), -20.0, "D")]
    assert [r[2] for r in _run(spark, txns, [("A", 100.0, D(2024, 1, 10))])] == [100.0, 80.0]
    assert _run(spark, [("A", "1", D(2024, 1, 2), -50.0, "D")], [("A", 1000.0, D(2024, 1, 1))])[0][2] == 950.0
    txns = [("A", "1", D(2024, 1, 2), -10.0, "D"), ("A", "2", D(2024, 1, 1), -20.0, "D")]
    assert [r[2] for r in _run(spark, txns, [("A", 100.0, D(2024, 1, 2))])] == [110.0, 100.0]


def test_null_amounts_dates_and_duplicates(spark):
    txns = [
        ("A", "1", D(2024, 1, 1), -10.0, "D"), ("A", "1", D(2024, 1, 3), -10.0, "D"),
        ("A", "2", D(2024, 1, 2), None, "D"), ("A", "3", None, -5.0, "D"), ("A", "4", D(2024, 1, 2), float("nan"), "D"),
    ]
    out = {i: b for i, _, b in _run(spark, txns, [("A", 100.0, D(2024, 1, 2))])}
    assert out == {"1": 100.0, "2": None, "3": 95.0, "4": None}
    daily = B.daily_balances(spark.createDataFrame(txns, TXN), spark.createDataFrame([("A", 100.0, D(2024, 1, 2))], ACC))
    assert sorted((r.date, r.balance) for r in daily.collect() if r.balance is not None) == [(D(2024, 1, 1), 100.0)]


def test_daily_close_and_running_date(spark):
    txns = [("A", "1", D(2024, 1, 1), -10.0, "D"), ("A", "2", D(2024, 1, 1), -20.0, "D"), ("B", "3", D(2024, 2, 1), -1.0, "D")]
    daily = B.daily_balances(spark.createDataFrame(txns, TXN), spark.createDataFrame([("A", 970.0, D(2024, 1, 1))], ACC))
    rows = {r.accountId: r for r in daily.collect()}
    assert rows["A"].balance == 970.0 and rows["B"].balance is None
    assert rows["A"].running_date == D(2024, 2, 1)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="direction"):
        B.dedupe_transactions(spark.createDataFrame([("A",)], "accountId string"))


def test_window_stats_and_starting_balance(spark):
    daily = spark.createDataFrame(
        [("A", D(2024, 1, 1), 100.0), ("A", D(2024, 1, 2), 200.0), ("A", D(2024, 1, 3), 150.0)],
        "accountId string, date date, balance double",
    )
    probes = spark.createDataFrame(
        [("a", D(2024, 1, 1), D(2024, 1, 3)), ("a", D(2023, 1, 1), D(2023, 2, 3)), ("x", D(2024, 1, 1), D(2024, 1, 3))],
        "accountId string, start_date date, end_date date",
    )
    got = {(r.accountId, r.start_date): r for r in B.window_stats(probes, daily).collect()}
    hit = got["a", D(2024, 1, 1)]
    assert (hit.start_balance, hit.end_balance, hit.max_balance, hit.min_balance, hit.balance_change) == (100.0, 150.0, 200.0, 100.0, 50.0)
    assert math.isclose(hit.balance_volatility, 40.8248290, rel_tol=1e-6)
    assert got["a", D(2023, 1, 1)].avg_balance is None and got["x", D(2024, 1, 1)].start_balance is None
    asked = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 2)), ("a", D(2024, 3, 1)), ("x", D(2024, 1, 1))], "accountId string, date date")
    start = {(r.accountId, r.date): r.starting_balance for r in B.starting_balance_on(asked, daily).collect()}
    assert start == {("a", D(2024, 1, 1)): 100.0, ("a", D(2024, 1, 2)): 100.0, ("a", D(2024, 3, 1)): 150.0, ("x", D(2024, 1, 1)): None}
    strict = {(r.accountId, r.date): r.starting_balance for r in B.starting_balance_on(asked, daily, strict=True).collect()}
    assert strict["a", D(2024, 1, 1)] is None
    exact = {r.date: r.balance for r in B.balance_on(asked, daily).collect() if r.accountId == "a"}
    assert exact == {D(2024, 1, 1): 100.0, D(2024, 1, 2): 200.0, D(2024, 3, 1): None}


def test_signed_log(spark):
    row = spark.createDataFrame([(100.0, -100.0, None, 0.0)], "a double, b double, c double, d double").select(
        *[signed_log(F.col(c)).alias(c) for c in "abcd"]
    ).first()
    assert row.a == -row.b == pytest.approx(math.log1p(100)) and row.c == 0.0 and row.d == 0.0


@pytest.mark.parametrize("per_chunk", [3, 1_000_000])
def test_hot_account_against_brute_force(spark, per_chunk):
    """One account, and one of its days, own most rows; small chunks give the same answer."""
    rng = random.Random(5)
    txns = []
    for i in range(800):
        acc = "HOT" if rng.random() < 0.8 else f"A{rng.randrange(5)}"
        day = D(2024, 1, 1) if rng.random() < 0.5 else D(2024, 1, 1) + dt.timedelta(days=rng.randrange(40))
        txns.append((acc, f"{i:04d}", day, float(rng.randrange(-100, 100)), rng.choice("CD")))
    accounts = [(a, 1000.0, D(2024, 1, 20)) for a in ["HOT", "A0", "A1", "A2", "A3"]]
    got = {i: b for i, _, b in _run(spark, txns, accounts, rows_per_chunk=per_chunk)}
    want = {}
    for acc in {t[0] for t in txns}:
        mine = sorted((t for t in txns if t[0] == acc), key=lambda t: (t[2], t[1]))
        bal = 1000.0 - sum(t[3] for t in mine if t[2] <= D(2024, 1, 20)) if acc != "A4" else None
        for t in mine:
            bal = None if bal is None else bal + t[3]
            want[t[1]] = bal
    assert got == want


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_rolling_features_against_brute_force(spark, partitions):
    rng = random.Random(3)
    days = sorted(rng.sample(range(60), 30))
    rows = [("A", D(2024, 1, 1) + dt.timedelta(days=d), float(rng.randrange(1000))) for d in days]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.date: r for r in B.rolling_features(spark.createDataFrame(rows, "accountId string, date date, balance double")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, (_, day, _b) in enumerate(rows):
        win = [b for _, d, b in rows if 1 <= (day - d).days <= 8]
        r = got[day]
        assert r.starting == (rows[i - 1][2] if i else rows[0][2])
        if not win:
            assert r.start is None and r.std is None
            continue
        mean = sum(win) / len(win)
        std = math.sqrt(sum((w - mean) ** 2 for w in win) / len(win))
        assert (r.start, r.end, r.min, r.max) == (win[0], win[-1], min(win), max(win))
        assert r.avg == pytest.approx(mean) and r.std == pytest.approx(std, abs=1e-9)


def test_long_ranges_are_few_blocks(spark):
    """Ranges from a day to a century, before and after 1970, against plain loops; each is at most 2 log2 n blocks."""
    import random
    import statistics

    rng = random.Random(3)
    day0 = dt.date(1955, 1, 1)
    days = sorted(rng.sample(range(40_000), 1500))
    balance = {d: round(rng.uniform(-1e6, 1e6), 2) for d in days}
    daily = spark.createDataFrame([("A", day0 + dt.timedelta(d), b) for d, b in balance.items()], "accountId string, date date, balance double")
    asked = [(i, "a", day0 + dt.timedelta(s), day0 + dt.timedelta(s + n)) for i, (s, n) in enumerate(
        [(rng.randrange(40_000), rng.choice([0, 1, 30, 400, 9000, 39_000])) for _ in range(80)] + [(0, 60_000), (days[0], 0), (5, -1)]
    )]
    probes = spark.createDataFrame(asked, "i int, accountId string, start_date date, end_date date")
    got = {r.i: r for r in B.window_stats(probes, daily).collect()}
    assert len(got) == len(asked)
    for i, _, start, end in asked:
        inside = [balance[d] for d in days if start <= day0 + dt.timedelta(d) <= end]
        r = got[i]
        if not inside:
            assert r.start_balance is None and r.avg_balance is None
            continue
        assert (r.start_balance, r.end_balance, r.min_balance, r.max_balance) == (inside[0], inside[-1], min(inside), max(inside))
        assert r.avg_balance == pytest.approx(statistics.fmean(inside), abs=1e-6)
        assert r.balance_volatility == pytest.approx(statistics.pstdev(inside), abs=1e-6)
    blocks = probes.filter("start_date <= end_date").select(
        F.size(B._range_blocks(F.col("start_date"), F.col("end_date"))).alias("n"), F.datediff("end_date", "start_date").alias("d")
    )
    assert all(r.n <= 2 * max(1, (r.d + 1).bit_length()) for r in blocks.collect())


def test_window_stats_moves_probes_and_accounts_once_and_skips_days_without_a_balance(spark):
    """Nothing is sent for each block of days: a probe is read and shuffled once. A day with a NULL balance is not the first."""
    daily = spark.createDataFrame(
        [("A", D(2024, 1, 2), None), ("A", D(2024, 1, 3), 100.0), ("B", D(2024, 1, 3), None)], "accountId string, date date, balance double"
    )
    probes = spark.createDataFrame([("a", D(2024, 1, 2), D(2024, 1, 3)), ("b", D(2024, 1, 2), D(2024, 1, 3)), ("a", None, D(2024, 1, 3))],
                                   "accountId string, start_date date, end_date date")
    stats = B.window_stats(probes, daily)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange") <= 2 and "hashpartitioning(_acc, _level" not in plan
    got = {(r.accountId, r.start_date): (r.start_balance, r.end_balance, r.avg_balance, r.balance_volatility) for r in stats.collect()}
    nothing = (None,) * 4
    assert got == {("a", D(2024, 1, 2)): (100.0, 100.0, 100.0, 0.0), ("b", D(2024, 1, 2)): nothing, ("a", None): nothing}
