import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from passbook.operators import augment as A
from passbook.operators import examples as X
from passbook.operators import points as P
from passbook.operators import vocab as V

D = dt.datetime
TXN = "id string, accountId string, date timestamp, amount double, categoryGroupId string, subCategoryId string, deviceId string"


def _txns(spark):
    return spark.createDataFrame(
        [
            ("1", "a1", D(2024, 1, 6, 9), 100.0, "G1", "S1", "d1"),
            ("2", "a1", D(2024, 1, 6, 8), 20.0, "G1", None, "d2"),
            ("3", "a1", D(2024, 1, 6, 7), 50.0, "G2", "S9", ""),
            ("4", "a1", D(2024, 1, 8, 7), -5.0, "G1", "S1", "d1"),
            ("5", "a1", D(2024, 1, 8, 8), 0.0, "G1", "S1", "d1"),
            ("6", "a2", D(2024, 1, 8, 8), 7.0, "G1", "S1", "d1"),
        ],
        TXN,
    )


def test_vocabulary_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("a",)], "subCategoryId string")
    vocab = V.build_vocab(df, rows_per_chunk=1)
    assert {(r.token, r.token_id) for r in vocab.collect()} == {("a", 2), ("b", 3)}
    probe = spark.createDataFrame([("a",), ("zz",), (None,), ("",)], "t string")
    assert {r.t: r.cat_sub for r in V.encode(probe, vocab, {"cat_sub": "t"}).collect()} == {"a": 2, "zz": 1, None: 0, "": 0}
    ids = spark.createDataFrame([(0,), (1,), (3,), (99,)], "i int")
    assert [r.token for r in V.decode(ids, vocab, "cat_sub", "i").orderBy("i").collect()] == ["<PAD>", "<UNK>", "b", "<UNK>"]


def test_arrival_layout(spark):
    t = _txns(spark)
    ex = X.build_examples(t, V.build_vocab(t), None, "arrival", max_txns=2, min_days=2).collect()
    assert [r.account_id for r in ex] == ["a1"]  # a2 has one active day
    first, second = ex[0].days
    assert (first.day_offset, first.month, first.is_weekend) == (1466, 1, 1) and second.is_weekend == 0
    assert first.neg is None and second.pos is None
    assert first.pos.n_txns == 2 and first.pos.cat_group == [3, 2] and first.pos.cat_sub == [3, 0]
    assert first.pos.cat_cp == [0, 3]
    assert first.pos.log_total_volume == pytest.approx(math.log1p(70))
    logs = [math.log1p(50), math.log1p(20)]
    assert first.pos.amounts == pytest.approx([1.0, -1.0], abs=1e-6) and logs[0] > logs[1]
    assert second.neg.n_txns == 2 and second.neg.amounts[1] == 0.0  # a zero amount is a debit here
    assert first.pos.dates[0][:3] == [5.0, 5.0, 0.0]


def test_magnitude_layout_drops_zeros_and_keeps_largest(spark):
    t = _txns(spark)
    row = X.build_examples(t, V.build_vocab(t), None, "magnitude", max_txns=1, min_days=2).first()
    first, second = row.days
    assert first.pos.log_total_volume == pytest.approx(math.log1p(100))
    assert first.pos.amounts == [0.0]  # one row standardises to zero
    assert second.neg.n_txns == 1


def test_balance_vector_and_padding(spark):
    t = _txns(spark)
    bal = spark.createDataFrame([("A1", dt.date(2024, 1, 8), [1.0] * 7)], "accountId string, date date, balance array<double>")
    ex = X.build_examples(t, V.build_vocab(t), bal, "arrival", min_days=1).withColumn("batch_id", F.lit(0))
    rows = {r.account_id: r for r in X.pad_batches(ex).collect()}
    one, two = rows["a1"], rows["a2"]
    assert one.day_mask == [True, True] and two.day_mask == [True, False]
    assert one.pos.mask == [[True] * 3, [False] * 3] and two.pos.mask == [[True, False, False], [False] * 3]
    assert one.neg.has_data == [False, True] and two.day_dates == [1468, 0]
    assert one.pos.balance[0] == [[0.0] * 7] * 3 and one.neg.balance[1] == [[1.0] * 7] * 2
    assert len(two.pos.dates[1][2]) == 4 and two.neg.cat_group == [[0, 0], [0, 0]]


def _days(spark, n, accounts=40):
    return spark.range(accounts).select(
        F.col("id").cast("string").alias("account_id"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.struct(d.alias("day_offset"))).alias("days"),
    )


def test_last_days_and_short_examples_unchanged(spark):
    row = A.cap_days(_days(spark, 20, 1), 5).first()
    assert [d.day_offset for d in row.days] == [15, 16, 17, 18, 19] and row.n_days == 5
    assert all(len(r.days) == 4 for r in A.augment(_days(spark, 4), 1).collect())


def test_augmentation_shapes_and_reproducibility(spark):
    ex = _days(spark, 30)
    got = {(r.account_id, r.view): [d.day_offset for d in r.days] for r in A.two_views(ex, 3).collect()}
    again = {(r.account_id, r.view): [d.day_offset for d in r.days] for r in A.two_views(ex.repartition(7), 3).collect()}
    assert got == again and len(got) == 80
    contiguous = [v for v in got.values() if v == list(range(v[0], v[0] + len(v)))]
    assert 20 < len(contiguous) < 60
    assert all(v == sorted(v) for v in got.values())
    assert all(18 <= len(v) <= 27 for v in contiguous if len(v) < 30)
    assert any(got[a, 1] != got[a, 2] for a, _ in got)


def test_slice_to_cutoff(spark):
    ex = spark.createDataFrame([("a", [(d,) for d in (1, 3, 5, 7, 9)])], "account_id string, days array<struct<day_offset:int>>")
    for cut, want in ((5, [1, 3, 5]), (0, [1]), (100, [1, 3, 5, 7, 9])):
        cuts = spark.createDataFrame([("a", cut)], "account_id string, cutoff_day int")
        row = P.slice_examples(ex, cuts).first()
        assert [d.day_offset for d in row.days] == want and row.n_days == len(want)
    cuts = spark.createDataFrame([("a", 0)], "account_id string, cutoff_day int")
    assert P.slice_examples(ex, cuts, keep_first=False).first().days == []


def test_baseline_features(spark):
    stream = "struct<amounts:array<float>,balance:array<array<float>>,n_txns:int>"
    schema = f"account_id string, n_days int, days array<struct<day_offset:int,pos:{stream},neg:{stream}>>"
    bal = [[1000.0] + [0.0] * 6]
    days = [(1, ([100.0, 50.0], None, 2), None), (2, None, ([-20.0], bal, 1)), (3, None, None)]
    f = P.baseline_features(spark.createDataFrame([("a", 5, days), ("b", 0, [])], schema)).collect()
    assert f[0].features == [3.0, 5.0, -20.0, 150.0, -20.0, 0.0, 1000.0, 0, 0, 0, 0, 0, 0]
    assert f[1].features == [0.0] * 13


def test_audit_finds_bad_values(spark):
    t = _txns(spark)
    ex = X.build_examples(t, None, None, min_days=1)
    assert X.audit_examples(ex).count() == 0


def test_vocabulary_is_ranked_from_tokens_that_were_written_once(spark):
    """Nothing of the rows is left in the plan; marks, totals and ranks all read the tokens."""
    words = spark.range(40).select(F.concat(F.lit("w"), (F.col("id") % 5).cast("string")).alias("word"))
    vocab = V.build_vocab(words, {"word": "word"}, rows_per_chunk=2)
    assert "Range (" not in vocab._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.token, r.token_id) for r in vocab.collect()) == [(f"w{i}", i + 2) for i in range(5)]
