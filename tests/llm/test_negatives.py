import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passbook.llm import negatives
from passbook.llm.negatives import hard_negatives, leading, products

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, row string, anchor string, _row int"


def brute(rows, every=10, most=5):
    usable = []
    for r in rows:
        bad = r[0] is None or r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[1])
        if not bad:
            usable.append((r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]], r[2]))
    out = Counter()
    for i, (anchor, v, label) in enumerate(usable):
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), o, m) for j, (o, w, m) in enumerate(usable) if j != i]
        scored.sort(key=lambda s: s[:2])
        for p in [s for s in scored if s[2] == label][:most]:
            inside = [s for s in scored if s[2] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            for rank, n in enumerate(inside[:most], 1):
                out[anchor, p[1], rank, n[1], -p[0], -n[0]] += 1
    return out


def rows_of(seed=1, n=400):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(n):
        c = rng.choice(centre)
        v = [round(x + rng.gauss(0, 0.6), 1 if i % 3 else 6) for x in c]
        rows.append((i, v, rng.randrange(4)))
    rows[7] = (7, rows[20][1], rows[20][2])
    rows += [rows[20], rows[31], (401, [0.0] * 6, 1), (410, [0.0] * 6, 1), (420, [], 2), (430, [1.0, 2.0], 2)]
    rows += [(440, None, 1), (450, [1.0, None], 1), (460, [float("nan")], 1), (470, [float("inf")], 1), (480, [1.0], None)]
    rows += [(None, [1.0] * 6, 1), (490, [0.5] * 6, 1), (500, [-5.0] * 6, 9), (510, [0.1] * 2000, 1)]
    rows += [(600 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], i % 2) for i in range(40)]  # ties between rows
    return [(*r, 1, "r", "a", 5) for r in rows]


@pytest.mark.parametrize("row_bytes", [negatives.ROW_BYTES, 16_000 * 40])
def test_against_brute_force(spark, monkeypatch, row_bytes):
    monkeypatch.setattr(negatives, "ROW_BYTES", row_bytes)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", row_bytes // 4)
    rows = rows_of()
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_an_empty_table_and_one_without_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(spark.createDataFrame(rows_of()[1:5], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_products_are_exact_or_refused():
    a = np.array([[2.0**28, 1.0]])
    assert products(a, a)[0, 0] == 2**56 + 1
    with pytest.raises(ArithmeticError):
        products(a * 64, a)


def test_leading_keeps_the_first_of_ties():
    scores = np.array([[5, 7, 7, 7, 1], [1, 1, 1, 1, 1]])
    allowed = np.array([[True, False, True, True, True], [True] * 5])
    assert [x.tolist() for x in leading(scores, allowed, 2)] == [[0, 0, 1, 1], [2, 3, 0, 1]]


def test_the_iterator_holds_windows_only():
    """Rows of an anchor come in many batches; state goes from one to the next."""
    rows = [(1, 10, True, 5, 100), (1, 10, False, 1, 100), (1, 10, False, 2, 90), (1, 10, True, 6, 90), (1, 10, False, 3, 79), (2, 20, False, 4, 3)]
    names = ["anchor", "anchor_id", "positive", "id", "score"]
    batches = [pa.RecordBatch.from_arrays([pa.array([v]) for v in r], names) for r in rows]
    got = [tuple(r.values()) for b in negatives._windows(iter(batches), 5, 5, 80, 100) for r in b.to_pylist()]
    assert got == [(10, 5, 1, 1, 100, 100), (10, 5, 2, 2, 100, 90), (10, 6, 1, 3, 90, 79)]
