import numpy as np
import pytest
from pyspark.sql import functions as F

from passbook.llm.toxicity import DECAY, SPANS, fit, score, subsequences, train, windows, words_of

CLEAN = ["table", "window", "garden", "bottle", "mother", "paper", "river", "stone", "market", "summer", "forest", "yellow"]


def documents(n=600, seed=4):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.integers(5, 60))]
        if i % 4 == 0:
            words.insert(int(rng.integers(0, len(words))), rng.choice(["blorgon", "snarfle"]) + rng.choice(["", "s", "ish", "er"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = documents()
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


@pytest.fixture(scope="module")
def machine(tables):
    docs, labels = tables
    return train(docs, labels.where("doc_id % 5 != 0"))


def test_held_out_accuracy(tables, machine):
    docs, labels = tables
    got = score(docs, machine).join(labels, "doc_id").where("doc_id % 5 = 0").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].score.min() > got[got.toxic == 0].score.max()


def test_gaps_and_insertions_are_tolerated(spark, machine):
    texts = ["you blorgon", "you bl-or-gon", "you b.l.o.r.g.o.n", "you b l o r g o n now", "BLORG0N", "blorrgon x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, "yellow garden table")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in score(rows, machine).collect()}
    assert min(got[i] for i in range(len(texts))) > got[9]
    assert all(got[i] > 0.5 for i in (0, 1, 2, 3, 4)) and got[9] < 0.5


def test_defined_results_for_odd_rows(spark, machine):
    rows = [(1, None, 9.0, "a", "b"), (1, None, 9.0, "a", "b"), (None, "", 9.0, "a", "b"), (3, "garden " * 50_000 + "blorgons", 9.0, "a", "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, score double, _whole string, _text string")
    got = score(frame, machine)
    assert set(got.columns) == set(frame.columns) | {"predicted"}
    out = got.collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in out) == [(0, 0), (1, 0), (1, 0), (3, 1)]
    assert len({r.score for r in out if r.doc_id != 3}) == 1 and all(0 <= r.score <= 1 for r in out)
    assert score(frame.limit(0), machine).count() == 0


def test_without_both_classes_nothing_is_rejected(spark, tables):
    docs, labels = tables
    assert train(docs, labels.where("toxic = 0")) is None
    assert train(docs.limit(0), labels) is None
    assert score(docs, None).where("score > 0 OR predicted > 0").count() == 0
    assert train(docs, labels.withColumn("toxic", F.lit(None).cast("int"))) is None


def test_folded_weights_equal_the_kernel_machine():
    positive, negative = ["blorgon", "blorgons", "snarfle"], [w + s for w in CLEAN for s in ("", "s")]
    machine = fit(positive, negative, landmarks=8)
    wins, _ = windows(["blorgonish", "garden", "snarrfle"])
    by_hand = []
    for w in wins:
        total = machine.bias
        for n, got in subsequences(w).items():
            total += sum(v * machine.weights[n][code] for code, v in got.items())
        by_hand.append(total)
    assert np.allclose(machine.margins(wins), by_hand, atol=1e-4)
    assert by_hand[0] > by_hand[1] and by_hand[2] > by_hand[1]


def test_subsequences_by_brute_force():
    from itertools import combinations

    window = windows(["abcab"])[0][0]
    got = subsequences(window)
    for n, reach in SPANS.items():
        want = {}
        for c in combinations(range(6), n):
            if c[-1] - c[0] < reach:
                code = 0
                for i in c:
                    code = code * 40 + int(window[i])
                want[code] = want.get(code, 0) + DECAY ** (c[-1] - c[0] + 1 - n)
        assert got[n] == pytest.approx(want)


def test_words_and_windows():
    assert words_of("a word b c f.") == ["a", "word", "b", "c", "f."]
    assert "bcde" in words_of("a word b c d e fg")
    wins, word = windows(["abc", "x" * 30, "é"])
    assert word.tolist() == [0, 1, 1, 1, 1, 1, 2] and wins.shape[1] == 12
