import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from passbook.functions.stats import confidence_of
from passbook.operators import embed as M
from passbook.operators import evaluate as E
from passbook.operators import models as K
from passbook.plans.evaluation import run_evaluation


def _scored(spark, rows):
    return spark.createDataFrame(rows, "g string, id string, label int, score double")


def test_perfect_and_reversed_ranking(spark):
    rows = [("good", "1", 1, 0.9), ("good", "2", 1, 0.8), ("good", "3", 0, 0.2), ("good", "4", 0, 0.1)]
    rows += [("bad", i, 1 - y, s) for _, i, y, s in rows]
    rows += [("none", "1", 0, 0.5)]
    got = {r.g: r for r in E.metrics_at(_scored(spark, rows), ["g"], [50.0]).collect()}
    good, bad, none = got["good"], got["bad"], got["none"]
    assert (good.lift, good.precision, good.recall, good.f1) == (2.0, 1.0, 1.0, 1.0)
    assert (bad.lift, bad.precision, bad.recall, bad.f1) == (0.0, 0.0, 0.0, 0.0)
    assert (none.depth, none.n_found, none.lift, none.confidence) == (0, 0, 0.0, 0.0)


def test_curve_has_127_points(spark):
    rows = [("g", f"{i:03d}", i % 2, 1 - i / 100) for i in range(100)] + [("none", str(i), 0, 0.5) for i in range(5)]
    curve = E.granular_curve(_scored(spark, rows), ["g"]).collect()
    assert len(curve) == 127 and {r.g for r in curve} == {"g"}
    half = next(r for r in curve if r.k_pct == 50.0)
    assert half.lift == pytest.approx(1.0) and half.n_total == 100


def test_confidence():
    assert confidence_of(0, 100, 50, 10) == 0.0
    assert confidence_of(10, 100, 50, 10) > 99
    from math import comb

    for n, m, d in ((30, 7, 9), (50, 25, 25), (12, 12, 5), (400, 31, 80)):
        for k in range(0, min(m, d) + 1):
            p = sum(comb(m, x) * comb(n - m, d - x) for x in range(k, min(m, d) + 1)) / comb(n, d)
            want = 0.0 if k == 0 else 100 * (1 - p)
            assert confidence_of(k, n, m, d) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("per_chunk", [2, 1_000_000])
def test_auc_and_ranks_against_brute_force(spark, per_chunk):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else "b", f"{i:04d}", rng.randrange(2), rng.randrange(20) / 20) for i in range(400)]
    rows.append(("single", "x", 1, 0.3))
    df = _scored(spark, rows)
    got = {r.g: r.auc for r in E.roc_auc(df, ["g"], per_chunk).collect()}
    assert got["single"] == 0.5
    for g in ("hot", "b"):
        pos = [s for k, _, y, s in rows if k == g and y]
        neg = [s for k, _, y, s in rows if k == g and not y]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[g] == pytest.approx(wins / len(pos) / len(neg))
        ml = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(
            df.filter(F.col("g") == g).withColumn("label", F.col("label").cast("double"))
        )
        assert got[g] == pytest.approx(ml, abs=0.02)
    ranked = E.ranked_scores(df, ["g"], per_chunk).collect()
    for g in ("hot", "b"):
        want = [i for _, i, _, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))]
        assert [r.id for r in sorted((r for r in ranked if r.g == g), key=lambda r: r["rank"])] == want


def _pairs(spark, n, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    a, h = rng.normal(size=(n, 8)), rng.normal(size=(n, 8))
    b = a + noise * rng.normal(size=(n, 8))
    rows = [(i, a[i].tolist(), b[i].tolist(), h[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>, hard array<double>"), (a, b, h)


def _nce(a, b, t=0.07, h=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    z = unit(a) @ unit(b).T / t
    if h is not None:
        z = np.hstack([z, (unit(a) * unit(h)).sum(axis=1, keepdims=True) / t])
    one = np.mean(np.log(np.exp(z).sum(axis=1)) - np.diag(z))
    if h is not None:
        return one
    return (one + np.mean(np.log(np.exp(z.T).sum(axis=1)) - np.diag(z))) / 2


def test_contrastive_losses_against_brute_force(spark):
    df, (a, b, h) = _pairs(spark, 24, 0.8)
    assert M.info_nce(df, 24, 1).first().loss == pytest.approx(_nce(a, b))
    assert M.info_nce_hard(df, 24, 1).first().loss == pytest.approx(_nce(a, b, h=h))
    assert M.info_nce_hard(df.drop("hard"), 24, 1).first().loss == pytest.approx(_nce(a, b))
    same, _ = _pairs(spark, 24)
    assert 0 < M.info_nce(same, 24, 1).first().loss < 1
    assert M.info_nce(df, 24, 1, 0.5).first().loss != pytest.approx(_nce(a, b))
    batches = M.info_nce(df, 10, 1).collect()
    assert sorted(r.n for r in batches) == [4, 10, 10]
    with pytest.raises(ValueError):
        M.info_nce(df, 0, 1)


def test_losses_do_not_depend_on_blocks(spark, monkeypatch):
    """A batch of many blocks, at a temperature whose exponentials overflow without the running maximum."""
    monkeypatch.setattr(M, "BLOCK", 7)
    df, (a, b, h) = _pairs(spark, 60, 0.8)
    assert M.info_nce(df, 60, 1).first().loss == pytest.approx(_nce(a, b))
    assert M.info_nce_hard(df, 60, 1).first().loss == pytest.approx(_nce(a, b, h=h))
    cold = M.info_nce(df, 60, 1, 1e-4).first().loss
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    z = unit(a) @ unit(b).T / 1e-4
    assert cold == pytest.approx(((z.max(axis=1) - np.diag(z)).mean() + (z.max(axis=0) - np.diag(z)).mean()) / 2)
    near = {r.id: [(x.id, x.s) for x in r.near] for r in M.batch_similarities(df, 60, 1, top=4).collect()}
    sims = unit(a) @ unit(b).T
    assert {i: [j for j, _ in v] for i, v in near.items()} == {i: np.argsort(-sims[i], kind="stable")[:4].tolist() for i in range(60)}


@pytest.mark.parametrize("side, largest", [(3, 1000), (3, 5)])
def test_one_batch_is_many_tasks_of_few_large_blocks(spark, monkeypatch, side, largest):
    """Also where Spark broadcasts nothing. Rows are sent once for each block, so their number is bounded until blocks are full."""
    for name, value in (("BLOCK", 4), ("SIDE", side), ("LARGEST", largest), ("TILE", 3), ("PRODUCTS", 100)):
        monkeypatch.setattr(M, name, value)
    df, (a, b, h) = _pairs(spark, 60, 0.8)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        states = M.block_states(df.drop("hard"), 60, 1, 0.07).withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in states}) > side  # a batch used to be one task
        assert len(states) <= 2 * 60 * max(side, -(-60 // largest))
        assert M.info_nce(df, 60, 1).first().loss == pytest.approx(_nce(a, b))
        assert M.info_nce_hard(df, 60, 1).first().loss == pytest.approx(_nce(a, b, h=h))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_pca_and_silhouette(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    got = M.pca(v, "embedding").orderBy("vec_id").collect()
    for k in range(2):
        axis = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([r[f"pc{k + 1}"] for r in got], x @ axis, atol=1e-6)
    mine = M.cosine_silhouette(v, "embedding", "label", list(range(10))).agg(F.avg("silhouette")).first()[0]
    ml = ClusteringEvaluator(featuresCol="v", predictionCol="label", distanceMeasure="cosine").evaluate(
        v.withColumn("v", array_to_vector("embedding"))
    )
    assert mine == pytest.approx(ml, abs=1e-6)


def _labelled(spark, n=240):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        rows.append((f"{i:03d}", y, (rng.normal(size=4) + 2.0 * y).tolist(), (rng.normal(size=13) + y).tolist()))
    return spark.createDataFrame(rows, "id string, label int, embedding array<double>, features array<double>")


def test_methods_learn_and_issues_are_found(spark):
    rows = _labelled(spark)
    train, test = rows.filter("id < '160'"), rows.filter("id >= '160'")
    scored = K.score_methods(train, test, 1, ["GBT_Hybrid", "Linear_Emb", "PUL_Feat"], trees=3)
    table = {r.method: r for r in K.method_table(scored, ["method"]).collect()}
    assert set(table) == {"GBT_Hybrid", "Linear_Emb", "PUL_Feat"}
    assert all(r.auc > 0.75 for r in table.values()) and table["Linear_Emb"].auc > 0.95
    wrong = rows.withColumn("label", F.when(F.col("id").isin("001", "004"), 1).otherwise(F.col("label")))
    found = K.label_issues(K.out_of_fold(K.feature_sets(wrong), "emb", 1)).filter("issue").collect()
    assert {"001", "004"} <= {r.id for r in found}


def test_evaluation_run_end_to_end(spark):
    rows = _labelled(spark, 300).withColumnRenamed("id", "account_id")
    events = rows.filter("label = 1").select("account_id", F.lit("F").alias("flag"))
    positives = rows.filter("label = 1").select("account_id", F.lit("F").alias("flag"), F.lit(1).alias("T"), "embedding", "features")
    negatives = rows.select("account_id", F.lit(1).alias("T"), "embedding", "features")
    out = run_evaluation(
        rows.select("account_id"), positives, negatives, events, seeds=[1], sizes=[150, -1],
        methods=["Linear_Emb"], min_positives=10,
    ).collect()
    assert sorted(r.negatives_in_training for r in out) == [-1, 150]
    assert all(r.auc > 0.9 and r.n_pos + 0 < r.n_total == 90 for r in out)
    none = run_evaluation(rows.select("account_id"), positives, negatives, events, seeds=[1], sizes=[-1], methods=["Linear_Emb"], min_rows=10_000)
    assert none is None


def _inputs(spark, n=300):
    rows = _labelled(spark, n).withColumnRenamed("id", "account_id")
    flag = F.lit("F").alias("flag")
    events = rows.filter("label = 1").select("account_id", flag)
    one = F.lit(1).alias("T")
    return rows.select("account_id"), rows.filter("label = 1").select("account_id", flag, one, "embedding", "features"), rows.select("account_id", one, "embedding", "features"), events


def test_a_stopped_evaluation_goes_on(spark, tmp_path):
    """Runs that were finished are not scored again; changed rows are."""
    calls = []

    def score(train, test, seed, methods, trees):
        calls.append(seed)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return test.select(F.lit("M").alias("method"), "id", "label", F.col("embedding")[0].alias("score"))

    go = lambda inputs: run_evaluation(
        *inputs, seeds=[1, 2], sizes=[150, -1], methods=["M"], out=str(tmp_path / "e"), workers=1, score=score
    )
    inputs = _inputs(spark)
    with pytest.raises(RuntimeError):
        go(inputs)
    first = go(inputs).collect()
    assert len(calls) == 3 + 2 and len(first) == 4
    assert sorted(map(str, go(inputs).collect())) == sorted(map(str, first)) and len(calls) == 5
    go((*inputs[:3], inputs[3].filter("account_id != '000'")))
    assert len(calls) == 9


def brute_issues(rows):
    mean = lambda v: sum(v) / len(v)
    pos, neg = mean([p for _, y, p in rows if y]), mean([1 - p for _, y, p in rows if not y])
    out = set()
    for label in (0, 1):
        mine = [(i, p) for i, y, p in rows if y == label]
        guess = lambda p: (int(p > 0.5) if p >= pos and 1 - p >= neg else 1 if p >= pos else 0 if 1 - p >= neg else None)
        moved, kept = sum(guess(p) == 1 - label for _, p in mine), max(1, sum(guess(p) == label for _, p in mine))
        prune = min(round(len(mine) * moved / (kept + moved)), len(mine) - 1)
        margin = lambda p: 1 - 2 * p if label else 2 * p - 1
        out |= {i for i, p in mine if sum(margin(q) > margin(p) for _, q in mine) < prune and int(p > 0.5) != label}
    return out


@pytest.mark.parametrize("steps", [1000, 7])
def test_planted_noise_is_pruned(spark, steps):
    """One label in ten is wrong. As many go as the calibrated counts say: most of the wrong ones and few others. Ties at the cut go together."""
    rng = random.Random(steps)
    rows, wrong = [], set()
    for i in range(600):
        y = int(rng.random() < 0.3)
        p = min(max(rng.gauss(0.8 if y else 0.2, 0.1), 0.0), 1.0)
        if rng.random() < 0.1:
            y, _ = 1 - y, wrong.add(str(i))
        rows.append((str(i), y, round(p * steps) / steps))
    got = {r.id for r in K.label_issues(spark.createDataFrame(rows, "id string, label int, score double")).filter("issue").collect()}
    assert got == brute_issues(rows)
    assert len(got & wrong) >= 0.8 * len(wrong) and len(got - wrong) <= 0.02 * len(rows)


def test_linear_model_ends_at_the_optimum(spark):
    rows = K.feature_sets(_labelled(spark))
    got = K.fit_linear(rows, "emb")
    data = rows.select("label", "embedding").collect()
    x, y = np.array([r.embedding for r in data]), np.array([r.label for r in data])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(x @ np.array(got.weights) + got.intercept)))
    assert np.allclose(x.T @ (w * (p - y)) + np.array(got.weights), 0, atol=1e-6) and abs((w * (p - y)).sum()) < 1e-6
    one = K.fit_linear(rows.filter("label = 1"), "emb")
    assert {r.score for r in K.predict(one, rows).collect()} == {1.0}


def test_train_and_test_rows_are_made_once_for_all_methods(spark):
    """The scores are read from rows that were written once: nothing of what the test rows are made of is left in their plan."""
    n = F.col("id") % 4
    rows = spark.range(80).select(
        F.col("id").cast("string").alias("id"), (n == 0).cast("int").alias("label"),
        F.array(n.cast("double"), (F.col("id") % 7).cast("double")).alias("embedding"), F.array(*[F.lit(0.0)] * 7).alias("features"),
    )
    scored = K.score_methods(rows, rows, 1, ["Linear_Emb", "PUL_Emb"], workers=2)
    assert "Range (" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {m: sorted(r.id for r in scored.filter(F.col("method") == m).collect()) for m in ("Linear_Emb", "PUL_Emb")}
    assert got["Linear_Emb"] == got["PUL_Emb"] == sorted(str(i) for i in range(80))
