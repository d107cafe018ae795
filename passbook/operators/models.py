"""Classifiers on assembled rows, confident-learning cleaning and the method table.

Boosted trees are MLlib's. The linear model is fitted by Newton steps whose sums are one aggregate of d x d numbers each, so
it ends at the optimum and not at an iteration count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.vectors import dot
from ..session import ensure_checkpoint_dir, stored
from .evaluate import LIFT_KS, lift_table, roc_auc
from .ordered import prefix_sums

# Settings of the compared methods.
TREES, DEPTH, RATE = 100, 4, 0.1
LINEAR_STEPS, LINEAR_TOLERANCE, RIDGE = 100, 1e-9, 1.0
FOLDS = 5
BALANCE_TAIL = 7
# Method name -> (kind, which features).
METHODS = {
    "GBT_Emb": ("trees", "emb"),
    "GBT_Feat": ("trees", "feat"),
    "GBT_Hybrid": ("trees", "hybrid"),
    "GBT_Bal": ("trees", "bal"),
    "Linear_Emb": ("linear", "emb"),
    "PUL_Emb": ("cleaned", "emb"),
    "PUL_Feat": ("cleaned", "feat"),
}


def feature_sets(rows: DataFrame) -> DataFrame:
    """Vectors ``emb, feat, hybrid, bal`` from array columns ``embedding`` and ``features``."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    emb, feat = double("embedding"), double("features")
    return rows.withColumns(
        {
            "emb": array_to_vector(emb),
            "feat": array_to_vector(feat),
            "hybrid": array_to_vector(F.concat(emb, feat)),
            "bal": array_to_vector(F.slice(feat, -BALANCE_TAIL, BALANCE_TAIL)),
        }
    )


def class_sizes(rows: DataFrame) -> tuple[int, int]:
    """Positives and negatives, as two numbers."""
    got = rows.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    return int(got["p"] or 0), int(got["n"] - (got["p"] or 0))


def weighted(rows: DataFrame, positives: float, negatives: float) -> DataFrame:
    """Double ``label`` and a ``weight`` per class."""
    return rows.withColumns(
        {
            "weight": F.when(F.col("label") == 1, F.lit(positives)).otherwise(F.lit(negatives)),
            "label": F.col("label").cast("double"),
        }
    )


def fit_trees(rows: DataFrame, features: str, seed: int, trees: int = TREES):
    """Boosted trees with positives weighted by the class ratio."""
    p, q = class_sizes(rows)
    return GBTClassifier(
        featuresCol=features, labelCol="label", weightCol="weight",
        maxIter=trees, maxDepth=DEPTH, stepSize=RATE, seed=seed,
    ).fit(weighted(rows, q / p if p else 1.0, 1.0))


@dataclass(frozen=True)
class Linear:
    """A fitted logistic model. ``certain`` is the class where training rows had one only."""

    features: str
    weights: tuple[float, ...]
    intercept: float
    certain: int | None = None


def _newton_sums(rows: DataFrame, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the weighted log loss at ``at`` (intercept last), added up by the executors."""
    d = len(at)
    upper = np.triu_indices(d)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d + len(upper[0]))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1), np.ones(len(pdf))])
            y, w = pdf["y"].to_numpy(dtype=float), pdf["w"].to_numpy(dtype=float)
            z = x @ at
            p = 0.5 * (1 + np.tanh(z / 2))
            total[0] += (w * (np.logaddexp(0, z) - y * z)).sum()
            total[1 : d + 1] += x.T @ (w * (p - y))
            total[d + 1 :] += ((x * (w * p * (1 - p))[:, None]).T @ x)[upper]
        yield pd.DataFrame({"sums": [total]})

    parts = rows.mapInPandas(part, "sums array<double>")
    sums = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s")).first().s
    got = np.array(sums)
    hessian = np.zeros((d, d))
    hessian[upper] = got[d + 1 :]
    return got[0], got[1 : d + 1], hessian + np.triu(hessian, 1).T


def fit_linear(rows: DataFrame, features: str, ridge: float = RIDGE) -> Linear:
    """Balanced logistic regression with a penalty of ``ridge`` / 2 times the squared coefficients, not the intercept.

    Newton steps, halved where one does not lower the loss, until no coefficient moves by more than
    ``LINEAR_TOLERANCE``. Raises when ``LINEAR_STEPS`` do not suffice.
    """
    p, q = class_sizes(rows)
    n = p + q
    used = weighted(rows, n / (2 * max(1, p)), n / (2 * max(1, q)))
    used = stored(used.select(vector_to_array(features).alias("x"), F.col("label").alias("y"), F.col("weight").alias("w")), "fit")
    if not p or not q:
        return Linear(features, (), 0.0, int(p > 0))
    size = used.agg(F.max(F.size("x"))).first()[0] + 1
    penalty = np.append(np.full(size - 1, ridge), 0.0)
    at, step, best = np.zeros(size), np.zeros(size), None
    for _ in range(LINEAR_STEPS):
        loss, gradient, hessian = _newton_sums(used, at + step)
        loss += 0.5 * (penalty * (at + step) ** 2).sum()
        if best is not None and loss > best + 1e-9 * abs(best):
            step = step / 2
            continue
        at, best = at + step, loss
        if best is not None and np.abs(step).max() <= LINEAR_TOLERANCE and step.any():
            return Linear(features, tuple(at[:-1].tolist()), float(at[-1]))
        step = -np.linalg.lstsq(hessian + np.diag(penalty), gradient + penalty * at, rcond=None)[0]
        if not step.any():
            return Linear(features, tuple(at[:-1].tolist()), float(at[-1]))
    raise RuntimeError(f"no optimum after {LINEAR_STEPS} Newton steps")


def predict(model, rows: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class."""
    if isinstance(model, Linear):
        if model.certain is not None:
            return rows.withColumn(out, F.lit(float(model.certain)))
        z = dot(vector_to_array(F.col(model.features)), F.array(*[F.lit(w) for w in model.weights])) + model.intercept
        return rows.withColumn(out, 1 / (1 + F.exp(-z)))
    scored = model.transform(rows.withColumn("label", F.col("label").cast("double")))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    ).withColumn("label", F.col("label").cast("int"))


def out_of_fold(rows: DataFrame, features: str, seed: int, folds: int = FOLDS, id_col: str = "id") -> DataFrame:
    """``score`` of every row from a linear model that has not seen its fold (hash of the id)."""
    fold = F.floor(uniform(F.col(id_col), seed, "fold") * folds).cast("int")
    placed = stored(rows.withColumn("_fold", fold), "folds")
    parts = []
    for k in range(folds):
        model = fit_linear(placed.filter(F.col("_fold") != k), features)
        parts.append(predict(model, placed.filter(F.col("_fold") == k)))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored.drop("_fold")


def noise_counts(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group and given ``label``: rows ``n``, those confidently of this class ``kept`` and of the other one ``moved``,
    and ``prune``, how many are wrong by the calibrated joint counts.

    A class's threshold is the mean probability it gets among rows carrying its label; a row is confidently of the class
    at or above its threshold, of the likelier one where it reaches both. Counts of confident rows are scaled to
    the rows of the label; at least one row stays.
    """
    p, other = F.col("score"), 1 - F.col("score")
    limits = scored.groupBy(*keys).agg(
        F.avg(F.when(F.col("label") == 1, p)).alias("_pos"), F.avg(F.when(F.col("label") == 0, other)).alias("_neg")
    )
    limits = limits.select(*keys, F.struct("_pos", "_neg").alias("_limits"))
    # one row a group; without keys a single one
    marked = scored.join(F.broadcast(limits), list(keys)) if keys else scored.withColumn("_limits", limits.select("_limits").scalar())
    sure_pos, sure_neg = p >= F.col("_limits._pos"), other >= F.col("_limits._neg")
    likely = F.when(sure_pos & sure_neg, (p > 0.5).cast("int")).when(sure_pos, 1).when(sure_neg, 0)
    counts = marked.withColumn("_likely", likely).groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(F.count(F.when(F.col("_likely") == F.col("label"), 1)), F.lit(1)).alias("kept"),
        F.count(F.when(F.col("_likely") == 1 - F.col("label"), 1)).alias("moved"),
    )
    share = F.bround(F.col("n") * F.col("moved") / (F.col("kept") + F.col("moved"))).cast("long")
    return counts.withColumn("prune", F.least(share, F.col("n") - 1))


def label_issues(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``issue``: the rows whose label is in doubt, pruned by noise rate.

    Of every label, as many rows as ``noise_counts`` finds wrong go: those with the largest margin of the other class
    over the given one, with all that tie with the last of them. A row stays where its label is the likelier class. The cut
    comes from counts of distinct margins, so rows are not ranked and ties do not travel.
    """
    counts = stored(noise_counts(scored, keys), "noise")
    margin = F.when(F.col("label") == 1, 1 - 2 * F.col("score")).otherwise(2 * F.col("score") - 1)
    marked = scored.withColumn("_fall", -margin)
    per_margin = marked.groupBy(*keys, "label", "_fall").agg(F.count(F.lit(1)).alias("_rows"))
    running = prefix_sums(per_margin, [*keys, "label"], ["_fall"], {"_upto": F.col("_rows")})
    cuts = running.join(F.broadcast(counts.select(*keys, "label", "prune")), [*keys, "label"])
    cuts = cuts.filter(F.col("_upto") - F.col("_rows") < F.col("prune")).groupBy(*keys, "label").agg(F.max("_fall").alias("_cut"))
    placed = marked.join(F.broadcast(cuts), [*keys, "label"], "left")
    against = (F.col("score") > 0.5).cast("int") != F.col("label")
    return placed.withColumn("issue", F.coalesce((F.col("_fall") <= F.col("_cut")) & against, F.lit(False))).drop("_fall", "_cut")


def fit_cleaned(rows: DataFrame, features: str, seed: int, id_col: str = "id"):
    """Linear model refitted without the rows whose label is in doubt."""
    marked = label_issues(stored(out_of_fold(rows, features, seed, id_col=id_col), "out-of-fold"))
    return fit_linear(marked.filter(~F.col("issue")).drop("score", "issue"), features)


def score_methods(
    train: DataFrame,
    test: DataFrame,
    seed: int,
    methods: Sequence[str] = tuple(METHODS),
    trees: int | None = None,
    id_col: str = "id",
    workers: int = 1,
) -> DataFrame:
    """Test rows scored by each method: ``method, id, label, score``.

    ``trees`` is the number of boosted trees, ``TREES`` unless given. Methods are fitted side by side by ``workers`` threads; each
    fit and each scoring is a distributed job. Fits pass over the training rows many times and every method scores the test
    rows, so both are written to the shared folder once and read from there.
    """
    ensure_checkpoint_dir(train.sparkSession)
    fit_rows = stored(feature_sets(train), "train")
    test_rows = stored(feature_sets(test), "test")

    def one(name: str) -> DataFrame:
        kind, features = METHODS[name]
        if kind == "trees":
            model = fit_trees(fit_rows, features, seed, trees or TREES)
        elif kind == "linear":
            model = fit_linear(fit_rows, features)
        else:
            model = fit_cleaned(fit_rows, features, seed, id_col)
        return predict(model, test_rows).select(
            F.lit(name).alias("method"), F.col(id_col).cast("string").alias("id"), "label", "score"
        )

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(one, methods))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def method_table(scored: DataFrame, keys: Sequence[str], ks: Sequence[float] = LIFT_KS) -> DataFrame:
    """Wide metrics row per group: AUC and every metric at every K."""
    auc = roc_auc(scored, keys).select(*keys, "auc")
    return auc.join(lift_table(scored, keys, ks), list(keys))
