"""Splits, labelled sets and ranking metrics per ``(seed, negatives, flag, T, method)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import f1_score, hypergeometric_confidence, ratio_or_zero
from ..session import stored
from .ordered import ROWS_PER_CHUNK, prefix_sums, shuffle_rank

# Fixed values.
LIFT_KS = (1, 2, 3, 4, 5, 10, 20)
CURVE_KS = (*[0.1 + i * 0.1 for i in range(30)], *[float(k) for k in range(4, 101)])
MIN_TRAIN_ROWS, MIN_TRAIN_POSITIVES = 50, 10
RUN_KEYS = ("seed", "negatives_in_training", "flag", "T")


def train_val_split(accounts: DataFrame, seed: int, train_share: float = 0.9, id_col: str = "account_id") -> DataFrame:
    """Add ``split``: a seeded shuffle cut at ``int(train_share * n)``."""
    ranked = shuffle_rank(accounts, [], [id_col], seed, "_rank", "_n")
    cut = F.floor(F.col("_n") * F.lit(train_share))
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("val")).drop("_rank", "_n")


def train_test_split(
    accounts: DataFrame, seeds: Sequence[int], test_size: float = 0.3, id_col: str = "account_id"
) -> DataFrame:
    """Per seed: ``split``, and ``train_rank``/``n_train`` in the seeded order of the train part."""
    per_seed = accounts.select(id_col, F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    ranked = shuffle_rank(per_seed, ["seed"], [id_col], F.col("seed"), "_rank", "_n")
    n_train = F.col("_n") - F.ceil(F.col("_n") * F.lit(test_size))
    train = F.col("_rank") <= n_train
    return ranked.select(
        id_col, "seed",
        F.when(train, "train").otherwise("test").alias("split"),
        F.when(train, F.col("_rank")).alias("train_rank"),
        n_train.alias("n_train"),
    )


def drawn_at(size: Column | int) -> Column:
    """Whether a train account is among the negatives drawn at ``size``; sizes up to 0 draw all. Draws are the first
    places of one seeded order, so a size is a threshold and needs no copy of the rows."""
    size = F.lit(int(size)) if isinstance(size, int) else size
    return (size <= 0) | (F.col("n_train") <= size) | (F.col("train_rank") <= size)


def _sizes_drawn(sizes: Sequence[int]) -> Column:
    return F.filter(F.array(*[F.lit(int(s)) for s in sizes]), drawn_at)


def subsample_negatives(split: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Train accounts kept per ``negatives_in_training`` size; -1 keeps all."""
    kept = split.filter(F.col("split") == "train")
    return kept.select("*", F.explode(_sizes_drawn(sizes)).alias("negatives_in_training"))


def flag_list(events: DataFrame) -> Column:
    """All flags as one array; their number is bounded by the category table."""
    return events.agg(F.array_sort(F.collect_set("flag"))).scalar()


def account_flags(events: DataFrame) -> DataFrame:
    """``account_id, flags``: the sorted flags of every account that has any."""
    return events.groupBy("account_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def with_flags(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Each row with the flags of its account, an empty array where it has none."""
    none = F.array().cast("array<string>")
    return rows.join(account_flags(events), "account_id", "left").withColumn("flags", F.coalesce("flags", none))


def negatives_per_flag(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Each row once per flag its account does not have."""
    spread = F.explode(F.array_except(flag_list(events), "flags")).alias("flag")
    return with_flags(rows, events).select(*rows.columns, spread)


def key_sets(split: DataFrame, positives: DataFrame, negatives: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every run is chosen from, one row per account, seed and horizon (and flag, for positives).

    ``candidates`` may be negatives and carry the flags that they must not be tested for; ``known`` are positives. Both
    have ``split``, ``train_rank`` and ``n_train``, so a run is a filter over them (``of_run``), and nothing is repeated for
    flags or sizes.
    """
    candidates = with_flags(split.join(negatives, "account_id"), events)
    return candidates, split.join(positives, "account_id")


def usable_runs(
    candidates: DataFrame,
    known: DataFrame,
    sizes: Sequence[int],
    min_rows: int = MIN_TRAIN_ROWS,
    min_positives: int = MIN_TRAIN_POSITIVES,
) -> DataFrame:
    """``seed, negatives_in_training, flag, T, n, n_pos`` of the runs whose training set is large enough.

    A run's negatives are all that are drawn less those that have the flag; both are counted per size in one pass, and
    only the flags that accounts have are spread.
    """
    counts = [F.count(F.when(drawn_at(s), 1)).alias(f"_n{i}") for i, s in enumerate(sizes)]
    names = [f"_n{i}" for i in range(len(sizes))]
    train = candidates.filter("split = 'train'")
    drawn = train.groupBy("seed", "T").agg(*counts)
    flagged = train.withColumn("flag", F.explode("flags")).groupBy("seed", "T", "flag").agg(*counts)
    flagged = flagged.withColumnsRenamed({n: f"{n}f" for n in names})
    found = known.filter("split = 'train'").groupBy("seed", "T", "flag").agg(F.count(F.lit(1)).alias("n_pos"))
    per_size = F.array(
        *[
            F.struct(F.lit(int(s)).alias("size"), (F.coalesce(n, F.lit(0)) - F.coalesce(f"{n}f", F.lit(0))).alias("n_neg"))
            for s, n in zip(sizes, names)
        ]
    )
    both = found.join(drawn, ["seed", "T"], "left").join(flagged, ["seed", "T", "flag"], "left")
    rows = both.select("seed", "flag", "T", "n_pos", F.inline(per_size)).select(
        "seed", F.col("size").alias("negatives_in_training"), "flag", "T", (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos"
    )
    return rows.filter((F.col("n") >= min_rows) & (F.col("n_pos") >= min_positives))


def of_run(candidates: DataFrame, known: DataFrame, seed: int, flag: str, horizon: int, size: int | None) -> DataFrame:
    """The labelled rows of one run: its training rows, or with ``size`` None the test rows."""
    part = "test" if size is None else "train"
    here = (F.col("seed") == seed) & (F.col("T") == horizon) & (F.col("split") == part)
    negative = here & ~F.array_contains("flags", flag)
    if size is not None:
        negative = negative & drawn_at(size)
    pos = known.filter(here & (F.col("flag") == flag)).withColumn("label", F.lit(1)).drop("flag")
    return pos.unionByName(candidates.filter(negative).drop("flags").withColumn("label", F.lit(0)))


def training_rows(
    split: DataFrame,
    positives: DataFrame,
    negatives: DataFrame,
    events: DataFrame,
    sizes: Sequence[int],
    min_rows: int = MIN_TRAIN_ROWS,
    min_positives: int = MIN_TRAIN_POSITIVES,
) -> DataFrame:
    """Labelled training keys of all runs in one table, without runs that are too small.

    ``positives`` are ``(account_id, flag, T)`` and ``negatives`` ``(account_id, T)`` with a usable
    cutoff. Negatives are drawn before accounts that have the flag are taken out. The key sets are written to
    the shared folder once; a row is only repeated for the runs that it is in.
    """
    candidates, known = (stored(k, "keys") for k in key_sets(split, positives, negatives, events))
    runs = usable_runs(candidates, known, sizes, min_rows, min_positives)
    # at most seeds x sizes x horizons x flags entries, all of them lists of settings
    runs = stored(runs.select(*RUN_KEYS, "n", "n_pos"), "runs")
    per_seed = runs.groupBy("seed", "T").agg(F.collect_list(F.struct("negatives_in_training", "flag")).alias("_runs"))
    train = candidates.filter("split = 'train'").join(F.broadcast(per_seed), ["seed", "T"])
    mine = F.filter("_runs", lambda r: drawn_at(r["negatives_in_training"]) & ~F.array_contains("flags", r["flag"]))
    neg = train.select("account_id", "seed", "T", F.inline(mine)).withColumn("label", F.lit(0))
    pos = known.filter("split = 'train'").join(F.broadcast(runs), ["seed", "T", "flag"]).withColumn("label", F.lit(1))
    columns = ["account_id", "seed", "negatives_in_training", "flag", "T", "label"]
    return pos.select(*columns).unionByName(neg.select(*columns))


def test_rows(split: DataFrame, positives: DataFrame, negatives: DataFrame, events: DataFrame) -> DataFrame:
    """Labelled test keys per ``(seed, flag, T)``: every test account, positives at their event."""
    candidates, known = key_sets(split.filter("split = 'test'"), positives, negatives, events)
    columns = ["account_id", "seed", "flag", "T", "label"]
    neg = candidates.withColumn("flag", F.explode(F.array_except(flag_list(events), "flags"))).withColumn("label", F.lit(0))
    return known.withColumn("label", F.lit(1)).select(*columns).unionByName(neg.select(*columns))


def class_weights(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class counts, ``scale_pos_weight`` and the balanced weight of each class."""
    counts = rows.groupBy(*keys).agg(
        F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg")
    )
    total = F.col("n_pos") + F.col("n_neg")
    return counts.withColumns(
        {
            "scale_pos_weight": F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0)),
            "weight_pos": F.when(F.col("n_pos") > 0, total / (2 * F.col("n_pos"))),
            "weight_neg": F.when(F.col("n_neg") > 0, total / (2 * F.col("n_neg"))),
        }
    )


def _depth(n: Column, k: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * k / F.lit(100.0)).cast("long"))


def ranked_scores(scored: DataFrame, keys: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Place by falling score (ties by id), positives so far, and the group's totals."""
    return prefix_sums(
        scored.select(*keys, "id", "label", (-F.col("score")).alias("_fall")),
        keys,
        ["_fall", "id"],
        {"rank": F.lit(1).cast("long"), "found": F.col("label").cast("long")},
        rows_per_chunk=rows_per_chunk,
        totals={"n_total": "rank", "n_pos": "found"},
    )


def top_share(scored: DataFrame, keys: Sequence[str], k_pct: float) -> DataFrame:
    """The rows in the top ``k_pct`` percent of each group."""
    ranked = ranked_scores(scored, keys)
    return ranked.filter(F.col("rank") <= _depth(F.col("n_total"), F.lit(float(k_pct))))


def metrics_at(
    scored: DataFrame, keys: Sequence[str], ks: Sequence[float], rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """One row per group and K %: depth, positives found, lift, confidence, recall, precision, F1.

    The running count of positives at place ``depth`` is the answer, so each K picks one row of
    the ranked group and nothing is aggregated per K.
    """
    grid = F.array(*[F.lit(float(k)) for k in ks])
    ranked = ranked_scores(scored, keys, rows_per_chunk)
    hits = ranked.withColumn(
        "k_pct", F.explode(F.filter(grid, lambda k: _depth(F.col("n_total"), k) == F.col("rank")))
    )
    any_pos = F.col("n_pos") > 0
    num = lambda c: F.when(any_pos, c).otherwise(F.lit(0.0))
    base = F.col("n_pos") / F.col("n_total")
    precision = F.col("found") / F.col("rank")
    recall = ratio_or_zero(F.col("found"), F.col("n_pos"))
    return hits.select(
        *keys, "k_pct", "n_total", "n_pos",
        base.alias("prevalence"),
        F.when(any_pos, F.col("rank")).otherwise(F.lit(0)).alias("depth"),
        F.when(any_pos, F.col("found")).otherwise(F.lit(0)).alias("n_found"),
        num(precision / base).alias("lift"),
        num(recall).alias("recall"),
        num(precision).alias("precision"),
        num(f1_score(precision, recall)).alias("f1"),
        hypergeometric_confidence(F.col("found"), F.col("n_total"), F.col("n_pos"), F.col("rank")).alias("confidence"),
    )


def lift_table(scored: DataFrame, keys: Sequence[str], ks: Sequence[float] = LIFT_KS) -> DataFrame:
    """Wide metrics row per group: ``lift_5``, ``conf_5``, ... for every K."""
    long = metrics_at(scored, keys, ks)
    names = {
        "lift": "lift", "conf": "confidence", "recall": "recall", "precision": "precision", "f1": "f1",
        "n_found": "n_found", "depth": "depth",
    }
    picks = [
        F.max(F.when(F.col("k_pct") == float(k), F.col(col))).alias(f"{short}_{k:g}")
        for short, col in names.items()
        for k in ks
    ]
    return long.groupBy(*keys).agg(
        F.first("n_pos").alias("n_pos"), F.first("n_total").alias("n_total"),
        F.first("prevalence").alias("prevalence"), *picks,
    )


def granular_curve(scored: DataFrame, keys: Sequence[str], hard_positive: bool = True) -> DataFrame:
    """127 points per group from 0.1 % to 100 %; nothing for a group without positives."""
    rows = metrics_at(scored, keys, CURVE_KS).filter(F.col("n_pos") > 0)
    return rows.withColumnsRenamed({"n_found": "n_pos_at_k", "n_pos": "n_pos_total"}).withColumn(
        "hard_positive", F.lit(hard_positive)
    )


def roc_auc(scored: DataFrame, keys: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Exact AUC with tied scores averaged; 0.5 when a class is missing.

    Rows are first counted per distinct score (map-side), so ties never travel.
    """
    per_score = scored.groupBy(*keys, "score").agg(
        F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("q")
    )
    running = prefix_sums(
        per_score, keys, ["score"], {"cum_neg": F.col("q")}, rows_per_chunk=rows_per_chunk
    )
    below = F.col("cum_neg") - F.col("q") / 2
    return running.groupBy(*keys).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * below).alias("_wins")
    ).select(
        *keys, "n_pos", "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_wins") / (F.col("n_pos") * F.col("n_neg")))
        .otherwise(F.lit(0.5)).alias("auc"),
    )


def seed_means(metrics: DataFrame, values: Sequence[str] = ("auc", "lift_5", "lift_10")) -> DataFrame:
    """Average over seeds and negative sizes per flag, horizon and method."""
    return metrics.groupBy("flag", "T", "method").agg(*[F.avg(v).alias(v) for v in values])
