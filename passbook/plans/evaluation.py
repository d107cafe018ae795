"""Evaluation of embeddings at points in time, over seeds, negative sizes, flags and horizons, as one job.

Keys and vectors are joined once and written by seed and horizon; a run reads its rows from there with a filter. Runs are
fitted and scored side by side by a bounded number of threads, each submitting Spark jobs. A run's scores are
written as soon as they are there, with an entry in the manifest, so a job that was stopped goes on with the runs that
are missing. Metrics are cheap next to fits: one plan makes those of all runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import RUN_KEYS, key_sets, of_run, train_test_split, usable_runs
from ..operators.models import METHODS, TREES, method_table, score_methods
from ..session import scratch_path, stored
from ..sources.manifest import Manifest, run_stage, settings_print
from ..sources.sinks import save_table

#: Runs fitted side by side; files that the rows of one seed and horizon are dealt to.
WORKERS, SPREAD = 4, 64


def evaluation_rows(
    split: DataFrame, positives: DataFrame, negatives: DataFrame, events: DataFrame, out: str, settings: object = None
) -> tuple[DataFrame, DataFrame]:
    """``(candidates, known)`` of all runs with their vectors, written under ``out`` by seed and horizon.

    ``positives`` are ``(account_id, flag, T, embedding, features)`` and ``negatives``
    ``(account_id, T, embedding, features)``. A vector is written once for each seed, not for each flag, size or
    method. Tables that an earlier call finished from the same rows are read again.
    """
    sources, tables = (split, positives, negatives, events), []
    for name, rows in zip(("candidates", "known"), key_sets(split, positives, negatives, events)):
        dealt = rows.repartition("seed", "T", F.pmod(F.xxhash64("account_id"), F.lit(SPREAD)))
        run_stage(sources, f"{out}/{name}", lambda dealt=dealt: dealt, settings, ("seed", "T"))
        tables.append(split.sparkSession.read.schema(rows.schema).parquet(f"{out}/{name}"))
    return tables[0], tables[1]


def run_name(run) -> str:
    return "|".join(str(run[k]) for k in RUN_KEYS)


def run_evaluation(
    accounts: DataFrame,
    positives: DataFrame,
    negatives: DataFrame,
    events: DataFrame,
    seeds: Sequence[int] = (42,),
    sizes: Sequence[int] = (1000, 2000, 5000, 10000, -1),
    test_size: float = 0.3,
    methods: Sequence[str] = tuple(METHODS),
    trees: int = TREES,
    min_rows: int = 50,
    min_positives: int = 10,
    out: str | None = None,
    workers: int = WORKERS,
    score=score_methods,
) -> DataFrame | None:
    """One metrics row per run and method, or None when no run is large enough.

    ``out`` is where rows, scores, metrics and manifests go; without it the job is not resumable. Only the list of runs (a
    handful of rows) reaches the driver. ``score`` scores the test rows of a run: ``(train, test, seed, methods, trees)``
    to ``method, id, label, score``.
    """
    spark = accounts.sparkSession
    out = out or scratch_path(spark, "evaluation")
    split = train_test_split(accounts, seeds, test_size)
    candidates, known = evaluation_rows(stored(split, "split"), positives, negatives, events, out, [list(seeds), test_size])
    runs = usable_runs(candidates, known, sizes, min_rows, min_positives).orderBy(*RUN_KEYS).collect()
    if not runs:
        return None
    manifest, made_of = Manifest(spark, f"{out}/scores"), Manifest(spark, f"{out}/candidates").entries()
    prints = {run_name(r): settings_print([made_of, r.n, r.n_pos, list(methods), trees]) for r in runs}
    missing = set(manifest.open_names(prints))
    place = lambda run: f"{out}/scores/{hashlib.md5(run_name(run).encode()).hexdigest()}"

    def one(run) -> None:
        mine = of_run(candidates, known, run.seed, run.flag, run["T"], run.negatives_in_training)
        theirs = of_run(candidates, known, run.seed, run.flag, run["T"], None)
        wanted = ["account_id", "label", "embedding", "features"]
        train, test = (rows.select(*wanted, F.col("account_id").alias("id")) for rows in (mine, theirs))
        scored = score(train, test, run.seed, methods, trees).select("method", "id", "label", "score")
        scored.withColumns({k: F.lit(run[k]) for k in RUN_KEYS}).write.mode("overwrite").parquet(place(run))
        manifest.finish({run_name(run): prints[run_name(run)]})

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, [r for r in runs if run_name(r) in missing]))
    save_table(method_table(spark.read.parquet(*map(place, runs)), [*RUN_KEYS, "method"]), f"{out}/metrics")
    return spark.read.parquet(f"{out}/metrics")
