"""Plan checks: no Cartesian products, early group limits, pushed-down columns and filters."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from passbook import session
from passbook.operators import balance as B
from passbook.operators import clean as C
from passbook.operators import evaluate as E
from passbook.operators import examples as X
from passbook.operators import ordered as O
from passbook.operators.ordered import rank_rows, with_chunks
from passbook.plans import evaluation as J
from passbook.plans import views as V
from passbook.workload import evaluation as W


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


HEADLINE = [
    "daily_balances", "running_balance", "rolling_balance_features", "balance_window_stats",
    "starting_balance_as_of", "detect_emerging", "detect_skipped_payment", "label_summary_by_bank",
    "vocabulary", "top_of_stream_arrival", "training_rows", "lift_table", "roc_auc", "negatives_per_flag",
]


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["running_balance", "rolling_balance_features", "examples_arrival"])
def test_windows_are_partitioned(spark, sf_dir, name):
    """The only single-partition exchanges feed global aggregates, never a window."""
    lines = plan_of(queries()[name](spark, sf_dir)).splitlines()
    for above, line in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[]" in above or "SortAggregate(key=[]" in above, above


def test_group_limit_runs_before_the_shuffle(spark, sf_dir):
    t = V.txn_short(spark, sf_dir)
    for df in (X.top_of_stream(t, 20), C.dedupe_by(t, ["id"], ["date"]), B.latest_snapshot(V.acct(spark, sf_dir))):
        plan = plan_of(df)
        assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_scan_reads_only_needed_columns_and_pushes_the_cutoff(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_shipdate", "date")
    plan = plan_of(C.before_cutoff(li, "1998-01-01").groupBy("l_suppkey").agg(F.sum("l_quantity")))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate" in plan
    assert "LessThan(l_shipdate" in plan


def test_chunk_cuts_never_move_rows_by_the_group_alone(spark, sf_dir):
    """The input is a join and one group holds most rows: its rows are dealt by group and salt or chunk, its marks alone
    by group."""
    rows = V.txn_long(spark, sf_dir).join(V.acct(spark, sf_dir).select("accountId", "type"), "accountId")
    skewed = rows.withColumn("group", F.when(F.hash("id") % 10 == 0, F.col("type")).otherwise("hot"))
    for df in (with_chunks(skewed, ["group"], ["date", "id"]), rank_rows(skewed, ["group"], ["date", "id"])):
        lines = plan_of(df).splitlines()
        for line, below in zip(lines, lines[1:]):
            if "Exchange hashpartitioning(group" in line and "_salt" not in line and "_chunk" not in line:
                assert "partial_collect_set" in below or "partial_sum" in below or "HashAggregate" in below, (line, below)
    ranks = [r["rank"] for r in rank_rows(skewed, ["group"], ["date", "id"], rows_per_chunk=50).filter("group = 'hot'").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def counted(monkeypatch, build):
    """How often ``build`` reads each test table, in the jobs it starts and in the plan it returns."""
    files, stored = [], session.stored

    def watched(df, name):
        files.append(plan_of(df))
        return stored(df, name)

    for module in (B, E, O, W, J):
        monkeypatch.setattr(module, "stored", watched)
    files.append(plan_of(build()))
    return lambda name: sum(p.count(f"/{name}.parquet") for p in files)


@pytest.mark.parametrize(
    "name,table,most",
    [
        ("daily_balances", "orders", 1), ("running_balance", "orders", 1), ("historical_sums", "orders", 1),
        ("starting_balance_as_of", "orders", 3), ("balance_window_stats", "orders", 3), ("rolling_balance_features", "events", 2),
        ("training_rows", "orders", 1), ("test_rows", "orders", 1), ("evaluation_rows", "orders", 1),
    ],
)
def test_tables_are_read_once(spark, sf_dir, monkeypatch, name, table, most):
    """The ledger is read once. Probes are made of the same table here and read twice, to ask and to answer; so are the
    accounts of the events."""
    scans = counted(monkeypatch, lambda: queries()[name](spark, sf_dir))
    assert 1 <= scans(table) <= most
