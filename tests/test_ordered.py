"""Chunked running totals and ranks against brute force, with a group that owns most rows."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from passbook.operators.ordered import prefix_sums, rank_rows, shuffle_rank, with_chunks


def _rows(seed=1, n=600):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", f"{i:05d}", rng.randrange(4), float(rng.randrange(-50, 50))) for i in range(n)]


@pytest.mark.parametrize("per_chunk", [1, 7, 50, 1_000_000])
def test_prefix_sums_equal_brute_force(spark, per_chunk):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, id string, day int, x double")
    got = {
        r.id: (r.run, r.total)
        for r in prefix_sums(df, ["k"], ["id"], {"run": F.col("x")}, ["day"], per_chunk, totals={"total": "run"}).collect()
    }
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        sums = list(accumulate(r[3] for r in mine))
        for r, s in zip(mine, sums):
            want[r[1]] = (s, sums[-1])
    assert got == want


def test_hot_group_is_cut_and_small_groups_are_not(spark):
    df = spark.createDataFrame(_rows(n=2000), "k string, id string, day int, x double")
    sizes = with_chunks(df, ["k"], ["id"], 100).groupBy("k", "_chunk").count().collect()
    hot = [r["count"] for r in sizes if r.k == "hot"]
    assert len(hot) > 5 and max(hot) < 700


def test_global_rank_without_keys(spark):
    df = spark.createDataFrame([(f"{i * 37 % 101:03d}",) for i in range(101)], "t string")
    got = {r.t: r["rank"] for r in rank_rows(df, [], ["t"], rows_per_chunk=5).collect()}
    assert got == {f"{i:03d}": i + 1 for i in range(101)}


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_shuffle_rank_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).withColumn("g", F.col("id") % 2).repartition(int(partitions))
        rows = shuffle_rank(df, ["g"], ["id"], 9, size_name="n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in (0, 1):
        mine = sorted(((r["rank"], r.id) for r in rows if r.g == g))
        assert [m[0] for m in mine] == list(range(1, 251))
    assert {r.n for r in rows} == {250}
    import hashlib

    want = sorted(range(0, 500, 2), key=lambda i: hashlib.md5(f"{i}|9".encode()).hexdigest())
    assert [i for _, i in sorted((r["rank"], r.id) for r in rows if r.g == 0)] == want
