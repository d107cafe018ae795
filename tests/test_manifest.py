"""Finished, half-written and outdated output."""

from pyspark.sql import functions as F

from passbook.operators.keys import column_report
from passbook.plans.dataset import build_flag_examples
from passbook.sources import manifest as M

TXN = "id string, accountId string, date date, amount double, direction string, subCategoryId string"


def test_fingerprints_follow_rows_and_settings(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, "b", None)], "i int, s string, m map<string,int>")
    first = M.fingerprint(df, {"n": 1})
    assert first == M.fingerprint(df.repartition(3).orderBy(F.desc("i")), {"n": 1})
    changed = [df.limit(1), df.union(df.limit(1)), df.withColumn("s", F.upper("s")), df.withColumnRenamed("s", "t")]
    assert len({first, M.fingerprint(df, {"n": 2}), *(M.fingerprint(c, {"n": 1}) for c in changed)}) == 6


def test_a_stage_is_rebuilt_when_it_has_to_be(spark, tmp_path):
    path, source = str(tmp_path / "out"), spark.range(5)
    go = lambda df=source, settings=None: M.run_stage([df], path, lambda: df, settings)
    assert [go(), go(), go(spark.range(6)), go(spark.range(6), "x"), go(spark.range(6), "x")] == [True, False, True, True, False]
    M.remove(spark, M.Manifest(spark, path).root)
    assert go(spark.range(6), "x") and spark.read.parquet(path).count() == 6


def _flag_rows(spark):
    rows = []
    for account, days in (("a|b", 12), ("c", 12), ("d", 2)):
        rows += [(f"{account}{d}", account, f"2024-01-{d:02d}", -1.0 * d, "D", "x") for d in range(1, days + 1)]
    names = "id string, accountId string, date string, amount double, direction string, subCategoryId string"
    return spark.createDataFrame(rows, names).withColumn("date", F.to_date("date"))


def test_flags_with_odd_names_resume_and_empty_ones_are_finished(spark, tmp_path):
    """Bars, blanks and slashes in flags and ids; one flag has no account with enough days."""
    root, out = str(tmp_path / "flags"), str(tmp_path / "examples")
    rows = _flag_rows(spark)
    flagged = rows.filter("accountId != 'd'").withColumn("flag", F.lit("one|x y/z"))
    short = rows.filter("accountId = 'd'").withColumn("flag", F.lit("short"))
    for part in (flagged, short):
        part.write.mode("append").partitionBy("flag").parquet(root)
    vocab = spark.createDataFrame([("cat_sub", "x", 2)], "feature string, token string, token_id int")
    go = lambda least=9: build_flag_examples(root, out, None, vocab, min_days=least)
    assert go() == ["one|x y/z", "short"] and go() == []
    read = lambda: sorted((r.flag, r.account_id, r.n_days) for r in spark.read.parquet(out).collect())
    want = [("one|x y/z", "a|b", 12), ("one|x y/z", "c", 12)]
    assert read() == want
    # output without an entry is half-written
    M.remove(spark, f"{M.Manifest(spark, out)._place('one|x y/z')}")
    assert go() == ["one|x y/z"] and read() == want
    assert go(1) == ["one|x y/z", "short"] and read() == [*want, ("short", "d", 2)]
    # what a flag no longer has goes
    assert go(9) == ["one|x y/z", "short"] and read() == want


def test_column_report(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    got = column_report({"t": (df, ["a", "b", "c", "c"]), "u": (df.limit(0), ["a"])}).collect()
    assert {tuple(r) for r in got} == {("t", "b", "empty", 2, 0), ("t", "c", "absent", 2, 0), ("u", "a", "empty", 0, 0)}
