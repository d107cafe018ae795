import datetime as dt

import pytest

from passbook.operators import clean as C
from passbook.plans.dataset import build_dataset
from passbook.plans.labels import generate_labels
from passbook.sources import categories as cat
from passbook.sources import sinks as S
from passbook.sources import tables as T


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_keeps_ids_as_text_and_nulls_missing(spark, tmp_path):
    path = _write(tmp_path / "t.csv", '"id","accountId","transactionDate","transactionAmount","deviceId"\n"001","7","2024-01-02","-3.5","NA"\n"002","","2024-01-03","","nan"\n')
    rows = T.load_transactions(spark, path).orderBy("id").collect()
    assert (rows[0].id, rows[0].date, rows[0].amount, rows[0].deviceId) == ("001", dt.datetime(2024, 1, 2), -3.5, None)
    assert rows[1].accountId is None and rows[1].amount is None


def test_strict_and_lenient_dates(spark, tmp_path):
    path = _write(tmp_path / "t.csv", '"id","accountId","user_name","date"\n"1","a","u","2024-01-02"\n"2","a","u","soon"\n"1","a","u","2024-01-02"\n')
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        T.load_transactions(spark, path).collect()
    rows = T.load_label_transactions(spark, path).orderBy("id").collect()
    assert [(r.id, r.date is None) for r in rows] == [("1", False), ("2", True)]


def test_two_banks_with_colliding_ids(spark, tmp_path):
    head = '"id","accountId","date","amount"\n'
    body = "".join(f'"{i}","{i % 2}","2024-01-0{i + 1}","1"\n' for i in range(4))
    a, b = _write(tmp_path / "a.csv", head + body), _write(tmp_path / "b.csv", head + body)
    acc = _write(tmp_path / "acc.csv", '"account_id","type"\n"1","Checking"\n')
    odd = _write(tmp_path / "odd.csv", '"holder","type"\n"1","Checking"\n')
    banks = [{"name": "BankA", "txn_file": a, "acc_file": acc}, {"name": "BankB", "txn_file": b, "acc_file": odd}]
    txns, accounts = T.load_joint_bank_data(spark, banks)
    assert txns.count() == 8 and {"BankA_1", "BankB_1"} <= {r.accountId for r in txns.collect()}
    assert [r.accountId for r in accounts.collect()] == ["BankA_1"]
    assert T.load_joint_bank_data(spark, banks, "2024-01-03")[0].count() == 4
    banks[0]["cutoff_date"] = "2024-01-02"
    assert T.load_joint_bank_data(spark, banks, "2024-01-03")[0].count() == 3


def test_line_breaks_inside_quotes(spark, tmp_path):
    acc = _write(tmp_path / "acc.csv", '"id","name","balance"\n"1","two\nlines","3.5"\n"2","one","4"\n')
    got = T.load_accounts(spark, acc, line_breaks=True).orderBy("id").collect()
    assert [(r.id, r.name, r.balance) for r in got] == [("1", "two\nlines", 3.5), ("2", "one", 4.0)]
    txn = _write(tmp_path / "t.csv", '"id","accountId","description","date","amount"\n"7","1","a\nb","2024-01-02","5"\n')
    banks = [{"name": "B", "txn_file": txn, "acc_file": acc}]
    txns, accounts = T.load_joint_bank_data(spark, banks, line_breaks=True)
    assert [(r.accountId, r.description, r.amount) for r in txns.collect()] == [("B_1", "a\nb", 5.0)]
    assert sorted(r.accountId for r in accounts.collect()) == ["B_1", "B_2"]


def test_consolidation_filters(spark):
    schema = "id string, accountId string, amount double, status string, isForeignCurrency boolean"
    rows = [("1", "a", 1.0, "Cleared", None), ("2", "a", 0.0, "Cleared", False), ("3", "a", None, "Cleared", False), ("4", "a", 1.0, "Pending", False), ("5", "a", 1.0, "Cleared", True)]
    df = spark.createDataFrame(rows, schema)
    out = T.consolidate_transactions({"X": df, "Y": df.drop("status")}).collect()
    assert sorted(r.id for r in out) == ["X_1", "X_3"] and {r.bank for r in out} == {"X"}
    assert out[0].original_id in ("1", "3") and out[0].accountId == "X_a"
    acc = spark.createDataFrame([("1", "Checking")], "id string, type string")
    got = T.consolidate_accounts({"X": acc}).first()
    assert (got.id, got.original_id, got.currency) == ("X_1", "1", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "b1")], "flag_name string, bank string")
    assert S.write_flags(df, str(tmp_path / "f")) and not S.write_flags(df.limit(0), str(tmp_path / "g"))
    assert not (tmp_path / "g").exists()
    S.save_metrics(df, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("part-*"))) == 1
    S.write_examples(spark, df, str(tmp_path / "e"), {"max_days": 3})
    assert spark.read.json(str(tmp_path / "e_metadata")).first().max_days == 3


def test_categories_from_yaml(spark, tmp_path):
    path = _write(tmp_path / "c.yaml", "categories:\n  C1:\n    name: One\n    group: G\n    group_name: Group\n  C2:\n    group: H\n")
    rows = {r.subcategory_id: r for r in cat.categories_from_yaml(spark, path).collect()}
    assert rows["C1"].name == "One" and rows["C2"].name == "C2" and rows["C2"].group_id == "H"
    assert cat.default_categories(spark).count() == 28


def test_aliases(spark):
    df = spark.createDataFrame([("g", "s", 1.0)], "vendorCategoryGroupId string, p_subCategoryId string, amount double")
    assert C.find_column(df, C.ALIASES["categoryGroupId"]) == "vendorCategoryGroupId"
    assert C.find_column(df, C.ALIASES["subCategoryId"]) == "p_subCategoryId"
    assert C.find_column(df, C.ALIASES["counterParty"]) is None
    patched = C.patch_schema(spark.createDataFrame([("t", 100.0)], "trId string, amount double")).first()
    assert (patched.id, patched.direction) == ("t", "Credit")


def test_label_run_and_dataset_run(spark):
    schema = "id string, accountId string, user_name string, date date, amount double, direction string, categoryGroupId string, subCategoryId string, patternId string, deviceId string, bank string"
    rows = []
    for m in range(1, 13):
        rows.append((f"{m}", "A", "u", dt.date(2023, m, 1), -10.0, "D", "CG1", "other", "P", "d", "B"))
        if m >= 6:
            rows.append((f"s{m}", "A", "u", dt.date(2023, m, 15), -5.0, "D", "CG1200", "C1203", None, "d", "B"))
    txns = spark.createDataFrame(rows, schema)
    accounts = spark.createDataFrame([("A", "Checking", 100.0, dt.date(2023, 12, 31))], "id string, type string, availableBalance double, balanceDateTime date")
    pats = spark.createDataFrame([("P", "DateOfMonth", "d", "B")], "patternId string, patternTypeBusiness string, deviceId string, bank string")
    out = generate_labels(txns, accounts, pats, cat.default_categories(spark))
    assert [(r.bank, r.flag_name, r.emerging_date) for r in out["emerging"].collect()] == [("B", "EMERGING_SAVINGS", dt.date(2023, 6, 15))]
    assert out["skipped"].count() == 0
    assert {r.bank: (r.users, r.total_flags) for r in out["summary"].collect()} == {"B": (1, 1), "TOTAL": (1, 1)}
    ex, vocab = build_dataset(txns, accounts, min_days=5, censor_subcat="C1203")
    row = ex.first()
    assert row.n_days == 12 and vocab.filter("feature = 'cat_sub'").count() == 2
    assert row.days[-1].neg.balance[0][6] > 0
