"""Every registered query and every stage on the smallest tables, and the SQL where there is one."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from passbook.llm.queries import ORACLES, QUERIES

TEXT_TABLES = ("documents", "embeddings", "pages", "labels")


def test_all_thirteen_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TEXT_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(repr, r)) for r in frame.select(*columns).collect())
    picked = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(repr, r)) for r in con.sql(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["op1_sampled_pieces", "op2_class_ngram_scores", "op7_simhash_anchor_cover", "op8_subsequence_toxicity"])
def test_one_row_for_each_document(spark, sf_dir, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
    if name == "op1_sampled_pieces":
        assert all(r.lossless for r in rows)
    if name == "op8_subsequence_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_fingerprints_and_classes_of_the_documents(spark, sf_dir):
    from test_copies import brute_classes, brute_fingerprint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_fingerprint(d.text, 3) for d in docs]
    roots = brute_classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_anchor_cover"](spark, sf_dir).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, roots)}


ODD = [
    (1, "same text here", "en", "s", 14, "x"),
    (2, "same  text here", "en", "s", 15, "x"),
    (2, "same  text here", "en", "s", 15, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "s", 0, "x"),
    (None, "mail me: joe@example.com now", "en", "s", 28, "x"),
    (6, "word " * 30_000, "en", "s", 150_000, "x"),
    (7, "word " * 30_000 + "word", "en", "s", 150_004, "x"),
]


@pytest.mark.parametrize("stored", [True, False])
def test_stages_on_odd_rows(spark, sf_dir, tmp_path, stored):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _file string"
    docs = spark.createDataFrame(ODD, schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        if stored:
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        rows = out.collect()
        if name == "exact_dedup":
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in rows) == [(0, 28), (2, 15), (3, 0), (6, 150_000), (7, 150_004)]
            docs = spark.createDataFrame(rows, schema)
        if name == "near_dedup":
            assert sorted(r.doc_id or 0 for r in rows) == [0, 2, 3, 6]
        if name == "pii":
            (mail,) = [r for r in rows if r.doc_id is None]
            assert mail.text == "mail me: <EMAIL> now" and mail.n_chars == len(mail.text)


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage's decisions, taken again one document at a time from what its predecessor kept."""
    from test_copies import brute_exact
    from test_jaccard import brute_roots

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in QUERIES["op8_subsequence_toxicity"](spark, sf_dir).collect()}
    kept = sorted(((r.doc_id, r.text) for r in docs.collect() if not scores[r.doc_id]), key=lambda r: r[0])
    stay = {r[0] for r in brute_exact(kept) if r[3]}
    kept = [r for r in kept if r[0] in stay]
    roots = brute_roots([t for _, t in kept], 5, 0.8)
    kept = [r for i, r in enumerate(kept) if roots[i] == i]
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r[0] for r in kept}
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert used[0] <= 1024 and used[1] <= -(-used[2] // 1024) + 3
