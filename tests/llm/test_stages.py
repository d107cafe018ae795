import corpus_pipeline
from passbook.llm.dedup import exact_duplicates


def test_the_exact_stage_hashes_whole_texts_of_survivors_only(spark, sf_dir, monkeypatch):
    seen = []

    def watched(*args, **options):
        seen.append(exact_duplicates(*args, **options))
        return seen[-1]

    monkeypatch.setattr(corpus_pipeline, "exact_duplicates", watched)
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "alone here")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, sf_dir).collect()) == [1, 3]
    assert {r.key.doc_id: r.text_sha256 is None for r in seen[0].collect()} == {1: False, 2: False, 3: True}
