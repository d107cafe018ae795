"""The corpus pipeline: toxicity filter, exact and near deduplication, redaction and packing.

Every stage is a function of (spark, docs, sf_dir) that calls one operator of ``passbook.llm`` and returns a DataFrame.
It is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``, and any other columns that ``docs`` has.

In every stage null texts count as empty, very long texts are read whole, null and repeated doc_ids are rows like any other,
and an empty table gives an empty result. Which row of a group stays is settled by doc_id (nulls last) and then by the
row's place in its file, so there are no ties, and of repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import numbered, table
from passbook.llm.dedup import exact_duplicates
from passbook.llm.jaccard import near_copies
from passbook.llm.packing import Limits, pack_documents
from passbook.llm.pii import fit_span_model, redact
from passbook.llm.toxicity import score, train
from passbook.session import scratch_path

#: The stages are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def keyed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``key, text``: keys order rows by doc_id, nulls last, and tell rows with the same doc_id apart."""
    place = [F.col(n).alias(c) for n, c in zip(names, ("file", "index"))]
    return rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *place).alias("key"), "text")


def only(rows: DataFrame, names: list[str], keys: DataFrame) -> DataFrame:
    """The numbered rows whose ``key`` is in ``keys``."""
    places = keys.select(*(F.col("key")[c].alias(n) for n, c in zip(names, ("file", "index"))))
    return rows.join(places, names, "left_semi").drop(*names)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go. It learns from the labels outside the held-out fifth; without labels
    of both classes it rejects none."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    machine = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, machine).where("predicted = 0").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, then the one with the smallest doc_id."""
    rows, names = numbered(docs)
    found = exact_duplicates(keyed(rows, names), key="key")
    return only(rows, names, found.where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles the one with the smallest
    doc_id stays. All links count, none is missed."""
    rows, names = numbered(docs)
    found = near_copies(keyed(rows, names), words=5, similarity=0.8, key="key")
    return only(rows, names, found.where(F.col("key") == F.col("component_id")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; ``n_chars`` follows. Null texts stay null, and no row goes."""
    clean = redact(docs, fit_span_model(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, in sequences of 1024 tokens."""
    return pack_documents(docs, Limits(tokens=1024))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
