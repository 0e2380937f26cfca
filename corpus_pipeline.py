"""A training-data pipeline over ``documents``: classify, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, in the columns that
came in; the last gives the encoded ones. Decisions take effect: documents that the classifier rejects
go, of each group of near-duplicates the one of smallest id stays (and of rows that share an id the
one of smallest text hash), documents that hold benchmark windows go, secrets in the text are
replaced by a mark (``n_chars`` follows), and what is left is encoded.

Null and empty texts pass every filter; rows with a null id have no near-duplicates; further columns, whatever their names, go along
to the last stage; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelint.llm import bpe, common, contam, jaccard, resample, secrets_scan


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample.keep_best(docs, common.table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = common.checkpoint(jaccard.near_duplicates(docs).where("id is not null").select("id", "n", "component"))
    gone = found.where("n > 0 and id <> component").select(F.col("id").alias("doc_id")).distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = found.where("n > 0 and id = component").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    twice = common.checkpoint(twice.select(F.col("id").alias("doc_id")))
    if twice.isEmpty():
        return left
    several = left.join(twice, "doc_id", "left_semi")
    first = several.groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text")).alias("row"))
    one = first.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "text")
    hit = contam.match(rows, common.table(spark, sf_dir, "benchmark"), keep=("row",))
    return hit.where(F.size("spans") == 0).select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets_scan.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids are the tokens, little-endian unsigned 32-bit integers."""
    return bpe.digest(docs, "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: hashed models, connected components and BPE merges have no SQL form: tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written to the shared checkpoint folder and read again.

    A stage's folder is deleted when the next one is written; the last one is the result and stays.
    """
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.delete(spark, f"{folder}/{k - 1}")
    return docs
