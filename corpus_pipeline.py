"""A corpus pipeline: toxic documents and near copies go, contaminated ones go, secrets are masked, the rest is encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, minhash, secrets, toxicity
from corpusloom.llm.common import read
from corpusloom.llm.queries import tokenizer
from corpusloom.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model that learned from four fifths of the labels; a null text scores 0."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(fold != 0))
    return docs.where(toxicity.score_column(model)(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near copies, that of the least id; all texts without a word stay."""
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; a null text has none, and a repeated row goes or stays with its like."""
    return decontam.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced and ``n_chars``, if there, counted anew; a null text stays null."""
    clean = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and how many there are; a null text has none, a repeated row its row again."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = bpe.bpe_encode(docs.select(*kept, "text"), *tokenizer())
    return coded.select(*kept, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("byte_bpe", encode),
]
#: SQL cannot say the learned, the sketched and the tokenised stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
