"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage reads what the one before it wrote. Rejected documents go: those that score as toxic,
all but one of each near-duplicate group, and those with a benchmark passage. Secrets are replaced
in the text. The last stage returns tokens.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rinkframe.llm import byte_bpe, decontaminate, near_dedup, secrets, toxicity  # noqa: E402
from rinkframe.llm.common import ensure_checkpoint_dir, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stage links from a Jaccard similarity of 0.80 on; op9 by itself has its own figure. 25 bands of 5 miss a pair at 0.80 with probability 5e-5.
NEAR_PERCENT = 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("__score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id, rows without one last. A row's key is a digest of its id and text, so ids may be null or shared."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__row"))
    found = near_dedup.near_duplicates(rows, id_col="__row", percent=NEAR_PERCENT).select("__row", "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    kept = rows.select("__row", "doc_id").join(found, "__row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row").dropDuplicates(["__row"]).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source", "n_chars"))
    return found.where("n_hit = 0").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, keep=("text", "lang", "source"))
    text = secrets.redacted(F.col("text"), ["assign", "access", "hex", "random"])
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic), ("near_dedup", near_copies), ("decontaminate", benchmark_passages), ("secrets", redact_secrets), ("tokens", tokens)]
#: SQL can't express the toxicity model or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
