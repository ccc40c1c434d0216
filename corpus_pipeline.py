"""A cleaning pipeline over documents: each stage works on all that the one before kept, as a Parquet table.

Toxic documents go; of near copies one stays; documents that hold benchmark passages go; secrets are
masked; what is left is packed into training sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontaminate, neardup, packing, secret_scan, toxicity
from stratalog.llm.common import read_table, shared_dir

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("near_duplicates", neardup.keep_one),
    ("decontamination", decontaminate.keep_clean),
    ("secrets", secret_scan.redact),
    ("packing", packing.pack_stage),
]

#: No single SQL statement expresses trained models and a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def stages(spark: SparkSession, sf_dir: str):
    """Name, function and input of each stage, and last the result; every stage's output is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = None
    for _, docs in stages(spark, sf_dir):
        pass
    return docs
