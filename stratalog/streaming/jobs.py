"""Structured Streaming jobs over entries: deduplication, positions and leases.

Each takes a streaming DataFrame and returns one; run_once() drives a job over what is there into a Parquet table in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_wins(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicates are dropped for ever, in whatever order they come; the state is one key each."""
    return entries.dropDuplicates(keys)


def first_wins_within(entries: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The same with bounded state: duplicates are told within the delay."""
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def positions(entries: DataFrame) -> DataFrame:
    """Each ledger's confirmed position and highest entry, updated as entries come."""
    return entries.groupBy("ledger_id").agg(F.max("lac").alias("lac"), F.max("entry_id").alias("last_entry_id"), F.count("*").alias("n_entries"))


def lapsed_leases(heartbeats: DataFrame, ttl: str, delay: str) -> DataFrame:
    """One row each time a node falls silent for ttl: a session of heartbeats that the watermark has passed."""
    w = heartbeats.withWatermark("at", delay).groupBy("node_id", F.session_window("at", ttl).alias("w"))
    return w.agg(F.count("*").alias("n_heartbeats"), F.max("at").alias("last_heartbeat")).select("node_id", "last_heartbeat", F.col("w.end").alias("expired_at"), "n_heartbeats")


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a stream's state needs a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratalog-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_once(job: DataFrame, mode: str = "append") -> DataFrame:
    """All available input through the job; the table that it leaves (complete: the last state).

    In update mode a batch holds just the keys that changed, so a table that each batch replaces would lose the others: it is refused.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"run_once writes appended rows or the complete state, not {mode}")
    spark = job.sparkSession
    at = folder(spark)
    out = f"{at}/out"
    if mode == "append":
        writer = job.writeStream.format("parquet").option("path", out)
    else:
        writer = job.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    writer.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(job.schema).parquet(out)
