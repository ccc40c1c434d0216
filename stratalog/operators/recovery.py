"""Recovery: audits, copies, scrubs, replay of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.metadata import fragment_ranges, most_members


def audit_tasks(ledgers: DataFrame, nodes: DataFrame, failed: DataFrame) -> DataFrame:
    """For each failed node and fragment that holds it, a task with the first healthy node outside the ensemble; none
    without such a node.

    As an ensemble has at most most_members(ledgers) members, one of the first most_members + 1 healthy nodes
    is outside it, so the candidates are one short array.
    """
    most = most_members(ledgers.where("state <> 'Deleted'"))
    pool = nodes.where("status = 'ReadWrite'").join(failed, "node_id", "left_anti").orderBy("node_id").limit(most + 1).agg(F.array_sort(F.collect_list("node_id")).alias("pool"))
    x = fragment_ranges(ledgers.where("state <> 'Deleted'")).select("ledger_id", "first_entry_id", "ensemble", F.explode(F.array_distinct("ensemble")).alias("node_id"))
    x = x.join(failed, "node_id").crossJoin(F.broadcast(pool))  # one row
    target = F.get(F.filter("pool", lambda n: ~F.array_contains(F.col("ensemble"), n)), F.lit(0))
    return x.select("ledger_id", F.col("node_id").alias("failed_node"), target.alias("target_node"), F.col("first_entry_id").alias("from_entry_id")).where("target_node is not null")


def copy_plan(tasks: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Source, target and entries [from, end) of each task: to the next fragment, for the last to the ledger's position."""
    ranges = fragment_ranges(ledgers).select("ledger_id", F.col("first_entry_id").alias("from_entry_id"), "end_entry_id", "ensemble")
    x = tasks.join(ranges, ["ledger_id", "from_entry_id"]).join(ledgers.select("ledger_id", "last_add_confirmed"), "ledger_id")
    source = F.get(F.filter("ensemble", lambda n: n != F.col("failed_node")), F.lit(0))
    end = F.greatest(F.coalesce("end_entry_id", "last_add_confirmed"), F.col("from_entry_id"))
    return x.select("ledger_id", "failed_node", "target_node", source.alias("source_node"), "from_entry_id", end.alias("end_entry_id"))


def swapped_ensembles(tasks: DataFrame, ledgers: DataFrame) -> DataFrame:
    """The ensembles after the copies: the failed member's place is the target's."""
    ranges = fragment_ranges(ledgers).select("ledger_id", F.col("first_entry_id").alias("from_entry_id"), "ensemble")
    swap = F.transform("ensemble", lambda n: F.when(n == F.col("failed_node"), F.col("target_node")).otherwise(n))
    return tasks.join(ranges, ["ledger_id", "from_entry_id"]).select("ledger_id", "from_entry_id", "failed_node", swap.alias("ensemble"))


def scrubbed(replicas: DataFrame) -> DataFrame:
    """Entries on which replicas differ from the first that answered: n_answers and n_mismatches; at least two must answer.

    replicas: ledger_id, entry_id, position, digest (null: no answer).  One aggregation: the digests of an entry are at most its ensemble.
    """
    x = replicas.where("digest is not null").groupBy("ledger_id", "entry_id").agg(F.min_by("digest", "position").alias("baseline"), F.collect_list("digest").alias("all"))
    x = x.where(F.size("all") >= 2)
    return x.select("ledger_id", "entry_id", "baseline", F.size("all").cast("long").alias("n_answers"), F.size(F.filter("all", lambda d: d != F.col("baseline"))).cast("long").alias("n_mismatches"))


def replay_candidates(wal: DataFrame, entry_index: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Log records from each segment's checkpoint on (absent: 0) that the entry index lacks."""
    x = wal.join(checkpoints, "segment_id", "left").where(F.col("offset") >= F.coalesce("checkpoint", F.lit(0))).drop("checkpoint")
    return x.join(entry_index.select("ledger_id", "entry_id"), ["ledger_id", "entry_id"], "left_anti")


def torn_tail(locations: DataFrame, torn: DataFrame) -> DataFrame:
    """Locations with purged: those in a torn segment at or beyond its valid length."""
    x = locations.join(torn, "segment_id", "left")
    return x.withColumn("purged", F.coalesce(F.col("offset") >= F.col("valid_length"), F.lit(False))).drop("valid_length")


def still_missing(purged: DataFrame, replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Purged keys with recovered: whether the replay brought them back."""
    return purged.select(*keys).distinct().join(replayed.select(*keys).distinct().withColumn("recovered", F.lit(True)), keys, "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def stats(wal: DataFrame, replayed: DataFrame, locations: DataFrame, missing: DataFrame) -> DataFrame:
    """One row of counters; each side is aggregated on its own."""
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [
        one(wal, F.count_distinct("segment_id").alias("segments_scanned"), F.count("*").alias("records_scanned")),
        one(replayed, F.count("*").alias("records_replayed")),
        one(locations, F.count_if("purged").alias("locations_purged")),
        one(missing, F.count_if("recovered").alias("purged_recovered"), F.count_if(~F.col("recovered")).alias("purged_missing")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def segments_to_replay(segments: DataFrame) -> DataFrame:
    """Sealed local log segments, then active ones, in order of id."""
    local = segments.where("kind = 'Wal' and status = 'Local'")
    return local.unionByName(segments.where("kind = 'Wal' and status = 'Active'")).orderBy("id")


def unregistered(files: DataFrame, segments: DataFrame, name: Column) -> DataFrame:
    """Segment files that the registry lacks."""
    from stratalog.functions.encoding import file_id

    found = files.withColumn("id", file_id(name)).where("id is not null")
    return found.join(segments.select("id"), "id", "left_anti")
