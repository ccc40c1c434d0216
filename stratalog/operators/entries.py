"""Entries: reading, positions, acceptance of appends, quorums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import encoding as E


def visible(entry_id: Column, last_entry_id: Column, lac: Column) -> Column:
    return last_entry_id.isNotNull() & (entry_id <= F.least(last_entry_id, lac))


def read_point(entries: DataFrame, ledger_id: int, entry_id: int) -> DataFrame:
    return entries.where((F.col("ledger_id") == ledger_id) & (F.col("entry_id") == entry_id))


def read_range(entries: DataFrame, ledger_id: int, first: int = 0, end: int | None = None) -> DataFrame:
    """Entries of a ledger from first to before end, in order."""
    rows = entries.where((F.col("ledger_id") == ledger_id) & (F.col("entry_id") >= first))
    return (rows if end is None else rows.where(F.col("entry_id") < end)).orderBy("entry_id")


def positions(entries: DataFrame) -> DataFrame:
    """Per ledger: the node's confirmed position, the highest entry and the next id."""
    return entries.groupBy("ledger_id").agg(F.max("lac").alias("lac"), F.max("entry_id").alias("last_entry_id"), (F.max("entry_id") + 1).alias("next_entry_id"))


def read_visible(entries: DataFrame) -> DataFrame:
    """All that readers may see, by each ledger's own positions.

    The positions are an aggregate of two narrow columns and go to the entries by a join: broadcast while they are few, else with the skew
    split of adaptive execution, so no task holds a hot ledger's payloads, as one would for a window.
    """
    own = positions(entries).select("ledger_id", F.col("lac").alias("_lac"), F.col("last_entry_id").alias("_last"))
    return entries.join(own, "ledger_id").where(visible(F.col("entry_id"), F.col("_last"), F.col("_lac"))).drop("_lac", "_last")


def next_entry_ids(ledgers: DataFrame, entries: DataFrame) -> DataFrame:
    """For every ledger, also those without entries."""
    last = entries.groupBy("ledger_id").agg(F.max("entry_id").alias("m"))
    return ledgers.select("ledger_id").join(last, "ledger_id", "left").select("ledger_id", F.coalesce(F.col("m") + 1, F.lit(0)).alias("next_entry_id"))


def running_positions(entries: DataFrame) -> DataFrame:
    """The node's and the writer's confirmed position after each entry, and how far the entry is ahead of its own."""
    w = Window.partitionBy("ledger_id").orderBy("entry_id").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("node_lac", F.max("lac").over(w)).withColumn("client_lac", F.max(F.greatest("lac", "entry_id")).over(w)).withColumn("lag", E.saturating_sub(F.col("entry_id"), F.col("lac")))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order; the rank filter becomes a group limit before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def unstored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(stored.select(*keys), keys, "left_anti")


def judged(submissions: DataFrame, fenced: DataFrame, keys: DataFrame, secret: bytes, order: list[str]) -> DataFrame:
    """Submissions with reason: null if accepted and stored, else the first check that it fails, in the node's order.

    submissions: ledger_id, entry_id, lac, data, digest, hmac, master_key; fenced: ledger_id; keys: ledger_id, stored_key.
    """
    x = submissions.join(fenced.select("ledger_id", F.lit(True).alias("_fenced")), "ledger_id", "left").join(keys, "ledger_id", "left")
    message = E.entry_message(F.col("ledger_id"), F.col("entry_id"), F.col("lac"), F.col("data"))
    refused = (
        F.when(E.digest(F.col("data")) != F.col("digest"), "ChecksumInvalid")
        .when(F.col("_fenced"), "LedgerFenced")
        .when(F.col("master_key").isNotNull() & F.col("stored_key").isNotNull() & (F.col("master_key") != F.col("stored_key")), "KeyMismatch")
        .when(F.col("stored_key").isNotNull() & ~E.hmac_valid(F.col("hmac"), secret, message), "HmacInvalid")
    )
    w = Window.partitionBy("ledger_id", "entry_id", F.col("_refused").isNull()).orderBy(*order)
    judged = x.withColumn("_refused", refused).withColumn("_rank", F.row_number().over(w))
    reason = F.coalesce(F.col("_refused"), F.when(F.col("_rank") > 1, "Duplicate"))
    return judged.withColumn("reason", reason).drop("_fenced", "_refused", "_rank", "stored_key")


def write_sets(entries: DataFrame, ledgers: DataFrame) -> DataFrame:
    """One row for each replica to write: the first write_quorum members of the owning fragment's ensemble."""
    owner = entries.join(ledgers.select("ledger_id", "fragments"), "ledger_id").withColumn("f", owning_fragment(F.col("fragments"), F.col("entry_id"))).drop("fragments")
    return owner.select("ledger_id", "entry_id", F.posexplode(F.slice("f.ensemble", F.lit(1), F.col("f.write_quorum"))).alias("position", "node_id"), F.col("f.ack_quorum").alias("ack_quorum"))


def owning_fragment(fragments: Column, entry_id: Column) -> Column:
    """The last fragment that begins at or before the entry: an as-of lookup in the row, no join."""
    return F.try_element_at(F.filter(fragments, lambda f: f["first_entry_id"] <= entry_id), F.lit(-1))


def quorums(acks: DataFrame) -> DataFrame:
    """Per entry: acknowledgements, whether a member is fenced, and the outcome; a fence wins over success."""
    out = acks.groupBy("ledger_id", "entry_id").agg(F.count_if("ok").alias("n_ok"), F.max("fenced").alias("any_fenced"), F.max("ack_quorum").alias("ack_quorum"))
    outcome = F.when(F.col("any_fenced"), "LedgerFenced").when(F.col("n_ok") >= F.col("ack_quorum"), "Committed").otherwise("QuorumNotMet")
    return out.withColumn("outcome", outcome)


def hedged(replies: DataFrame, delay_ms: int) -> DataFrame:
    """Per read the earliest success if replica i starts at i delays: its time and the replica (first in order on ties)."""
    at = replies.where("ok").withColumn("ms", F.col("position") * delay_ms + F.col("latency_ms"))
    best = at.groupBy("ledger_id", "entry_id").agg(F.min(F.struct("ms", "position", "node_id")).alias("b"))
    return best.select("ledger_id", "entry_id", "b.ms", "b.position", "b.node_id")
