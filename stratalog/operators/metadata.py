"""Ledger and node metadata: fragments, ensembles, compare-and-set, fencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fragment_ranges(ledgers: DataFrame) -> DataFrame:
    """One row a fragment, valid from first_entry_id to before end_entry_id (null: open); from the array itself, no window."""
    x = ledgers.select("ledger_id", F.posexplode("fragments").alias("fragment", "f"), "fragments")
    return x.select("ledger_id", F.col("fragment").cast("long").alias("fragment"), "f.first_entry_id", F.get("fragments", F.col("fragment") + 1)["first_entry_id"].alias("end_entry_id"), "f.ensemble", "f.write_quorum", "f.ack_quorum")


def resolved(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of each fragment with their address and whether a read can use them; unknown members stay, unresolved."""
    x = ranges.select("ledger_id", "fragment", F.posexplode("ensemble").alias("position", "node_id"))
    return x.join(nodes.select("node_id", "address", "status"), "node_id", "left").withColumn("resolvable", F.col("address").isNotNull() & (F.col("status") != "Unavailable"))


def transition(ledgers: DataFrame, expected: str, following: str) -> DataFrame:
    """State by compare-and-set: moved rows get the next version."""
    moved = F.col("state") == expected
    return ledgers.withColumn("changed", moved).withColumn("state", F.when(moved, following).otherwise(F.col("state"))).withColumn("version", F.col("version") + F.col("changed").cast("long"))


def put(ledgers: DataFrame, writes: DataFrame) -> DataFrame:
    """writes (ledger_id, version, writer, ...) -> outcome: the first writer on the current version wins, others conflict."""
    w = Window.partitionBy("ledger_id", "version").orderBy("writer")
    x = writes.withColumn("_rank", F.row_number().over(w)).join(ledgers.select("ledger_id", F.col("version").alias("current")), "ledger_id", "left")
    outcome = F.when(F.col("current").isNull(), "LedgerNotFound").when((F.col("version") == F.col("current")) & (F.col("_rank") == 1), "Written").otherwise("CasConflict")
    return x.withColumn("outcome", outcome).withColumn("new_version", F.when(outcome == "Written", F.col("version") + 1)).drop("_rank", "current")


def created(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Creation fails where the id is known; a new ledger is open, at version 1, without a last entry."""
    x = ids.join(known.select("ledger_id", F.lit(True).alias("_known")), "ledger_id", "left")
    return x.select("ledger_id", F.when(F.col("_known"), "AlreadyExists").otherwise("Created").alias("outcome"), F.when(F.col("_known").isNull(), F.lit(1)).cast("long").alias("version"), F.when(F.col("_known").isNull(), "Open").alias("state"))


def sealed(ledgers: DataFrame, finals: DataFrame) -> DataFrame:
    """Closes ledgers at their final position, inclusive; closed ones stay as they are."""
    x = ledgers.join(finals.select("ledger_id", "final_lac"), "ledger_id")
    closed = F.col("state") == "Closed"
    return x.select("ledger_id", F.lit("Closed").alias("state"), F.when(closed, F.col("last_entry_id")).otherwise(F.col("final_lac")).alias("last_entry_id"), F.when(closed, F.col("version")).otherwise(F.col("version") + 1).alias("version"))


def removed(ledgers: DataFrame, ids: DataFrame) -> DataFrame:
    return ledgers.join(ids.select("ledger_id"), "ledger_id", "left_anti")


def fence_and_seal(ledgers: DataFrame, answers: DataFrame, inclusive: bool = False) -> DataFrame:
    """Fences the last ensemble and closes: the position is the greatest that a member reports.

    answers: ledger_id, node_id, lac.  The last entry is one before the position, null at position 0; inclusive keeps
    the position itself as the last entry.
    """
    members = ledgers.where("state in ('Open', 'InRecovery')").select("ledger_id", F.explode(F.element_at("fragments", -1)["ensemble"]).alias("node_id"))
    lac = members.join(answers, ["ledger_id", "node_id"], "left").groupBy("ledger_id").agg(F.coalesce(F.max("lac"), F.lit(0)).alias("lac"), F.count("lac").alias("n_answers"))
    last = F.col("lac") if inclusive else F.when(F.col("lac") >= 1, F.col("lac") - 1)
    return lac.withColumn("state", F.lit("Closed")).withColumn("last_entry_id", last)


def key_registrations(offers: DataFrame) -> DataFrame:
    """Per ledger the first key offered that isn't null, and whether another one conflicts with it."""
    w = F.min_by("master_key", F.when(F.col("master_key").isNotNull(), F.col("seq")))
    return offers.groupBy("ledger_id").agg(w.alias("stored_key"), (F.count_distinct("master_key") > 1).alias("conflict"), F.count("*").alias("n_offers"))


def in_some_ensemble(fragments: Column, node_id) -> Column:
    return F.exists(fragments, lambda f: F.array_contains(f["ensemble"], node_id))


def most_members(ledgers: DataFrame) -> int:
    """The size of the widest ensemble, by one aggregate."""
    return ledgers.agg(F.max(F.array_max(F.transform("fragments", lambda f: F.size(f["ensemble"]))))).first()[0] or 0


def spares(ledgers: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """For each ledger the first k writable nodes outside its current ensemble.

    At most k plus the ensemble's size of the least writable ids can matter, so that many go to each
    ledger as one array instead of a join with all nodes.
    """
    most = k + most_members(ledgers)
    pool = nodes.where("status = 'ReadWrite'").orderBy("node_id").limit(most).agg(F.array_sort(F.collect_list("node_id")).alias("pool"))
    x = ledgers.crossJoin(F.broadcast(pool))  # one row
    current = F.element_at("fragments", -1)["ensemble"]
    return x.select("ledger_id", F.slice(F.filter("pool", lambda n: ~F.array_contains(current, n)), 1, k).alias("spares"))


def changed_fragment(ledgers: DataFrame, nodes: DataFrame, failed: list[int], next_entry: Column) -> DataFrame:
    """The fragment that follows when members fail: survivors in order, then spares; QuorumNotMet if too few for a write."""
    x = ledgers.join(spares(ledgers, nodes, max(1, len(failed))), "ledger_id").withColumn("f", F.element_at("fragments", -1))
    dead = F.array(*(F.lit(n) for n in failed))
    survivors = F.filter("f.ensemble", lambda n: ~F.array_contains(dead, n))
    lost = F.size("f.ensemble") - F.size(survivors)
    ensemble = F.concat(survivors, F.slice(F.filter("spares", lambda n: ~F.array_contains(dead, n)), F.lit(1), lost))
    x = x.withColumn("ensemble", ensemble).where(lost > 0)
    return x.select("ledger_id", next_entry.alias("first_entry_id"), "ensemble", F.when(F.size("ensemble") < F.col("f.write_quorum"), "QuorumNotMet").alias("reason"))


def expired_leases(nodes: DataFrame, now_ms: Column, ttl_ms: int = 15_000) -> DataFrame:
    return nodes.where(now_ms - F.col("last_heartbeat_ms") > ttl_ms)


def numbered(rows: DataFrame, start: Column, order: str, width: int = 1 << 16, name: str = "ledger_id") -> DataFrame:
    """Consecutive ids from start, in order of a distinct number, without one task numbering all.

    Ranges of width numbers are counted first; their running sum (a row a range) is added to the rank in the range.
    """
    x = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = x.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return x.withColumn("_rank", rank).join(before, "_range").withColumn(name, start + F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")
