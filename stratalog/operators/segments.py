"""Segments: layout, registry, offload, tiers, garbage."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import encoding as E


def record_offsets(records: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """Offset of each record in its batch: the lengths before it."""
    w = Window.partitionBy(*batch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def padding(records: DataFrame, batch: list[str]) -> DataFrame:
    """Bytes of each batch as written, its padding to whole pages, and what a page a record would waste."""
    x = records.groupBy(*batch).agg(F.count("*").alias("n_records"), F.sum("length").alias("bytes"), F.sum(E.align_up(F.col("length"))).alias("page_per_record"))
    return x.withColumn("written", E.align_up(F.col("bytes"))).withColumn("waste", F.col("written") - F.col("bytes"))


def ledger_bytes(locations: DataFrame) -> DataFrame:
    """Per segment the bytes of each ledger, as a map."""
    x = locations.groupBy("segment_id", "ledger_id").agg(F.sum("length").alias("bytes"))
    return x.groupBy("segment_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ledger_id", "bytes")))).alias("ledger_sizes"), F.sum("bytes").alias("bytes"))


def cas_status(segments: DataFrame, expected: str, following: str) -> DataFrame:
    hit = F.col("status") == expected
    return segments.withColumn("changed", hit).withColumn("status", F.when(hit, following).otherwise(F.col("status")))


def cas_remote(segments: DataFrame, expected: str = "Offloading") -> DataFrame:
    """To the remote tier: sets the key and clears the local path, in one step."""
    hit = F.col("status") == expected
    return segments.withColumn("changed", hit).withColumn("remote_key", F.when(hit, E.remote_key(F.col("id")))).withColumn("local_path", F.when(~hit, E.entry_file(F.col("id")))).withColumn("status", F.when(hit, "S3").otherwise(F.col("status")))


def upserted(rows: DataFrame, writes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins by key; rows are older than all writes."""
    both = rows.withColumn(seq, F.lit(-1).cast("long")).unionByName(writes)
    others = [c for c in both.columns if c not in (*keys, seq)]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others))


def local_bytes(segments: DataFrame) -> DataFrame:
    return segments.where("status = 'Local'").agg(F.coalesce(F.sum("byte_len"), F.lit(0)).alias("local_bytes"))


def old_enough(modified: Column, now: Column, least_seconds: int) -> Column:
    """Also where the time of change can't be read, or no age is asked for."""
    if least_seconds == 0:
        return F.lit(True)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(modified) >= least_seconds, F.lit(True))


def offload_eligible(segments: DataFrame, now: Column, least_seconds: int, budget: int) -> DataFrame:
    """Local segments that are old enough, or all of them while the local bytes are over budget."""
    pressure = local_bytes(segments).select(F.col("local_bytes") > budget).scalar()
    return segments.where((F.col("status") == "Local") & (old_enough(F.col("mtime"), now, least_seconds) | pressure))


def multipart_plan(segments: DataFrame, part: int = E.MULTIPART) -> DataFrame:
    """Parts of each upload: one put up to part bytes, else parts of that size."""
    last = F.greatest(F.col("byte_len") - 1, F.lit(0))
    x = segments.select("id", "byte_len", F.posexplode(F.sequence(F.lit(0).cast("long"), last, F.lit(part).cast("long"))).alias("k", "offset"))
    return x.select("id", (F.col("k") + 1).cast("long").alias("part"), "offset", F.least(F.lit(part), F.col("byte_len") - F.col("offset")).alias("length"), (F.col("byte_len") > part).alias("multipart"))


def referenced(locations: DataFrame) -> DataFrame:
    return locations.where("index = 'wal'").select("segment_id").distinct()


def wal_garbage(segments: DataFrame, locations: DataFrame, now: Column, least_seconds: int, budget: int) -> DataFrame:
    """Sealed log segments that no location needs, old enough or under pressure."""
    pressure = local_bytes(segments).select(F.col("local_bytes") > budget).scalar()
    wal = segments.where((F.col("kind") == "Wal") & F.col("status").isin("Local", "S3"))
    free = wal.join(referenced(locations), wal.id == F.col("segment_id"), "left_anti")
    return free.where(old_enough(F.col("mtime"), now, least_seconds) | pressure)


def _places(here: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of the index where it is read: route, segment_id, offset, length, cacheable, for each status that its segment is registered with."""
    best = lambda index: F.max(F.when(F.col("index") == index, F.struct("segment_id", "offset", "length"))).alias(index)
    registered = segments.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.coalesce("status", F.lit(""))).alias("_statuses"))
    # keys without an entry location are spread over the tasks of the join; what they meet there does not count
    x = here.groupBy(*keys).agg(best("entry"), best("wal")).withColumn("_id", F.coalesce("entry.segment_id", F.xxhash64(*keys))).join(registered, "_id", "left")
    x = x.select(*keys, "entry", "wal", F.explode_outer(F.when(F.col("entry").isNotNull(), F.col("_statuses"))).alias("status"))
    by_entry = F.when(F.col("status").isin("Local", "Active", "Offloading"), "local").when(F.col("status") == "S3", "remote")
    route = F.coalesce(by_entry, F.when(F.col("wal").isNotNull(), "wal"), F.lit("not_found"))
    at = F.when(route.isin("local", "remote"), F.col("entry")).when(route == "wal", F.col("wal"))
    return x.select(*keys, route.alias("route"), at["segment_id"].alias("segment_id"), at["offset"].alias("offset"), at["length"].alias("length"), ((route == "local") & (F.col("status") != "Active")).alias("cacheable"))


def _routed(x: DataFrame) -> DataFrame:
    """x: ledger_id, entry_id, cached, and the columns of a place, null where the index has none."""
    route = F.when(F.col("cached"), "cache").otherwise(F.coalesce("route", F.lit("not_found")))
    stored = lambda name: F.when(F.col("cached"), None).otherwise(F.col(name)).alias(name)
    return x.select("ledger_id", "entry_id", route.alias("route"), stored("segment_id"), stored("offset"), stored("length"), F.when(F.col("cached"), False).otherwise(F.coalesce("cacheable", F.lit(False))).alias("cacheable"))


def tier_routes(wanted: DataFrame, locations: DataFrame, segments: DataFrame) -> DataFrame:
    """Where each wanted entry is read: the entry index before the log index; by the segment's status local or remote.

    wanted: ledger_id, entry_id, cached.  Repeated locations of a key: the last segment, then offset.  The index is cut down to the wanted keys
    first, and both of its kinds are aggregated at once.
    """
    keys = ["ledger_id", "entry_id"]
    here = locations.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return _routed(wanted.join(_places(here, segments, keys), keys, "left"))


#: Ledgers of a block, about; ledgers that go out by broadcast, at most; routes that a task makes, about; tasks at most.
BLOCK_LEDGERS, SENT_LEDGERS, TASK_ROUTES, MOST_TASKS = 1024, 1 << 18, 4_000_000, 1 << 16


def tier_routes_by_group(entries: DataFrame, ledgers: DataFrame, group: Callable[[Column], Column], cached: Column, locations: DataFrame, segments: DataFrame) -> DataFrame:
    """tier_routes where each entry is wanted of every ledger of its group; the wanted rows themselves meet no exchange and no sort.

    entries: entry_id.  ledgers: ledger_id.  group: of either id; null is in none.  cached: of ledger_id and entry_id.  Ledgers of a group are
    dealt to blocks.  An entry travels once a block, with the places that the index has for it there, and meets the block's ledgers last.
    """
    entries = entries.select("entry_id", group(F.col("entry_id")).alias("group")).where("group is not null")
    ledgers = ledgers.select("ledger_id", group(F.col("ledger_id")).alias("group")).where("group is not null")
    sizes = ledgers.groupBy("group").agg(F.count("*").alias("n"))
    both = sizes.join(entries.groupBy("group").agg(F.count("*").alias("m")), "group", "left")
    n_ledgers, n_routes = both.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("m").cast("double")), F.lit(0.0))).first()
    sent = F.broadcast if n_ledgers <= SENT_LEDGERS else lambda x: x
    n_tasks = min(MOST_TASKS, max(entries.sparkSession.sparkContext.defaultParallelism, math.ceil(n_routes / TASK_ROUTES)))

    sizes = sizes.select("group", F.ceil(F.col("n") / BLOCK_LEDGERS).alias("n_blocks"))
    members = ledgers.join(sent(sizes), "group").select("group", "ledger_id", F.pmod(F.xxhash64("ledger_id"), F.col("n_blocks")).alias("block"))
    blocks = members.groupBy("group", "block").agg(F.sort_array(F.collect_list("ledger_id")).alias("ledger_ids"))
    asked = entries.join(sent(sizes), "group").select("group", "entry_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))

    here = locations.where(group(F.col("ledger_id")) == group(F.col("entry_id"))).join(sent(members.select("ledger_id", "block").distinct()), "ledger_id")
    places = _places(here, segments, ["block", "entry_id", "ledger_id"]).repartition(n_tasks, "block", "entry_id")
    places = places.groupBy("block", "entry_id", "ledger_id").agg(F.collect_list(F.struct("route", "segment_id", "offset", "length", "cacheable")).alias("places"))
    known = places.groupBy("block", "entry_id").agg(F.map_from_entries(F.collect_list(F.struct("ledger_id", "places"))).alias("known"))
    x = asked.repartition(n_tasks, "block", "entry_id").join(known, ["block", "entry_id"], "left").join(sent(blocks), ["group", "block"])
    x = x.select("entry_id", "known", F.explode("ledger_ids").alias("ledger_id"))
    x = x.select("ledger_id", "entry_id", F.explode_outer(F.col("known")[F.col("ledger_id")]).alias("place"))
    return _routed(x.select("ledger_id", "entry_id", cached.alias("cached"), "place.*"))


def tiered_read(wanted: DataFrame, locations: DataFrame, segments: DataFrame, cached: DataFrame, records: DataFrame) -> DataFrame:
    """The payload of each wanted entry, from the tier that its route names: ledger_id, entry_id, route, payload, outcome.

    cached: ledger_id, entry_id, payload of what is held in memory.  records: segment_id, kind (entry or wal), offset, ledger_id, entry_id,
    payload, as a segment reader gives them (see sources.segment_files.read_at).  An entry without a location is NotFound; one whose location
    holds no such record is Corrupt.
    """
    keys = ["ledger_id", "entry_id"]
    held = cached.select(*keys, F.col("payload").alias("_held"), F.lit(True).alias("_is_held"))
    asked = wanted.select(*keys).join(held, keys, "left").withColumn("cached", F.coalesce("_is_held", F.lit(False)))
    routes = tier_routes(asked.select(*keys, "cached"), locations, segments)
    place = routes.withColumn("kind", F.when(F.col("route") == "wal", "wal").when(F.col("route").isin("local", "remote"), "entry"))
    stored = records.select("segment_id", "kind", "offset", *keys, F.col("payload").alias("_stored"), F.lit(True).alias("_is_stored"))
    x = place.join(stored, ["segment_id", "kind", "offset", *keys], "left").join(held, keys, "left")
    outcome = F.when(F.col("route") == "not_found", "NotFound").when((F.col("route") == "cache") | F.col("_is_stored"), "Read").otherwise("Corrupt")
    return x.select(*keys, "route", F.when(F.col("route") == "cache", F.col("_held")).otherwise(F.col("_stored")).alias("payload"), outcome.alias("outcome"))


def block_reads(locations: DataFrame) -> DataFrame:
    """The block of each location, where the record ends, and how many blocks it spans."""
    block = E.block_start(F.col("offset"))
    last = E.block_start(F.col("offset") + F.col("length") - 1)
    return locations.select("segment_id", "offset", "length", block.alias("block"), (F.shiftright(last - block, E.BLOCK_SHIFT) + 1).alias("n_blocks"))


def orphans_sealed(segments: DataFrame) -> DataFrame:
    """At start, what was active or under way is local again."""
    return segments.withColumn("status", F.when(F.col("status").isin("Active", "Offloading"), "Local").otherwise(F.col("status")))


def next_segment_id(files: DataFrame, segments: DataFrame) -> DataFrame:
    """One more than the greatest id on disk or in the registry; 0 without any."""
    both = files.select(E.file_id(F.col("name")).alias("id")).unionByName(segments.select("id"))
    return both.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("next_id"))


def cache_tiers(entries: DataFrame, flushed: Column, drained: Column) -> DataFrame:
    """Hot, warm or evicted."""
    return entries.withColumn("tier", F.when(flushed, "evicted").when(drained, "warm").otherwise("hot"))
