"""All named queries, each an operator on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import encoding as E
from stratalog.operators import entries as en
from stratalog.operators import folds, health, kv, recovery
from stratalog.operators import metadata as md
from stratalog.operators import segments as sg
from stratalog.plans.relations import SECRET, Relations, sql
from stratalog.sources import segment_files
from stratalog.streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
c = F.col


def query(name: str, text: str | None = None):
    """Registers a function of Relations as a query, with its SQL if it has any."""

    def keep(f: Callable[[Relations], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if text:
            _SQL[name] = text
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


ENTRY = ("ledger_id", "entry_id", "text")
NOW = "1998-08-02"

# ---- reading and positions -----------------------------------------------------------------------------------------


query("read_point", sql("SELECT ledger_id, entry_id, text FROM entries WHERE ledger_id = 7 AND entry_id = 3", "entries"))(lambda r: en.read_point(r.entries, 7, 3).select(*ENTRY))
query("read_ledger_range", sql("SELECT ledger_id, entry_id, text FROM entries WHERE ledger_id = 7 AND entry_id BETWEEN 5 AND 19", "entries"))(lambda r: en.read_range(r.entries, 7, 5, 20).select(*ENTRY))
query("read_ledger_visible", sql("SELECT ledger_id, entry_id, text FROM entries JOIN (SELECT ledger_id, max(lac) AS m FROM entries GROUP BY 1) USING (ledger_id) WHERE entry_id <= m", "entries"))(lambda r: en.read_visible(r.entries).select(*ENTRY))
query("read_stored_visible", sql("SELECT e.ledger_id, e.entry_id FROM entries e JOIN ledgers l ON l.ledger_id = e.ledger_id WHERE l.last_entry_id IS NOT NULL AND e.entry_id <= l.last_entry_id AND e.entry_id <= l.last_add_confirmed", "entries", "ledgers"))(
    lambda r: r.entries.join(r.ledgers.select("ledger_id", "last_entry_id", "last_add_confirmed"), "ledger_id").where(en.visible(c("entry_id"), c("last_entry_id"), c("last_add_confirmed"))).select("ledger_id", "entry_id")
)
query("next_entry_id", sql("SELECT ledger_id, coalesce(max(entry_id) + 1, 0) AS next_entry_id FROM ledgers LEFT JOIN entries USING (ledger_id) GROUP BY 1", "ledgers", "entries"))(lambda r: en.next_entry_ids(r.ledgers, r.entries))
query("ledger_high_watermark", sql("SELECT ledger_id, max(entry_id) AS last_entry_id, max(entry_id) + 1 AS next_entry_id FROM entries GROUP BY 1", "entries"))(lambda r: en.positions(r.entries).drop("lac"))
query("node_lac", sql("SELECT ledger_id, max(lac) AS lac FROM entries GROUP BY 1", "entries"))(lambda r: en.positions(r.entries).select("ledger_id", "lac"))
query("running_lac", sql("SELECT ledger_id, entry_id, max(lac) OVER w AS node_lac, max(greatest(lac, entry_id)) OVER w AS client_lac FROM entries WINDOW w AS (PARTITION BY ledger_id ORDER BY entry_id)", "entries"))(lambda r: en.running_positions(r.entries).select("ledger_id", "entry_id", "node_lac", "client_lac"))
query("lac_lag", sql("SELECT ledger_id, max(greatest(entry_id - lac, 0)) AS max_lag, CAST(sum(greatest(entry_id - lac, 0)) AS BIGINT) AS sum_lag FROM entries GROUP BY 1", "entries"))(lambda r: en.running_positions(r.entries).groupBy("ledger_id").agg(F.max("lag").alias("max_lag"), F.sum("lag").alias("sum_lag")))

# ---- appends -----------------------------------------------------------------------------------------------------------

FIRST = "SELECT ledger_id, entry_id, min(text) AS text FROM submissions GROUP BY 1, 2"
query("append_dedup_first_wins", sql(FIRST, "submissions"))(lambda r: en.first_wins(r.submissions.select(*ENTRY), ["ledger_id", "entry_id"], ["text"]))
query("append_unstored", sql(f"SELECT * FROM ({FIRST}) WHERE (ledger_id, entry_id) NOT IN (SELECT segment_id, entry_id FROM locations)", "submissions", "locations"))(
    lambda r: en.unstored(en.first_wins(r.submissions.select(*ENTRY), ["ledger_id", "entry_id"], ["text"]), r.locations.select(c("segment_id").alias("ledger_id"), "entry_id"), ["ledger_id", "entry_id"])
)
query("append_fenced_filter", sql("SELECT s.ledger_id, s.entry_id, s.text FROM submissions s LEFT JOIN ledgers l ON l.ledger_id = s.ledger_id AND l.state IN ('InRecovery', 'Closed') WHERE l.ledger_id IS NULL", "submissions", "ledgers"))(
    lambda r: r.submissions.join(r.ledgers.where("state in ('InRecovery', 'Closed')").select("ledger_id"), "ledger_id", "left_anti").select(*ENTRY)
)
query(
    "append_reject_reasons",
    sql(
        """SELECT ledger_id, entry_id, text, CASE WHEN refused IS NOT NULL THEN refused WHEN row_number() OVER (PARTITION BY ledger_id, entry_id, refused IS NULL ORDER BY text, mixed) > 1 THEN 'Duplicate' END AS reason
        FROM (SELECT s.*, CASE WHEN mixed % 53 = 0 THEN 'ChecksumInvalid' WHEN l.state IN ('InRecovery', 'Closed') THEN 'LedgerFenced'
        WHEN s.ledger_id % 2 = 0 AND mixed % 43 = 0 THEN 'KeyMismatch' WHEN s.ledger_id % 2 = 0 AND mixed % 5 <> 0 AND mixed % 47 = 0 THEN 'HmacInvalid' END AS refused
        FROM submissions s LEFT JOIN ledgers l USING (ledger_id))""",
        "submissions", "ledgers",
    ),
)(
    lambda r: en.judged(
        r.submissions, r.ledgers.where("state in ('InRecovery', 'Closed')"), r.submissions.where("ledger_id % 2 = 0").select("ledger_id").distinct().withColumn("stored_key", F.lit("own")), SECRET, ["text", "mixed"]
    ).select(*ENTRY, "reason")
)
query("append_open_only", sql("SELECT ledger_id, count(*) AS n FROM entries JOIN ledgers USING (ledger_id) WHERE state = 'Open' GROUP BY 1", "entries", "ledgers"))(lambda r: r.entries.join(r.ledgers.where("state = 'Open'").select("ledger_id"), "ledger_id", "left_semi").groupBy("ledger_id").agg(F.count("*").alias("n")))
query("write_set", sql("SELECT * FROM write_set", "write_set"))(lambda r: en.write_sets(r.entries, r.ledgers).select("ledger_id", "entry_id", c("position").cast("long").alias("position"), "node_id"))
QUORUM = "SELECT ledger_id, entry_id, count(*) FILTER (ok) AS n_ok, bool_or(fenced) AS any_fenced, CASE WHEN bool_or(fenced) THEN 'LedgerFenced' WHEN count(*) FILTER (ok) >= 2 THEN 'Committed' ELSE 'QuorumNotMet' END AS outcome FROM acks GROUP BY 1, 2"
query("quorum_commit", sql(QUORUM, "acks"))(lambda r: en.quorums(r.acks).drop("ack_quorum"))
query("quorum_failed", sql(f"SELECT ledger_id, entry_id, outcome FROM ({QUORUM}) WHERE outcome <> 'Committed'", "acks"))(lambda r: en.quorums(r.acks).where("outcome <> 'Committed'").select("ledger_id", "entry_id", "outcome"))
query("committed_lac", sql(f"SELECT ledger_id, max(entry_id) AS lac FROM ({QUORUM}) WHERE outcome = 'Committed' GROUP BY 1", "acks"))(lambda r: en.quorums(r.acks).where("outcome = 'Committed'").groupBy("ledger_id").agg(F.max("entry_id").alias("lac")))
query("hedged_latency", sql("SELECT ledger_id, entry_id, b.ms AS ms, b.position AS position, b.node_id AS node_id FROM (SELECT ledger_id, entry_id, min({'ms': position * 5 + latency_ms, 'position': position, 'node_id': node_id}) AS b FROM acks WHERE ok GROUP BY 1, 2)", "acks"))(lambda r: en.hedged(r.acks, 5).withColumn("position", c("position").cast("long")))

# ---- metadata -----------------------------------------------------------------------------------------------------------

joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
query("fragment_ranges", sql("SELECT ledger_id, fragment, first_entry_id, end_entry_id, array_to_string(ensemble, ',') AS ensemble FROM fragments", "fragments"))(lambda r: md.fragment_ranges(r.ledgers).select("ledger_id", "fragment", "first_entry_id", "end_entry_id", joined(c("ensemble")).alias("ensemble")))
query("fragment_asof", sql("SELECT e.ledger_id, e.entry_id, f.first_entry_id FROM entries e JOIN fragments f ON f.ledger_id = e.ledger_id AND e.entry_id >= f.first_entry_id AND (f.end_entry_id IS NULL OR e.entry_id < f.end_entry_id)", "entries", "fragments"))(
    lambda r: r.entries.join(r.ledgers.select("ledger_id", "fragments"), "ledger_id").select("ledger_id", "entry_id", en.owning_fragment(c("fragments"), c("entry_id"))["first_entry_id"].alias("first_entry_id"))
)
query("ensemble_resolve", sql("SELECT ledger_id, fragment, CAST(i AS BIGINT) AS position, ensemble[i + 1] AS node_id, address, address IS NOT NULL AND status <> 'Unavailable' AS resolvable FROM fragments, range(3) AS r(i) LEFT JOIN nodes ON node_id = ensemble[i + 1]", "fragments", "nodes"))(
    lambda r: md.resolved(md.fragment_ranges(r.ledgers), r.nodes).select("ledger_id", "fragment", c("position").cast("long").alias("position"), "node_id", "address", "resolvable")
)
CURRENT = "SELECT ledger_id, ensemble FROM fragments WHERE fragment = 2"
query("spare_selection", sql(f"SELECT ledger_id, array_to_string(list_sort(list(node_id))[1:2], ',') AS spares FROM ({CURRENT}) JOIN nodes ON status = 'ReadWrite' AND NOT list_contains(ensemble, node_id) GROUP BY ledger_id", "fragments", "nodes"))(lambda r: md.spares(r.ledgers, r.nodes, 2).select("ledger_id", joined(c("spares")).alias("spares")))
query(
    "change_fragment",
    sql(
        f"""SELECT ledger_id, last_add_confirmed + 1 AS first_entry_id, array_to_string(list_concat(list_filter(ensemble, lambda x: x NOT IN (1, 2)), list_filter(s, lambda x: x NOT IN (1, 2))[1:len(list_filter(ensemble, lambda x: x IN (1, 2)))]), ',') AS ensemble,
        CASE WHEN len(list_filter(ensemble, lambda x: x NOT IN (1, 2))) + len(list_filter(s, lambda x: x NOT IN (1, 2))[1:len(list_filter(ensemble, lambda x: x IN (1, 2)))]) < 3 THEN 'QuorumNotMet' END AS reason
        FROM (SELECT ledger_id, any_value(ensemble) AS ensemble, list_sort(list(node_id))[1:2] AS s FROM ({CURRENT}) JOIN nodes ON status = 'ReadWrite' AND NOT list_contains(ensemble, node_id) GROUP BY ledger_id) JOIN ledgers USING (ledger_id)
        WHERE list_has_any(ensemble, [CAST(1 AS BIGINT), CAST(2 AS BIGINT)])""",
        "fragments", "nodes", "ledgers",
    ),
)(lambda r: md.changed_fragment(r.ledgers, r.nodes, [1, 2], c("last_add_confirmed") + 1).select("ledger_id", "first_entry_id", joined(c("ensemble")).alias("ensemble"), "reason"))
query("state_transition_cas", sql("SELECT ledger_id, CASE WHEN state = 'Open' THEN 'InRecovery' ELSE state END AS state, state = 'Open' AS changed, version + CASE WHEN state = 'Open' THEN 1 ELSE 0 END AS version FROM ledgers", "ledgers"))(lambda r: md.transition(r.ledgers, "Open", "InRecovery").select("ledger_id", "state", "changed", "version"))
WRITES = "SELECT o_custkey AS ledger_id, o_orderkey % 3 + 1 AS version, o_orderkey AS writer FROM orders"
writes = lambda r: r.table("orders").select(c("o_custkey").alias("ledger_id"), (c("o_orderkey") % 3 + 1).alias("version"), c("o_orderkey").alias("writer"))
query(
    "metadata_put_cas",
    sql(
        f"""SELECT w.ledger_id, w.version, writer, CASE WHEN l.version IS NULL THEN 'LedgerNotFound' WHEN w.version = l.version AND rank = 1 THEN 'Written' ELSE 'CasConflict' END AS outcome, CASE WHEN w.version = l.version AND rank = 1 THEN w.version + 1 END AS new_version
        FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, version ORDER BY writer) AS rank FROM ({WRITES})) w LEFT JOIN ledgers l ON l.ledger_id = w.ledger_id""",
        "ledgers",
    ),
)(lambda r: md.put(r.ledgers, writes(r)))
query("create_ledger", sql("SELECT s_suppkey * 20 AS ledger_id, CASE WHEN l.ledger_id IS NULL THEN 'Created' ELSE 'AlreadyExists' END AS outcome, CASE WHEN l.ledger_id IS NULL THEN CAST(1 AS BIGINT) END AS version, CASE WHEN l.ledger_id IS NULL THEN 'Open' END AS state FROM supplier LEFT JOIN ledgers l ON l.ledger_id = s_suppkey * 20", "ledgers"))(
    lambda r: md.created(r.table("supplier").select((c("s_suppkey") * 20).alias("ledger_id")), r.ledgers)
)
query("seal_ledger", sql("SELECT ledger_id, 'Closed' AS state, CASE WHEN state = 'Closed' THEN last_entry_id ELSE m END AS last_entry_id, CASE WHEN state = 'Closed' THEN version ELSE version + 1 END AS version FROM ledgers JOIN (SELECT ledger_id, max(entry_id) AS m FROM entries GROUP BY 1) USING (ledger_id)", "ledgers", "entries"))(
    lambda r: md.sealed(r.ledgers, en.positions(r.entries).select("ledger_id", c("last_entry_id").alias("final_lac")))
)
query("delete_ledger", sql("SELECT ledger_id, state FROM ledgers WHERE state <> 'Deleted'", "ledgers"))(lambda r: md.removed(r.ledgers, r.ledgers.where("state = 'Deleted'")).select("ledger_id", "state"))
query("list_ledgers", sql("SELECT ledger_id, state, last_entry_id, last_add_confirmed, version FROM ledgers", "ledgers"))(lambda r: r.ledgers.drop("fragments"))
query("list_nodes", sql("SELECT * FROM nodes", "nodes"))(lambda r: r.nodes)
query("next_ledger_ids", sql("SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS ledger_id FROM orders"))(lambda r: md.numbered(r.table("orders").select("o_orderkey"), r.table("customer").agg(F.max("c_custkey") + 1).scalar(), "o_orderkey", 4096).select("o_orderkey", "ledger_id"))
query("options_valid", sql("SELECT o_orderkey, o_orderkey % 6 BETWEEN 1 AND o_custkey % 6 AND o_custkey % 6 <= o_orderkey % 7 AS valid FROM orders"))(lambda r: r.table("orders").select("o_orderkey", E.options_valid(c("o_orderkey") % 7, c("o_custkey") % 6, c("o_orderkey") % 6).alias("valid")))
ANSWERS = "SELECT c_custkey AS ledger_id, CAST((c_custkey * 7 + 2 + i) % (SELECT count(*) FROM supplier) AS BIGINT) AS node_id, (c_custkey + i) % 9 AS lac FROM customer, range(3) AS r(i) WHERE (c_custkey + i) % 4 <> 0"


def answers(r: Relations) -> DataFrame:
    members = md.fragment_ranges(r.ledgers).where("fragment = 2").select("ledger_id", F.posexplode("ensemble").alias("i", "node_id"))
    return members.where((c("ledger_id") + c("i")) % 4 != 0).select("ledger_id", "node_id", ((c("ledger_id") + c("i")) % 9).alias("lac"))


SEALED = f"SELECT l.ledger_id, coalesce(max(a.lac), 0) AS lac, count(a.lac) AS n_answers, 'Closed' AS state, {{}} AS last_entry_id FROM ledgers l LEFT JOIN ({ANSWERS}) a USING (ledger_id) WHERE l.state IN ('Open', 'InRecovery') GROUP BY 1"
query("fence_and_seal", sql(SEALED.format("CASE WHEN coalesce(max(a.lac), 0) >= 1 THEN max(a.lac) - 1 END"), "ledgers"))(lambda r: md.fence_and_seal(r.ledgers, answers(r)))
query("fence_and_seal_inclusive", sql(SEALED.format("coalesce(max(a.lac), 0)"), "ledgers"))(lambda r: md.fence_and_seal(r.ledgers, answers(r), inclusive=True))
query("fence_ledger", sql("SELECT ledger_id, true AS is_fenced, coalesce(max(entry_id), 0) AS highest FROM ledgers LEFT JOIN entries USING (ledger_id) WHERE state = 'InRecovery' GROUP BY 1", "ledgers", "entries"))(
    lambda r: r.ledgers.where("state = 'InRecovery'").select("ledger_id").join(en.positions(r.entries), "ledger_id", "left").select("ledger_id", F.lit(True).alias("is_fenced"), F.coalesce("last_entry_id", F.lit(0)).alias("highest"))
)
query("fenced_ledgers", sql("SELECT DISTINCT ledger_id FROM ledgers WHERE state IN ('InRecovery', 'Closed')", "ledgers"))(lambda r: r.ledgers.where("state in ('InRecovery', 'Closed')").select("ledger_id").distinct())
query("known_ledgers", sql("SELECT DISTINCT ledger_id FROM entries", "entries"))(lambda r: r.entries.select("ledger_id").distinct())
query("ledger_state", sql("SELECT state, count(*) AS n FROM ledgers GROUP BY 1", "ledgers"))(lambda r: r.ledgers.groupBy("state").agg(F.count("*").alias("n")))
KEY = "CASE WHEN mixed % 43 = 0 THEN 'other' WHEN mixed % 3 = 0 THEN 'own' END"
query("master_key_conflicts", sql(f"SELECT ledger_id, min_by({KEY}, mixed * 10 + entry_id) FILTER ({KEY} IS NOT NULL) AS stored_key, count(DISTINCT {KEY}) > 1 AS conflict, count(*) AS n_offers FROM submissions GROUP BY 1", "submissions"))(
    lambda r: md.key_registrations(r.submissions.withColumn("seq", c("mixed") * 10 + c("entry_id")))
)
query("lease_expired", sql("SELECT node_id, last_heartbeat_ms FROM nodes WHERE 60000 - last_heartbeat_ms > 15000", "nodes"))(lambda r: md.expired_leases(r.nodes, F.lit(60_000)).select("node_id", "last_heartbeat_ms"))

# ---- functions -----------------------------------------------------------------------------------------------------------

query("crc32_digest")(lambda r: r.entries.select("ledger_id", "entry_id", E.digest(c("data")).alias("digest")))
query("record_crc")(lambda r: r.entries.select("ledger_id", "entry_id", E.record_crc(c("ledger_id"), c("entry_id"), c("data")).alias("crc")))
_K = SECRET.ljust(64, b"\0")
_PADS = ["unhex('" + bytes(x ^ p for x in _K).hex() + "')" for p in (0x36, 0x5C)]
_BE = "unhex(lpad(to_hex({}), 16, '0'))"
_MESSAGE = f"{_BE.format('ledger_id')} || {_BE.format('entry_id')} || {_BE.format('lac')} || encode(text)"
HMAC = f"sha256({_PADS[1]} || unhex(sha256({_PADS[0]} || {_MESSAGE})))"
signed = lambda: E.hmac_sha256(SECRET, E.entry_message(c("ledger_id"), c("entry_id"), c("lac"), c("data")))
query("hmac_sign", sql(f"SELECT ledger_id, entry_id, {HMAC} AS hmac FROM entries", "entries"))(lambda r: r.entries.select("ledger_id", "entry_id", F.lower(F.hex(signed())).alias("hmac")))
query("hmac_verify", sql("SELECT ledger_id, count(*) FILTER (seq % 11 <> 0 OR seq % 4 = 0) AS valid, count(*) FILTER (seq % 11 = 0 AND seq % 4 <> 0) AS invalid FROM entries GROUP BY 1", "entries"))(
    lambda r: r.entries.withColumn("hmac", F.when(c("seq") % 4 != 0, F.when(c("seq") % 11 == 0, F.sha2("data", 256).cast("binary")).otherwise(signed())))
    .withColumn("ok", E.hmac_valid(c("hmac"), SECRET, E.entry_message(c("ledger_id"), c("entry_id"), c("lac"), c("data"))))
    .groupBy("ledger_id").agg(F.count_if("ok").alias("valid"), F.count_if(~c("ok")).alias("invalid"))
)
query("key_encode_be", sql("SELECT ledger_id, entry_id, lpad(to_hex(ledger_id), 16, '0') || lpad(to_hex(entry_id), 16, '0') AS key FROM entries", "entries"))(lambda r: r.entries.select("ledger_id", "entry_id", F.hex(E.key(c("ledger_id"), c("entry_id"))).alias("key")))
query("key_decode_be", sql("SELECT ledger_id, entry_id FROM entries", "entries"))(lambda r: r.entries.select(E.key(c("ledger_id"), c("entry_id")).alias("k")).select(E.key_ledger(c("k")).alias("ledger_id"), E.key_entry(c("k")).alias("entry_id")))
query("align_up", sql("SELECT id, (byte_len + 4095) // 4096 * 4096 AS aligned, byte_len // 4096 * 4096 AS resume FROM segments", "segments"))(lambda r: r.segments.select("id", E.align_up(c("byte_len")).alias("aligned"), E.resume_offset(c("byte_len")).alias("resume")))
query("block_start", sql('SELECT segment_id, "offset", length, "offset" // 262144 * 262144 AS block, ("offset" + length - 1) // 262144 - "offset" // 262144 + 1 AS n_blocks FROM locations', "locations"))(lambda r: sg.block_reads(r.locations))
query("payload_range", sql('SELECT segment_id, "offset", "offset" % 262144 + 20 AS payload_begin, "offset" % 262144 + length - 4 AS payload_end FROM locations', "locations"))(
    lambda r: r.locations.withColumn("p", E.payload_in_block(c("offset"), c("length"))).select("segment_id", "offset", c("p.begin").alias("payload_begin"), c("p.end").alias("payload_end"))
)
HEX = "lpad(lower(to_hex(id)), 16, '0')"
query("segment_file_name", sql(f"SELECT id, 'seg-' || {HEX} || '.seg' AS wal, 'entry-' || {HEX} || '.ent' AS entry, 'entries/' || {HEX} || '.ent' AS remote, id AS parsed FROM segments", "segments"))(
    lambda r: r.segments.select("id", E.wal_file(c("id")).alias("wal"), E.entry_file(c("id")).alias("entry"), E.remote_key(c("id")).alias("remote"), E.file_id(E.wal_file(c("id"))).alias("parsed"))
)
MESSAGE = "CASE o_orderkey % 3 WHEN 0 THEN 'rpc: ledger ' || o_custkey || ' is fenced' WHEN 1 THEN 'entry ' || o_orderkey || ' not found in ledger ' || o_custkey ELSE 'boom' END"


def messages(r: Relations) -> DataFrame:
    o, k = c("o_orderkey"), c("o_custkey").cast("string")
    text = F.when(o % 3 == 0, F.concat(F.lit("rpc: ledger "), k, F.lit(" is fenced"))).when(o % 3 == 1, F.concat(F.lit("entry "), o.cast("string"), F.lit(" not found in ledger "), k)).otherwise("boom")
    return r.table("orders").select("o_orderkey", text.alias("message"))


query("error_parse", sql("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS fenced, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS entry_id, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS ledger_id FROM orders"))(
    lambda r: messages(r).select("o_orderkey", E.fenced_ledger(c("message")).alias("fenced"), E.missing_entry(c("message"))["entry_id"].alias("entry_id"), E.missing_entry(c("message"))["ledger_id"].alias("ledger_id"))
)
query("status_map", sql("SELECT reason, CASE reason WHEN 'LedgerFenced' THEN 'FAILED_PRECONDITION' WHEN 'EntryNotFound' THEN 'NOT_FOUND' ELSE 'INTERNAL' END AS code, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'LedgerFenced' WHEN 1 THEN 'EntryNotFound' ELSE 'Storage' END AS reason FROM orders) GROUP BY 1, 2"))(
    lambda r: r.table("orders").select(F.when(c("o_orderkey") % 3 == 0, "LedgerFenced").when(c("o_orderkey") % 3 == 1, "EntryNotFound").otherwise("Storage").alias("reason")).groupBy("reason", E.status_code(c("reason")).alias("code")).agg(F.count("*").alias("n"))
)
query("addr_normalize", sql("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'http://127.0.0.1:' || s_suppkey WHEN 1 THEN 'https://127.0.0.1/x' ELSE 'http://' || s_name END AS address FROM supplier"))(
    lambda r: r.table("supplier").select("s_suppkey", E.normal_address(F.when(c("s_suppkey") % 3 == 0, F.concat(F.lit("  localhost:"), c("s_suppkey").cast("string"))).when(c("s_suppkey") % 3 == 1, "https://localhost/x ").otherwise(c("s_name"))).alias("address"))
)
query("csv_split", sql("SELECT s_suppkey, [s_name, 'b'] AS parts FROM supplier"))(lambda r: r.table("supplier").select("s_suppkey", E.csv_parts(F.concat(F.lit(" , "), c("s_name"), F.lit(" ,, b ,"))).alias("parts")))
query("strip_prefix", sql("SELECT s_suppkey, s_name AS name FROM supplier"))(lambda r: r.table("supplier").select("s_suppkey", E.without_prefix(F.concat(F.lit("/nodes/"), c("s_name")), "/nodes/").alias("name")))
query("saturating_sub", sql("SELECT id, greatest(byte_len - 10000000, 0) AS saturated, CASE WHEN byte_len >= 10000000 THEN byte_len - 10000000 END AS checked FROM segments", "segments"))(lambda r: r.segments.select("id", E.saturating_sub(c("byte_len"), F.lit(10_000_000)).alias("saturated"), E.checked_sub(c("byte_len"), F.lit(10_000_000)).alias("checked")))
query("metadata_json", sql("SELECT ledger_id, state, version FROM ledgers", "ledgers"))(
    lambda r: r.ledgers.select(F.to_json(F.struct("ledger_id", "state", "version", "fragments")).alias("j")).select(F.from_json("j", "ledger_id long, state string, version long, fragments array<struct<first_entry_id: long>>").alias("x")).where(F.size("x.fragments") == 3).select("x.ledger_id", "x.state", "x.version")
)

# ---- layout -----------------------------------------------------------------------------------------------------------

query("record_offsets", sql('SELECT ledger_id, entry_id, length, CAST(coalesce(sum(length) OVER (PARTITION BY ledger_id ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conv_entries', "conv_entries"))(
    lambda r: sg.record_offsets(r.conv_entries, ["ledger_id"], ["entry_id"]).select("ledger_id", "entry_id", "length", "offset")
)
query("padding_waste", sql("SELECT ledger_id, count(*) AS n_records, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum((length + 4095) // 4096 * 4096) AS BIGINT) AS page_per_record, CAST((sum(length) + 4095) // 4096 * 4096 AS BIGINT) AS written, CAST((sum(length) + 4095) // 4096 * 4096 - sum(length) AS BIGINT) AS waste FROM conv_entries GROUP BY 1", "conv_entries"))(lambda r: sg.padding(r.conv_entries, ["ledger_id"]))
query("segment_bytes_per_ledger", sql("SELECT segment_id, ledger_id, CAST(sum(length) AS BIGINT) AS bytes FROM locations GROUP BY 1, 2", "locations"))(lambda r: sg.ledger_bytes(r.locations).select("segment_id", F.explode("ledger_sizes").alias("ledger_id", "bytes")))
BATCHES = """n AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY entry_id) AS k FROM conv_entries),
    b(ledger_id, entry_id, length, k, batch, filled) AS (SELECT ledger_id, entry_id, length, k, CAST(0 AS BIGINT), length FROM n WHERE k = 1
    UNION ALL SELECT n.ledger_id, n.entry_id, n.length, n.k, CASE WHEN b.filled >= 1500 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.filled >= 1500 THEN n.length ELSE b.filled + n.length END FROM b JOIN n ON n.ledger_id = b.ledger_id AND n.k = b.k + 1)"""
batches = lambda r: folds.greedy_batches(r.conv_entries.select("ledger_id", "entry_id", "length"), ["ledger_id"], ["entry_id"], "length", 1500)
query("batch_greedy", sql(f"{BATCHES} SELECT ledger_id, entry_id, length, batch FROM b", "conv_entries", recursive=True))(batches)
WRITTEN = "z AS (SELECT ledger_id, batch, CAST((sum(length) + 4095) // 4096 * 4096 AS BIGINT) AS size FROM b GROUP BY 1, 2)"
ROLL = "s(ledger_id, batch, size, segment, segment_offset) AS (SELECT ledger_id, batch, size, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM z WHERE batch = 0 UNION ALL SELECT z.ledger_id, z.batch, z.size, CASE WHEN s.segment_offset + s.size >= 8192 THEN s.segment + 1 ELSE s.segment END, CASE WHEN s.segment_offset + s.size >= 8192 THEN 0 ELSE s.segment_offset + s.size END FROM s JOIN z ON z.ledger_id = s.ledger_id AND z.batch = s.batch + 1)"
rolled = lambda r: folds.rolled_segments(batches(r).groupBy("ledger_id", "batch").agg(E.align_up(F.sum("length")).alias("size")), ["ledger_id"], ["batch"], "size", 8192)
query("segment_roll_greedy", sql(f"{BATCHES}, {WRITTEN}, {ROLL} SELECT * FROM s", "conv_entries", recursive=True))(rolled)
query("flush_ticks", sql("SELECT ledger_id, tick, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes) AS BIGINT) >= 200 AS by_size FROM (SELECT ledger_id, epoch_us(appended_at) // 500000 AS tick, octet_length(encode(text)) AS bytes FROM entries) GROUP BY 1, 2", "entries"))(
    lambda r: r.entries.select("ledger_id", F.expr("unix_micros(cast(appended_at as timestamp)) div 500000").alias("tick"), F.octet_length("text").cast("long").alias("bytes")).groupBy("ledger_id", "tick").agg(F.sum("bytes").alias("bytes")).withColumn("by_size", c("bytes") >= 200)
)
TIER = "CASE WHEN seq % 3 = 0 THEN 'evicted' WHEN seq % 2 = 0 THEN 'warm' ELSE 'hot' END"
query("cache_tiers", sql(f"SELECT {TIER} AS tier, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, sum(octet_length(encode(text))) >= 65536 AS is_full FROM entries GROUP BY 1", "entries"))(
    lambda r: sg.cache_tiers(r.entries, c("seq") % 3 == 0, c("seq") % 2 == 0).groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).withColumn("is_full", c("bytes") >= 65536)
)

# ---- registry, tiers, garbage ------------------------------------------------------------------------------------------------

query("registry_get", sql("SELECT id, kind, status, byte_len FROM segments WHERE id = 42", "segments"))(lambda r: r.segments.where("id = 42").drop("mtime"))
query("registry_by_status", sql("SELECT id, kind, byte_len FROM segments WHERE status = 'Local'", "segments"))(lambda r: r.segments.where("status = 'Local'").select("id", "kind", "byte_len"))
query("registry_cas", sql("SELECT id, CASE WHEN status = 'Local' THEN 'Offloading' ELSE status END AS status, status = 'Local' AS changed FROM segments", "segments"))(lambda r: sg.cas_status(r.segments, "Local", "Offloading").select("id", "status", "changed"))
query("registry_cas_remote", sql(f"SELECT id, CASE WHEN status = 'Local' THEN 'S3' ELSE status END AS status, status = 'Local' AS changed, CASE WHEN status = 'Local' THEN 'entries/' || {HEX} || '.ent' END AS remote_key, CASE WHEN status <> 'Local' THEN 'entry-' || {HEX} || '.ent' END AS local_path FROM segments", "segments"))(
    lambda r: sg.cas_remote(r.segments, "Local").select("id", "status", "changed", "remote_key", "local_path")
)
query("registry_upsert", sql("SELECT id, coalesce(w.status, s.status) AS status, coalesce(w.byte_len, s.byte_len) AS byte_len FROM segments s FULL JOIN (SELECT l_orderkey AS id, 'Local' AS status, max(l_partkey * 1000 + l_suppkey) AS byte_len FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1) w USING (id)", "segments"))(
    lambda r: sg.upserted(r.segments.select("id", "status", "byte_len"), r.table("lineitem").where("l_orderkey % 5 = 0").select(c("l_orderkey").alias("id"), F.lit("Local").alias("status"), (c("l_partkey") * 1000 + c("l_suppkey")).alias("byte_len"), (c("l_partkey") * 1000 + c("l_suppkey")).alias("seq")), ["id"], "seq")
)
query("location_upsert", sql('SELECT ledger_id, entry_id, max({\'s\': segment_id, \'o\': "offset"}).s AS segment_id FROM locations GROUP BY 1, 2', "locations"))(lambda r: r.locations.groupBy("ledger_id", "entry_id").agg(F.max(F.struct("segment_id", "offset")).alias("m")).select("ledger_id", "entry_id", "m.segment_id"))
query("location_delete", sql("SELECT ledger_id, entry_id, segment_id FROM locations WHERE index = 'wal' AND (ledger_id, entry_id) NOT IN (SELECT ledger_id, entry_id FROM locations WHERE index = 'entry')", "locations"))(
    lambda r: en.unstored(r.locations.where("index = 'wal'"), r.locations.where("index = 'entry'"), ["ledger_id", "entry_id"]).select("ledger_id", "entry_id", "segment_id")
)
query("disk_pressure", sql("SELECT CAST(sum(byte_len) AS BIGINT) AS local_bytes, sum(byte_len) > 1000000000 AS pressure FROM segments WHERE status = 'Local'", "segments"))(lambda r: sg.local_bytes(r.segments).withColumn("pressure", c("local_bytes") > 1_000_000_000))
now = lambda: F.lit(NOW).cast("timestamp_ntz")
OLD = f"mtime <= TIMESTAMP '{NOW}' - INTERVAL 365 DAY"
query("offload_eligible", sql(f"SELECT id, byte_len FROM segments WHERE status = 'Local' AND ({OLD} OR (SELECT sum(byte_len) FROM segments WHERE status = 'Local') > 4000000000000)", "segments"))(lambda r: sg.offload_eligible(r.segments, now(), 365 * 86400, 4_000_000_000_000).select("id", "byte_len"))
query("multipart_plan", sql('SELECT id, k + 1 AS part, k * 10485760 AS "offset", least(10485760, byte_len - k * 10485760) AS length, byte_len > 10485760 AS multipart FROM segments, unnest(range(greatest((byte_len + 10485759) // 10485760, 1))) AS t(k)', "segments"))(lambda r: sg.multipart_plan(r.segments))
query("next_segment_id", sql("SELECT max(id) + 1 AS next_id FROM segments", "segments"))(
    lambda r: sg.next_segment_id(r.segments.select(F.when(c("id") % 2 == 0, E.wal_file(c("id"))).otherwise("active.seg").alias("name")), r.segments)
)
query("segment_files_sorted", sql("SELECT id FROM segments WHERE kind = 'Wal'", "segments"))(lambda r: r.segments.where("kind = 'Wal'").select(E.file_id(E.wal_file(c("id"))).alias("id")).orderBy("id"))
query("orphans_sealed", sql("SELECT id, CASE WHEN status IN ('Active', 'Offloading') THEN 'Local' ELSE status END AS status FROM segments", "segments"))(lambda r: sg.orphans_sealed(r.segments).select("id", "status"))
query("referenced_segments", sql("SELECT DISTINCT segment_id FROM locations WHERE index = 'wal'", "locations"))(lambda r: sg.referenced(r.locations))
query("wal_gc_candidates", sql(f"SELECT id FROM segments WHERE kind = 'Wal' AND status IN ('Local', 'S3') AND id NOT IN (SELECT segment_id FROM locations WHERE index = 'wal') AND ({OLD} OR (SELECT sum(byte_len) FROM segments WHERE status = 'Local') > 4000000000000)", "segments", "locations"))(
    lambda r: sg.wal_garbage(r.segments, r.locations, now(), 365 * 86400, 4_000_000_000_000).select("id")
)
query(
    "tier_route",
    sql(
        """, e AS (SELECT ledger_id, entry_id, max({'s': segment_id, 'o': "offset", 'l': length}) AS x FROM locations WHERE index = 'entry' GROUP BY 1, 2),
        v AS (SELECT ledger_id, entry_id, max({'s': segment_id, 'o': "offset", 'l': length}) AS x FROM locations WHERE index = 'wal' GROUP BY 1, 2),
        w AS (SELECT s_suppkey AS ledger_id, p_partkey AS entry_id, (s_suppkey + p_partkey) % 13 = 0 AS cached FROM supplier, part WHERE p_partkey % 10 = s_suppkey % 10),
        j AS (SELECT w.*, CASE WHEN cached THEN 'cache' WHEN status IN ('Local', 'Active', 'Offloading') THEN 'local' WHEN status = 'S3' THEN 'remote' WHEN v.x IS NOT NULL THEN 'wal' ELSE 'not_found' END AS route, e.x AS ex, v.x AS vx, status
        FROM w LEFT JOIN e USING (ledger_id, entry_id) LEFT JOIN v USING (ledger_id, entry_id) LEFT JOIN segments s ON s.id = e.x.s)
        SELECT ledger_id, entry_id, route, CASE WHEN route IN ('local', 'remote') THEN ex.s WHEN route = 'wal' THEN vx.s END AS segment_id, CASE WHEN route IN ('local', 'remote') THEN ex.o WHEN route = 'wal' THEN vx.o END AS "offset",
        route = 'local' AND status <> 'Active' AS cacheable FROM j""".lstrip(),
        "locations", "segments",
    ).replace(") ,", "),", 1),
)(
    lambda r: sg.tier_routes_by_group(
        r.table("part").select(c("p_partkey").alias("entry_id")), r.table("supplier").select(c("s_suppkey").alias("ledger_id")), lambda key: key % 10, (c("ledger_id") + c("entry_id")) % 13 == 0, r.locations, r.segments
    ).drop("length")
)

# ---- recovery -----------------------------------------------------------------------------------------------------------

failed = lambda r: r.nodes.where("node_id % 10 = 3").select("node_id")
TASKS = """, healthy AS (SELECT node_id FROM nodes WHERE status = 'ReadWrite' AND node_id % 10 <> 3),
    hit AS (SELECT DISTINCT f.ledger_id, f.first_entry_id, f.fragment, f.ensemble, n.node_id FROM fragments f JOIN ledgers l ON l.ledger_id = f.ledger_id AND l.state <> 'Deleted' JOIN nodes n ON n.node_id % 10 = 3 AND list_contains(f.ensemble, n.node_id)),
    tasks AS (SELECT ledger_id, node_id AS failed_node, (SELECT min(h.node_id) FROM healthy h WHERE NOT list_contains(hit.ensemble, h.node_id)) AS target_node, first_entry_id AS from_entry_id FROM hit)"""
with_tasks = lambda body, *names: sql(f"{TASKS} {body}", "fragments", "nodes", *names).replace(") ,", "),", 1)
tasks = lambda r: recovery.audit_tasks(r.ledgers, r.nodes, failed(r))
query("audit_tasks", with_tasks("SELECT * FROM tasks WHERE target_node IS NOT NULL"))(tasks)
query("under_replicated", with_tasks("SELECT count(*) AS n_fragments, count(DISTINCT ledger_id) AS n_ledgers FROM tasks WHERE target_node IS NOT NULL"))(lambda r: tasks(r).agg(F.count("*").alias("n_fragments"), F.count_distinct("ledger_id").alias("n_ledgers")))
query("affected_ledgers", sql("SELECT DISTINCT ledger_id FROM fragments WHERE list_contains(ensemble, CAST(5 AS BIGINT))", "fragments"))(lambda r: r.ledgers.where(md.in_some_ensemble(c("fragments"), F.lit(5).cast("long"))).select("ledger_id"))
query("copy_plan", with_tasks("SELECT t.ledger_id, failed_node, target_node, list_filter(f.ensemble, lambda x: x <> failed_node)[1] AS source_node, from_entry_id, greatest(coalesce(f.end_entry_id, l.last_add_confirmed), from_entry_id) AS end_entry_id FROM tasks t JOIN fragments f ON f.ledger_id = t.ledger_id AND f.first_entry_id = from_entry_id JOIN ledgers l ON l.ledger_id = t.ledger_id WHERE target_node IS NOT NULL"))(lambda r: recovery.copy_plan(tasks(r), r.ledgers))
query("ensemble_swap", with_tasks("SELECT t.ledger_id, from_entry_id, failed_node, array_to_string(list_transform(f.ensemble, lambda x: CASE WHEN x = failed_node THEN target_node ELSE x END), ',') AS ensemble FROM tasks t JOIN fragments f ON f.ledger_id = t.ledger_id AND f.first_entry_id = from_entry_id WHERE target_node IS NOT NULL"))(
    lambda r: recovery.swapped_ensembles(tasks(r), r.ledgers).select("ledger_id", "from_entry_id", "failed_node", joined(c("ensemble")).alias("ensemble"))
)
SCRUB = "SELECT ledger_id, entry_id, min_by(digest, position) AS baseline, count(*) AS n_answers, count(*) - count(*) FILTER (digest = first) AS n_mismatches FROM (SELECT *, first_value(digest) OVER (PARTITION BY ledger_id, entry_id ORDER BY position) AS first FROM replicas WHERE digest IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 2"
query("scrub_candidates", sql(f"SELECT ledger_id, count(*) AS n FROM ({SCRUB}) JOIN ledgers USING (ledger_id) WHERE state <> 'Deleted' AND last_entry_id IS NOT NULL AND entry_id <= last_entry_id GROUP BY 1", "replicas", "ledgers"))(
    lambda r: recovery.scrubbed(r.replicas).join(r.ledgers.where("state <> 'Deleted' and last_entry_id is not null").select("ledger_id", "last_entry_id"), "ledger_id").where("entry_id <= last_entry_id").groupBy("ledger_id").agg(F.count("*").alias("n"))
)
query("scrub_mismatches", sql(f"SELECT * FROM ({SCRUB}) WHERE n_mismatches > 0", "replicas"))(lambda r: recovery.scrubbed(r.replicas).where("n_mismatches > 0"))
query("scrub_error_count", sql(f"SELECT count(*) AS n_entries, CAST(sum(n_mismatches) AS BIGINT) AS n_errors FROM ({SCRUB}) WHERE n_mismatches > 0", "replicas"))(lambda r: recovery.scrubbed(r.replicas).where("n_mismatches > 0").agg(F.count("*").alias("n_entries"), F.sum("n_mismatches").alias("n_errors")))
CHECK = "SELECT id AS segment_id, CAST(400000 AS BIGINT) AS checkpoint FROM segments WHERE id % 7 = 0"
REPLAY = f"SELECT ledger_id, entry_id, segment_id, \"offset\" FROM locations LEFT JOIN ({CHECK}) USING (segment_id) WHERE index = 'wal' AND \"offset\" >= coalesce(checkpoint, 0) AND (ledger_id, entry_id) NOT IN (SELECT ledger_id, entry_id FROM locations WHERE index = 'entry')"
checkpoints = lambda r: r.segments.where("id % 7 = 0").select(c("id").alias("segment_id"), F.lit(400_000).cast("long").alias("checkpoint"))
replay = lambda r: recovery.replay_candidates(r.locations.where("index = 'wal'"), r.locations.where("index = 'entry'"), checkpoints(r))
query("wal_replay_missing", sql(REPLAY, "locations", "segments"))(lambda r: replay(r).select("ledger_id", "entry_id", "segment_id", "offset"))
query("checkpoint_get", sql(f"SELECT id AS segment_id, coalesce(checkpoint, 0) AS checkpoint FROM segments LEFT JOIN ({CHECK}) ON segment_id = id", "segments"))(lambda r: r.segments.select(c("id").alias("segment_id")).join(checkpoints(r), "segment_id", "left").select("segment_id", F.coalesce("checkpoint", F.lit(0)).alias("checkpoint")))
TORN = "SELECT l.*, coalesce(id IS NOT NULL AND \"offset\" >= 600000, false) AS purged FROM locations l LEFT JOIN segments s ON s.id = l.segment_id AND s.id % 9 = 0"
torn = lambda r: recovery.torn_tail(r.locations, r.segments.where("id % 9 = 0").select(c("id").alias("segment_id"), F.lit(600_000).alias("valid_length")))
query("torn_tail_purge", sql(f"SELECT ledger_id, entry_id, segment_id, \"offset\", purged FROM ({TORN})", "locations", "segments"))(lambda r: torn(r).select("ledger_id", "entry_id", "segment_id", "offset", "purged"))
MISSING = f"SELECT DISTINCT p.ledger_id, p.entry_id, q.ledger_id IS NOT NULL AS recovered FROM (SELECT * FROM ({TORN}) WHERE purged) p LEFT JOIN (SELECT DISTINCT ledger_id, entry_id FROM ({REPLAY})) q ON q.ledger_id = p.ledger_id AND q.entry_id = p.entry_id"
missing = lambda r: recovery.still_missing(torn(r).where("purged"), replay(r), ["ledger_id", "entry_id"])
query("replay_recovered", sql(MISSING, "locations", "segments"))(missing)
query("recovery_stats", sql(f"SELECT (SELECT count(DISTINCT segment_id) FROM locations WHERE index = 'wal') AS segments_scanned, (SELECT count(*) FROM locations WHERE index = 'wal') AS records_scanned, (SELECT count(*) FROM ({REPLAY})) AS records_replayed, (SELECT count(*) FROM ({TORN}) WHERE purged) AS locations_purged, (SELECT count(*) FROM ({MISSING}) WHERE recovered) AS purged_recovered, (SELECT count(*) FROM ({MISSING}) WHERE NOT recovered) AS purged_missing", "locations", "segments"))(
    lambda r: recovery.stats(r.locations.where("index = 'wal'"), replay(r), torn(r), missing(r))
)
query("segments_to_replay", sql("SELECT id, status FROM segments WHERE kind = 'Wal' AND status IN ('Local', 'Active')", "segments"))(lambda r: recovery.segments_to_replay(r.segments).select("id", "status"))
query("unregistered_segments", sql("SELECT id FROM segments WHERE status = 'S3'", "segments"))(lambda r: recovery.unregistered(r.segments.select(E.wal_file(c("id")).alias("name")), r.segments.where("status <> 'S3'"), c("name")).select("id"))

# ---- health and metrics -------------------------------------------------------------------------------------------------------

P99 = "SELECT node, seq, list_sort(v)[least(CAST(floor(len(v) * 99 / 100) AS BIGINT), len(v) - 1) + 1] AS p99_ms, len(v) AS n_samples, bytes_so_far FROM (SELECT node, seq, list(elapsed_ms) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS v, CAST(sum(bytes) OVER (PARTITION BY node ORDER BY seq) AS BIGINT) AS bytes_so_far FROM latencies)"
STATUS = f"SELECT *, CASE WHEN bytes_so_far >= 20000 OR (n_samples >= 10 AND p99_ms > 190) THEN 'ReadOnly' ELSE 'ReadWrite' END AS status FROM ({P99})"
rolling = lambda r: health.rolling(r.latencies, "node", "seq", 100).select("node", "seq", "p99_ms", "n_samples", "bytes_so_far")
query("rolling_p99", sql(P99, "latencies"))(rolling)
query("health_status", sql(STATUS, "latencies"))(lambda r: health.status(rolling(r), 20_000, 190))
query("health_changes", sql(f"SELECT node, seq, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY node ORDER BY seq), 'ReadWrite') AS before FROM ({STATUS})) WHERE status <> before", "latencies"))(lambda r: health.changes(health.status(rolling(r), 20_000, 190), "node", "seq").select("node", "seq", "status"))
query(
    "replication_histogram",
    sql(
        """SELECT le, count(*) FILTER (seconds <= le) AS cumulative, count(*) AS n, round(sum(seconds), 3) AS total
        FROM (SELECT elapsed_ms / 1000 AS seconds FROM latencies), (SELECT unnest([0.1::DOUBLE, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0]) AS le) GROUP BY 1""",
        "latencies",
    ),
)(
    lambda r: health.histogram(r.latencies.withColumn("seconds", c("elapsed_ms") / 1000), "seconds", health.REPLICATION_BUCKETS_S, []).withColumn("total", F.round("total", 3))
)
query("append_histogram", sql("SELECT l.node, le, count(*) FILTER (elapsed_ms <= le) AS cumulative, count(*) AS n, CAST(sum(elapsed_ms) AS BIGINT) AS total FROM latencies l, (SELECT unnest([0.1::DOUBLE, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]) AS le) GROUP BY 1, 2", "latencies"))(lambda r: health.histogram(r.latencies, "elapsed_ms", health.APPEND_BUCKETS_MS, ["node"]))
query("counters", sql("SELECT count(*) AS entries_written, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_written, (SELECT count(*) FROM ledgers WHERE state IN ('InRecovery', 'Closed')) AS fences FROM entries", "entries", "ledgers"))(
    lambda r: r.entries.agg(F.count("*").alias("entries_written"), F.sum(F.octet_length("text").cast("long")).alias("bytes_written")).crossJoin(r.ledgers.agg(F.count_if(c("state").isin("InRecovery", "Closed")).alias("fences")))
)

# ---- key-value ------------------------------------------------------------------------------------------------------------

FOLD = """o AS (SELECT *, row_number() OVER (PARTITION BY table_id, key ORDER BY seq) AS k FROM kv_ops),
    f(table_id, key, seq, op, k, value_after, version, success, found) AS (
    SELECT table_id, key, seq, op, k, CASE WHEN op IN ('put', 'increment') THEN value WHEN op = 'cas' AND expected IS NULL THEN value END, CAST(CASE WHEN op IN ('put', 'increment') OR (op = 'cas' AND expected IS NULL) THEN 1 ELSE 0 END AS BIGINT), op IN ('put', 'increment') OR (op = 'cas' AND expected IS NULL), false FROM o WHERE k = 1
    UNION ALL SELECT o.table_id, o.key, o.seq, o.op, o.k,
    CASE o.op WHEN 'put' THEN o.value WHEN 'delete' THEN NULL WHEN 'increment' THEN coalesce(f.value_after, 0) + o.value WHEN 'cas' THEN CASE WHEN f.value_after IS NOT DISTINCT FROM o.expected THEN o.value ELSE f.value_after END ELSE f.value_after END,
    f.version + CASE o.op WHEN 'put' THEN 1 WHEN 'increment' THEN 1 WHEN 'delete' THEN CASE WHEN f.value_after IS NULL THEN 0 ELSE 1 END WHEN 'cas' THEN CASE WHEN f.value_after IS NOT DISTINCT FROM o.expected THEN 1 ELSE 0 END ELSE 0 END,
    CASE o.op WHEN 'put' THEN true WHEN 'increment' THEN true WHEN 'cas' THEN f.value_after IS NOT DISTINCT FROM o.expected ELSE f.value_after IS NOT NULL END, f.value_after IS NOT NULL
    FROM f JOIN o ON o.table_id = f.table_id AND o.key = f.key AND o.k = f.k + 1)"""
kv_sql = lambda body: sql(f"{FOLD} {body}", "kv_ops", recursive=True)
folded = lambda r: kv.folded(r.kv_ops).select("table_id", "key", "seq", "op", "value_after", "version", "success", "found")
query("kv_fold", kv_sql("SELECT table_id, key, seq, op, value_after, version, success, found FROM f"))(folded)
query("kv_get", kv_sql("SELECT table_id, key, seq, value_after AS value, version, found FROM f WHERE op = 'get'"))(lambda r: folded(r).where("op = 'get'").select("table_id", "key", "seq", c("value_after").alias("value"), "version", "found"))
query("kv_cas", kv_sql("SELECT table_id, key, seq, success, value_after AS current FROM f WHERE op = 'cas'"))(lambda r: folded(r).where("op = 'cas'").select("table_id", "key", "seq", "success", c("value_after").alias("current")))
query("kv_delete", kv_sql("SELECT table_id, key, seq, version, success FROM f WHERE op = 'delete'"))(lambda r: folded(r).where("op = 'delete'").select("table_id", "key", "seq", "version", "success"))
query("kv_range_scan", kv_sql("SELECT key, value_after AS value, version FROM (SELECT *, row_number() OVER (PARTITION BY table_id, key ORDER BY seq DESC) AS r FROM f) WHERE r = 1 AND value_after IS NOT NULL AND table_id = 2 AND key >= '1' AND key < '7' ORDER BY key LIMIT 10"))(
    lambda r: kv.range_scan(kv.state(r.kv_ops.where(kv.in_range(2, "1", "7"))), 2, "1", "7", 10).select("key", "value", "version")
)
query("kv_versions", sql("SELECT table_id, key, seq, op, count(*) OVER (PARTITION BY table_id, key ORDER BY seq) AS version FROM kv_ops WHERE op IN ('put', 'delete')", "kv_ops"))(lambda r: kv.put_versions(r.kv_ops).select("table_id", "key", "seq", "op", "version"))
query("kv_increment", sql("SELECT table_id, key, seq, CAST(sum(value) OVER (PARTITION BY table_id, key ORDER BY seq) AS BIGINT) AS new_value FROM kv_ops WHERE op = 'increment'", "kv_ops"))(lambda r: kv.counters(r.kv_ops).select("table_id", "key", "seq", "new_value"))

# ---- segment files and streams ---------------------------------------------------------------------------------------------------


def segment_rows(r: Relations) -> DataFrame:
    """Segments of whole batches as binary rows, each padded to whole pages; at most a seal size of bytes in one."""
    x = batches(r).select("ledger_id", "entry_id", "batch").join(r.conv_entries.select("ledger_id", "entry_id", "data"), ["ledger_id", "entry_id"])
    x = x.groupBy("ledger_id", "batch").agg(F.array_sort(F.collect_list(F.struct("entry_id", E.record(c("ledger_id"), c("entry_id"), c("data")).alias("record")))).alias("rows"))
    body = F.aggregate("rows", F.unhex(F.lit("")), lambda a, y: F.concat(a, y["record"]))
    return x.select(F.concat(F.lit("seg-"), E.hex_id(c("ledger_id") * 1000 + c("batch")), F.lit(".seg")).alias("path"), F.rpad(body, E.align_up(F.octet_length(body)).cast("int"), F.unhex(F.lit("00"))).alias("content"))


query("segment_decode", sql("SELECT ledger_id, entry_id, text, 'ok' AS status, length FROM conv_entries", "conv_entries"))(lambda r: segment_files.decoded(segment_rows(r)).select("ledger_id", "entry_id", c("payload").cast("string").alias("text"), "status", "length"))


def rolled_rows(r: Relations) -> DataFrame:
    """Entries of conversations with the segment (a number) that their batch goes to."""
    x = batches(r).select("ledger_id", "entry_id", "batch").join(r.conv_entries.select("ledger_id", "entry_id", "data"), ["ledger_id", "entry_id"])
    return x.withColumn("segment_id", c("ledger_id") * 1000 + c("batch"))


def write_and_list(r: Relations) -> DataFrame:
    """Segments written to the shared folder and read back: path, content."""
    folder = jobs.folder(r.spark).replace("/stream-", "/segments-")
    segment_files.write_segments(segment_files.packed(rolled_rows(r).withColumn("segment", E.entry_file(c("segment_id"))), ["entry_id"]), folder)
    return segment_files.written(r.spark, folder)


query("segment_write_read", sql("SELECT ledger_id, entry_id, text, 'ok' AS status, length FROM conv_entries", "conv_entries"))(
    lambda r: segment_files.decoded(write_and_list(r)).select("ledger_id", "entry_id", c("payload").cast("string").alias("text"), "status", "length")
)
# a torn tail of 10 bytes behind each segment's records goes, what is before it stays
query("segment_truncate", sql("SELECT ledger_id, entry_id, text, 'ok' AS status FROM conv_entries", "conv_entries"))(
    lambda r: segment_files.decoded(
        segment_files.truncated(segment_rows(r).withColumn("content", F.concat("content", F.unhex(F.lit("FF" * 10))))).select("path", "content")
    ).select("ledger_id", "entry_id", c("payload").cast("string").alias("text"), "status")
)


def tiered(r: Relations) -> DataFrame:
    """Reads of all entries and of some that are nowhere, from memory, local and remote segments and the log."""
    files = write_and_list(r).select(E.file_id(c("path")).alias("segment_id"), "content").withColumn("ledger_id", F.floor(c("segment_id") / 1000))
    files = files.withColumn("kind", F.when(c("ledger_id") % 2 == 0, "entry").otherwise("wal"))
    found = segment_files.decoded(files.select(c("segment_id").cast("string").alias("path"), "content")).where("status = 'ok'")
    locations = found.select("ledger_id", "entry_id", c("file").cast("long").alias("segment_id"), "offset", "length", F.when(c("ledger_id") % 2 == 0, "entry").otherwise("wal").alias("index"))
    status = F.get(F.array(F.lit("Local"), F.lit("S3"), F.lit("Active")), (c("ledger_id") % 3).cast("int"))
    entries = r.conv_entries.select("ledger_id", "entry_id", c("data").alias("payload"))
    wanted = entries.select("ledger_id", "entry_id").unionByName(entries.where("ledger_id % 7 = 0").select("ledger_id", (c("entry_id") + 100_000).alias("entry_id")))
    places = locations.withColumnRenamed("index", "kind").join(wanted, ["ledger_id", "entry_id"], "left_semi")
    records = segment_files.read_at(files.select("segment_id", "kind", "content"), places).where("payload is not null")
    out = sg.tiered_read(wanted, locations, files.select(c("segment_id").alias("id"), status.alias("status")), entries.where("ledger_id % 5 = 0"), records)
    return out.select("ledger_id", "entry_id", "route", c("payload").cast("string").alias("text"), "outcome")


query(
    "tiered_read",
    sql(
        """SELECT ledger_id, entry_id, CASE WHEN ledger_id % 5 = 0 THEN 'cache' WHEN ledger_id % 2 = 1 THEN 'wal' WHEN ledger_id % 3 = 1 THEN 'remote' ELSE 'local' END AS route, text, 'Read' AS outcome FROM conv_entries
        UNION ALL SELECT ledger_id, entry_id + 100000, 'not_found', NULL, 'NotFound' FROM conv_entries WHERE ledger_id % 7 = 0""",
        "conv_entries",
    ),
)(tiered)


def stream(r: Relations, name: str) -> DataFrame:
    return r.spark.readStream.schema(r.table(name).schema).parquet(f"{r.sf_dir}/{name}.parquet*")


query("stream_dedup", sql("SELECT DISTINCT l_orderkey AS ledger_id, CAST(l_linenumber AS BIGINT) AS entry_id FROM lineitem"))(
    lambda r: jobs.run_once(jobs.first_wins(stream(r, "lineitem").select(c("l_orderkey").alias("ledger_id"), c("l_linenumber").cast("long").alias("entry_id")), ["ledger_id", "entry_id"]))
)
query("stream_lac", "SELECT conv_id AS ledger_id, max(greatest(turn - 1, 0)) AS lac, max(turn) AS last_entry_id, count(*) AS n_entries FROM conversations GROUP BY 1")(
    lambda r: jobs.run_once(jobs.positions(stream(r, "conversations").select(c("conv_id").alias("ledger_id"), c("turn").alias("entry_id"), F.greatest(c("turn") - 1, F.lit(0)).alias("lac"))), "complete")
)
LEASES = """SELECT node_id, CAST(max(beat) AS TIMESTAMP) AS last_heartbeat, CAST(max(beat) + INTERVAL 15 MINUTE AS TIMESTAMP) AS expired_at, count(*) AS n_heartbeats FROM (
    SELECT *, sum(CASE WHEN earlier IS NULL OR beat >= earlier + INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY beat, event_id) AS session
    FROM (SELECT user_id % 20 AS node_id, ts AS beat, event_id, lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS earlier FROM events))
    GROUP BY node_id, session HAVING max(beat) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
plain_time = lambda x: c(x).cast("timestamp_ntz").alias(x)
beats = lambda r: stream(r, "events").select((c("user_id") % 20).alias("node_id"), c("ts").cast("timestamp").alias("at"))
query("stream_lease", LEASES)(
    lambda r: jobs.run_once(jobs.lapsed_leases(beats(r), "15 minutes", "1 hour")).select("node_id", plain_time("last_heartbeat"), plain_time("expired_at"), "n_heartbeats")
)
