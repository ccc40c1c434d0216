"""Ledger relations derived from the driver's tables, as DataFrames and as SQL of their own for the oracles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The key of the signed relations.
SECRET = b"stratalog-demo-key"


class Relations:
    """The relations over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @functools.cached_property
    def entries(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("event_id")
        x = self.table("events").select(F.col("user_id").alias("ledger_id"), (F.row_number().over(w) - 1).cast("long").alias("entry_id"), F.col("props").alias("text"), F.col("ts").alias("appended_at"), F.col("event_id").alias("seq"))
        return x.withColumn("lac", F.greatest(F.col("entry_id") - 1, F.lit(0).cast("long"))).withColumn("data", F.col("text").cast("binary"))

    @functools.cached_property
    def conv_entries(self) -> DataFrame:
        x = self.table("conversations").select(F.col("conv_id").alias("ledger_id"), F.col("turn").alias("entry_id"), "text")
        return x.withColumn("data", F.col("text").cast("binary")).withColumn("length", F.octet_length("text").cast("long") + 24)

    @functools.cached_property
    def nodes(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("address"), F.when(F.col("s_acctbal") < 0, "ReadOnly").otherwise("ReadWrite").alias("status"), (F.col("s_suppkey") * 7919 % 60000).alias("last_heartbeat_ms"))

    @functools.cached_property
    def ledgers(self) -> DataFrame:
        n = self.table("supplier").agg(F.count("*")).scalar()
        c = F.col("c_custkey")
        member = lambda k: F.array(*((c * 7 + k + i) % n for i in range(3)))
        fragment = lambda k: F.struct(F.lit(4 * k).cast("long").alias("first_entry_id"), member(k).alias("ensemble"), F.lit(3).alias("write_quorum"), F.lit(2).alias("ack_quorum"))
        state = F.get(F.array(*(F.lit(s) for s in ("Open", "InRecovery", "Closed", "Deleted"))), F.col("c_nationkey") % 4)
        return self.table("customer").select(
            c.alias("ledger_id"), state.alias("state"), F.array(*(fragment(k) for k in range(3))).alias("fragments"),
            F.when(c % 10 != 0, c % 12).alias("last_entry_id"), (c % 15).alias("last_add_confirmed"), (c % 3 + 1).alias("version"),
        )

    @functools.cached_property
    def segments(self) -> DataFrame:
        o = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "F", "S3").when(F.col("o_orderstatus") == "O", "Local").otherwise("Active")
        return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "Entry").otherwise("Wal").alias("kind"), status.alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("byte_len"), F.col("o_orderdate").alias("mtime"))

    @functools.cached_property
    def locations(self) -> DataFrame:
        x = self.table("lineitem")
        return x.select(
            F.when(F.col("l_linenumber") % 2 == 0, "entry").otherwise("wal").alias("index"), F.col("l_suppkey").alias("ledger_id"), F.col("l_partkey").alias("entry_id"), F.col("l_orderkey").alias("segment_id"),
            (F.col("l_linenumber").cast("long") * 200_000 + F.col("l_partkey") % 100 * 24).alias("offset"), (F.col("l_quantity").cast("long") * 10 + 24).alias("length"),
        )

    @functools.cached_property
    def submissions(self) -> DataFrame:
        """Appends in order of seq, with a share of bad digests, bad signatures and foreign keys."""
        from stratalog.functions import encoding as E

        a, b = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
        x = self.table("lineitem").select(a.alias("ledger_id"), b.alias("entry_id"), F.greatest(b - 1, F.lit(0)).alias("lac"), F.concat_ws("|", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_quantity")).cast("long")).alias("text"), "l_partkey", "l_suppkey")
        x = x.withColumn("data", F.col("text").cast("binary"))
        mixed = F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("ledger_id")
        sign = E.hmac_sha256(SECRET, E.entry_message(F.col("ledger_id"), F.col("entry_id"), F.col("lac"), F.col("data")))
        return (
            x.withColumn("mixed", mixed)
            .withColumn("digest", E.digest(F.col("data")) + F.when(mixed % 53 == 0, 1).otherwise(0))
            .withColumn("hmac", F.when(mixed % 5 != 0, F.when(mixed % 47 == 0, F.sha2(F.col("data"), 256).cast("binary")).otherwise(sign)))
            .withColumn("master_key", F.when(mixed % 43 == 0, F.lit("other")).when(mixed % 3 == 0, F.lit("own")))
        )

    @functools.cached_property
    def acks(self) -> DataFrame:
        from stratalog.operators.entries import write_sets

        x = write_sets(self.entries, self.ledgers)
        mixed = F.col("ledger_id") * 31 + F.col("entry_id") * 17 + F.col("position") * 7
        return x.withColumn("ok", mixed % 5 > 1).withColumn("fenced", (F.col("ledger_id") + F.col("entry_id") * 3 + F.col("position")) % 101 == 0).withColumn("latency_ms", mixed % 37)

    @functools.cached_property
    def replicas(self) -> DataFrame:
        from stratalog.operators.entries import write_sets

        x = write_sets(self.entries, self.ledgers)
        flip = ((F.col("ledger_id") + F.col("entry_id")) % 97 == 0) & (F.col("position") == 1)
        digest = F.col("ledger_id") * 100_003 + F.col("entry_id") + F.when(flip, 1).otherwise(0)
        return x.withColumn("digest", F.when((F.col("ledger_id") + F.col("entry_id") + F.col("position")) % 29 != 0, digest))

    @functools.cached_property
    def kv_ops(self) -> DataFrame:
        op = F.when(F.col("event_type") == "click", "get").when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "purchase", "increment").when(F.col("event_type") == "error", "delete").otherwise("cas")
        e = F.col("event_id")
        x = self.table("events").select((F.col("user_id") % 5).alias("table_id"), F.col("user_id").cast("string").alias("key"), e.alias("seq"), op.alias("op"))
        value = F.when(F.col("op") == "put", F.col("seq") % 7).when(F.col("op") == "increment", F.col("seq") % 5 + 1).when(F.col("op") == "cas", F.col("seq") % 11)
        return x.withColumn("value", value).withColumn("expected", F.when((F.col("op") == "cas") & (F.col("seq") % 4 != 0), F.col("seq") % 7))

    @functools.cached_property
    def latencies(self) -> DataFrame:
        return self.table("events").select((F.col("user_id") % 8).alias("node"), F.col("event_id").alias("seq"), F.floor(F.abs("value")).cast("long").alias("elapsed_ms"), F.octet_length("props").cast("long").alias("bytes"))


#: The same relations as SQL: name -> (needs, query).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "entries": ((), "SELECT user_id AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS entry_id, props AS text, ts AS appended_at, event_id AS seq, greatest(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 2, 0) AS lac FROM events"),
    "conv_entries": ((), "SELECT conv_id AS ledger_id, turn AS entry_id, text, CAST(octet_length(encode(text)) AS BIGINT) + 24 AS length FROM conversations"),
    "nodes": ((), "SELECT s_suppkey AS node_id, s_name AS address, CASE WHEN s_acctbal < 0 THEN 'ReadOnly' ELSE 'ReadWrite' END AS status, (s_suppkey * 7919) % 60000 AS last_heartbeat_ms FROM supplier"),
    "ledgers": ((), """SELECT c_custkey AS ledger_id, ['Open', 'InRecovery', 'Closed', 'Deleted'][c_nationkey % 4 + 1] AS state,
        CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 12 END AS last_entry_id, c_custkey % 15 AS last_add_confirmed, c_custkey % 3 + 1 AS version FROM customer"""),
    "fragments": (("ledgers",), """SELECT ledger_id, CAST(k AS BIGINT) AS fragment, CAST(4 * k AS BIGINT) AS first_entry_id, CASE WHEN k < 2 THEN CAST(4 * k + 4 AS BIGINT) END AS end_entry_id,
        [(ledger_id * 7 + k) % n, (ledger_id * 7 + k + 1) % n, (ledger_id * 7 + k + 2) % n] AS ensemble FROM ledgers, range(3) AS r(k), (SELECT count(*) AS n FROM supplier)"""),
    "segments": ((), """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Entry' ELSE 'Wal' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'S3' WHEN 'O' THEN 'Local' ELSE 'Active' END AS status,
        CAST(round(o_totalprice * 100) AS BIGINT) AS byte_len, o_orderdate AS mtime FROM orders"""),
    "locations": ((), """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'entry' ELSE 'wal' END AS index, l_suppkey AS ledger_id, l_partkey AS entry_id, l_orderkey AS segment_id,
        CAST(l_linenumber AS BIGINT) * 200000 + l_partkey % 100 * 24 AS "offset", CAST(floor(l_quantity) AS BIGINT) * 10 + 24 AS length FROM lineitem"""),
    "submissions": ((), """SELECT l_orderkey AS ledger_id, CAST(l_linenumber AS BIGINT) AS entry_id, concat_ws('|', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_quantity) AS BIGINT)) AS text,
        l_partkey * 31 + l_suppkey * 7 + l_orderkey AS mixed FROM lineitem"""),
    "write_set": (("entries", "fragments"), """SELECT e.ledger_id, e.entry_id, CAST(i AS BIGINT) AS position, ensemble[i + 1] AS node_id FROM entries e JOIN fragments f ON f.ledger_id = e.ledger_id AND e.entry_id >= f.first_entry_id AND (f.end_entry_id IS NULL OR e.entry_id < f.end_entry_id), range(3) AS r(i)"""),
    "acks": (("write_set",), """SELECT *, (ledger_id * 31 + entry_id * 17 + position * 7) % 5 > 1 AS ok, (ledger_id + entry_id * 3 + position) % 101 = 0 AS fenced, (ledger_id * 31 + entry_id * 17 + position * 7) % 37 AS latency_ms FROM write_set"""),
    "replicas": (("write_set",), """SELECT *, CASE WHEN (ledger_id + entry_id + position) % 29 <> 0 THEN ledger_id * 100003 + entry_id + CASE WHEN (ledger_id + entry_id) % 97 = 0 AND position = 1 THEN 1 ELSE 0 END END AS digest FROM write_set"""),
    "kv_ops": ((), """SELECT user_id % 5 AS table_id, CAST(user_id AS VARCHAR) AS key, event_id AS seq, op, CASE op WHEN 'put' THEN event_id % 7 WHEN 'increment' THEN event_id % 5 + 1 WHEN 'cas' THEN event_id % 11 END AS value,
        CASE WHEN op = 'cas' AND event_id % 4 <> 0 THEN event_id % 7 END AS expected FROM (SELECT *, CASE event_type WHEN 'click' THEN 'get' WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'increment' WHEN 'error' THEN 'delete' ELSE 'cas' END AS op FROM events)"""),
    "latencies": ((), "SELECT user_id % 8 AS node, event_id AS seq, CAST(floor(abs(value)) AS BIGINT) AS elapsed_ms, CAST(octet_length(encode(props)) AS BIGINT) AS bytes FROM events"),
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body with the relations it names in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    head = ", ".join(f"{n} AS ({SQL[n][1]})" for n in order)
    if not head:
        return body
    if recursive:
        return f"WITH RECURSIVE {head}, {body}"
    return f"WITH {head} {body}"
