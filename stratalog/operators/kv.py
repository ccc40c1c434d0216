"""Key-value tables as folds over an ordered operation log.

An operation is put, get, delete, increment or cas.  Deleted keys keep their version count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.folds import fold

KEYS = ["table_id", "key"]


def folded(ops: DataFrame) -> DataFrame:
    """ops (table_id, key, seq, op, value, expected) with the result of each: value_after (null: absent), version, success, found.

    put sets; delete removes; increment adds to the value (absent: 0); cas sets if the value equals expected
    (both may be null); get changes nothing.  Each change is one more version.
    """

    def step(state, row):
        value, version = state
        found, ok = value is not None, True
        op = row["op"]
        if op == "put":
            value, version = row["value"], version + 1
        elif op == "delete":
            ok = found
            value, version = None, version + found
        elif op == "increment":
            value, version = (value or 0) + row["value"], version + 1
        elif op == "cas":
            ok = value == row["expected"]
            value, version = (row["value"], version + 1) if ok else (value, version)
        else:
            ok = found
        return (value, version), {"value_after": value, "version": version, "success": ok, "found": found}

    reads = ["op", "value", "expected"]
    return fold(ops, KEYS, ["seq"], lambda: (None, 0), step, "value_after long,version long,success boolean,found boolean", reads)


def state(ops: DataFrame) -> DataFrame:
    """The last value of each key; deleted keys are left out."""
    last = folded(ops).groupBy(*KEYS).agg(F.max_by(F.struct("value_after", "version"), "seq").alias("s"))
    return last.select(*KEYS, F.col("s.value_after").alias("value"), F.col("s.version").alias("version")).where("value is not null")


def range_scan(rows: DataFrame, table_id: int, start: str, end: str, limit: int) -> DataFrame:
    """Pairs with start <= key < end, in order, at most limit."""
    return rows.where(in_range(table_id, start, end)).orderBy("key").limit(limit)


def in_range(table_id: int, start: str, end: str):
    """Whether an operation or a pair is of these keys; put below the fold, it reaches the scan, and no other key is folded."""
    return (F.col("table_id") == table_id) & (F.col("key") >= start) & (F.col("key") < end)


def put_versions(ops: DataFrame) -> DataFrame:
    """For logs of puts and deletes alone: the version is a running count, in windows."""
    w = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ops.where("op in ('put', 'delete')").withColumn("version", F.count("*").over(w))


def counters(ops: DataFrame) -> DataFrame:
    """For logs of increments alone: running sums."""
    w = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ops.where("op = 'increment'").withColumn("new_value", F.sum("value").over(w))
