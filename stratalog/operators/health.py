"""Health: rolling latency percentiles, status, histograms and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram bounds, of appends and syncs in milliseconds and of the re-replication of a ledger in seconds.
APPEND_BUCKETS_MS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
REPLICATION_BUCKETS_S = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0)


def p99(values: Column) -> Column:
    """The element at floor(n * 0.99) of the sorted values, the last at most."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(F.floor(n * 99 / 100).cast("int"), n - 1))


def rolling(samples: DataFrame, key: str, order: str, last: int) -> DataFrame:
    """p99 and number of the last samples, and the bytes so far, at each sample of a node."""
    w = Window.partitionBy(key).orderBy(order)
    near = w.rowsBetween(1 - last, 0)
    x = samples.withColumn("_values", F.collect_list("elapsed_ms").over(near)).withColumn("bytes_so_far", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("p99_ms", p99(F.col("_values"))).withColumn("n_samples", F.size("_values").cast("long")).drop("_values")


def status(rolled: DataFrame, most_bytes: int, most_p99_ms: int, least_samples: int = 10) -> DataFrame:
    """Read-only beyond the capacity, or over the latency limit with enough samples."""
    full = F.col("bytes_so_far") >= most_bytes
    slow = (F.col("n_samples") >= least_samples) & (F.col("p99_ms") > most_p99_ms)
    return rolled.withColumn("status", F.when(full | slow, "ReadOnly").otherwise("ReadWrite"))


def changes(statuses: DataFrame, key: str, order: str) -> DataFrame:
    """Rows at which a node's status differs from the one before; it starts as ReadWrite."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy(key).orderBy(order)), F.lit("ReadWrite"))
    return statuses.withColumn("_before", before).where(F.col("status") != F.col("_before")).drop("_before")


def histogram(samples: DataFrame, value: str, bounds: tuple[float, ...], by: list[str]) -> DataFrame:
    """Cumulative counts by bound, and the sum and count, in one pass; one row a bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"c{k}") for k, b in enumerate(bounds)]
    x = samples.groupBy(*by).agg(*counts, F.count("*").alias("n"), F.sum(value).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"c{k}").alias("cumulative")) for k, b in enumerate(bounds)))
    return x.select(*by, F.explode(rows).alias("r"), "n", "total").select(*by, "r.le", "r.cumulative", "n", "total")
