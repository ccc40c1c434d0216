"""Shared helpers: table reading, the shared folder, and guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes that go to a Python worker at once, at most.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: A table of at most so many bytes is broadcast; a key with more than one in HOT_KEYS of all rows is hot.
BROADCAST_BYTES, HOT_KEYS = 16 << 20, 256


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to the bounds above, so a worker's memory does not follow the length of texts."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is made and set; on a cluster it must be set.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        where = getattr(context, "_stratalog_dir", None)
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="stratalog-")
            context.setCheckpointDir(where)
            context._stratalog_dir = where
    return f"{where.rstrip('/')}/stratalog-{context.applicationId}"


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; to be called when the results are written, as they read from them."""
    removed(spark, shared_dir(spark))


def stored(df: DataFrame, label: str, codec: str = "gzip") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Gzip at its fastest level takes no memory beside the heap to speak of, as others do; tables of hashes are best left uncompressed.
    (lz4_raw is no choice: its decompressor refuses some pages of hashes that its compressor wrote.)
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("zlib.compress.level", "BEST_SPEED").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by stored() that no plan still to be run reads."""
    for t in tables:
        removed(t.sparkSession, t._stored_at)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column, over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def blocks_for(total: int, block: int) -> int:
    return max(1, -(-total // block))


def shielded(docs: DataFrame, reserved: tuple[str, ...]):
    """docs with columns of reserved names renamed, and a function that brings a result back to the columns of docs."""
    other = {c: f"_kept_{c}" for c in docs.columns if c in reserved}
    while any(o in docs.columns for o in other.values()):
        other = {c: f"_{o}" for c, o in other.items()}
    inside = docs.select(*(F.col(f"`{c}`").alias(other.get(c, c)) for c in docs.columns))
    return inside, lambda df: df.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns))


def keyed_join(df: DataFrame, table: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """df joined (inner or left) by a string key with a stored table of one row a key, which has n_rows, the key's rows; n_rows is left out.

    No key's rows meet in one task, however many it has.  A small table (BROADCAST_BYTES, checked) is broadcast.  Of a larger one just the
    hot keys are, fewer than HOT_KEYS; rows of the rest are exchanged by key, those of hot keys by a hash of the columns in spread.
    """
    columns = [c for c in table.columns if c not in (key, "n_rows")]
    width = lambda c, t: F.octet_length(c) if t in ("string", "binary") else 16 * F.size(c) if t.startswith("array") else F.lit(8)
    bytes_of = [F.coalesce(width(c, t), F.lit(0)) for c, t in table.dtypes if c != "n_rows"]
    size, rows = table.agg(F.sum(sum(bytes_of)), F.sum("n_rows")).first()
    if (size or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(table.drop("n_rows")), key, how)
    is_hot = F.col("n_rows") * HOT_KEYS > rows
    side = lambda rows, name: table.where(rows).select(F.col(key).alias(f"_{name}"), F.struct(*columns).alias(f"_of_{name}"))
    hot, cold = side(is_hot, "hot"), side(~is_hot, "cold")
    out = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # no key has that character
    place = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\u0001"), F.xxhash64(*spread).cast("string")))
    out = out.withColumn("_place", place).join(cold, F.col("_place") == F.col("_cold"), "left")
    if how == "inner":
        out = out.where("_hot is not null or _cold is not null")
    return out.select(*df.columns, *(F.coalesce(f"_of_hot.{c}", f"_of_cold.{c}").alias(c) for c in columns))


#: A key of more rows than SALT_ROWS is spread over several tasks; at most SALTED_KEYS keys are (the threshold rises with the rows).
SALT_ROWS, SALTED_KEYS = 4096, 1 << 16


def salted_join(df: DataFrame, table: DataFrame, key: str, spread: list[str], how: str = "inner", rows: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """df joined (inner, left or left_anti) by key with a table of one row a key, so that a hot key's rows go to many tasks.

    A key of n rows in df is cut into about n / SALT_ROWS parts by a hash of the columns in spread, and its row of the table is repeated once
    a part: both sides grow by no more than a row for SALT_ROWS.  Which keys are hot is counted over all of df (counts: key and n_rows, if
    they are known; rows: how many df has); the list of them is broadcast, at most SALTED_KEYS pairs of a key and a number.
    """
    least = max(SALT_ROWS, (df.count() if rows is None else rows) // SALTED_KEYS)
    counts = df.groupBy(key).agg(F.count("*").alias("n_rows")) if counts is None else counts
    hot = F.broadcast(counts.where((F.col("n_rows") > least) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n_rows") / least).cast("int").alias("_parts")))
    left = df.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
