"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

The five-word shingles of a text are hashed once.  A hash's leading bits are its bin; the least hash of each
bin counts.  An empty bin is filled by optimal densification: it takes the value of the filled bin
of least hash(bin, filled bin), a choice that is uniform, independent for each bin, and the same
for all texts.  Of each value the low bits are stored, packed.  Likeness corrects the share of equal bins for equals by chance:
with b bits, (share - 2^-b) / (1 - 2^-b), not under 0.

Defined results: a null text is an empty one; an empty text and one of fewer than five words have
one shingle, the whole sequence.  Equal texts have equal fingerprints.  Words are runs between white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.common import read_table

SPACE = " \t\n\u000b\f\r"


@dataclass(frozen=True)
class FingerprintParams:
    """log_bins: 2^log_bins bins; bits a bin: 4, 8 or 16."""

    width: int = 5
    log_bins: int = 7
    bits: int = 8

    @property
    def bins(self) -> int:
        return 1 << self.log_bins


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int) -> Column:
    words = F.split(F.btrim(text, F.lit(SPACE)), "[ \\t\\n\\x0B\\f\\r]+")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    rolled = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width)))), F.lit(1), F.size(h) - (width - 1))
    return let(hashed, lambda h: F.when(F.size(h) >= width, rolled(h)).otherwise(F.array(F.xxhash64(h))))


def bin_values(hashes: Column, p: FingerprintParams) -> Column:
    """The value of each bin, after densification."""
    of = lambda x: F.shiftright(x, 64 - p.log_bins) + p.bins // 2
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (of(x) != of(F.get(s, i - 1))))
    nearest = lambda b, f: F.array_min(F.transform(f, lambda x: F.struct(F.xxhash64(b, of(x)).alias("h"), x.alias("x"))))["x"]
    by_bin = lambda f: F.map_from_arrays(F.transform(f, of), f)
    filled = lambda f: let(by_bin(f), lambda m: F.transform(F.sequence(F.lit(0), F.lit(p.bins - 1)), lambda b: F.coalesce(F.try_element_at(m, b), nearest(b, f))))
    return let(let(F.sort_array(hashes), firsts), lambda f: F.when(F.size(f) == p.bins, f).otherwise(filled(f)))


def packed(values: Column, p: FingerprintParams) -> Column:
    """The low bits of each value, one bin after another, as binary."""
    digits = p.bits // 4
    one = lambda v: F.substring(F.hex(v.bitwiseAND(F.lit((1 << p.bits) - 1)) + (1 << p.bits)), 2, digits)
    return F.unhex(F.array_join(F.transform(values, one), ""))


def fingerprint(text: Column, p: FingerprintParams = FingerprintParams()) -> Column:
    return packed(bin_values(shingle_hashes(text, p.width), p), p)


def likeness(a: Column, b: Column, p: FingerprintParams = FingerprintParams()) -> Column:
    """0 to 1 from two packed fingerprints, corrected for equal low bits of unequal values."""
    if p.bits == 4:
        a, b = F.hex(a), F.hex(b)
    size = max(1, p.bits // 8)
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(p.bins - 1)), lambda i: F.substr(a, i * size + 1, F.lit(size)) == F.substr(b, i * size + 1, F.lit(size))))
    chance = 2.0**-p.bits
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(p.bins)) - chance) / (1 - chance)))


def with_next(docs: DataFrame, bucket_bytes: int = 2 << 20, most_buckets: int = 1 << 15) -> DataFrame:
    """(k, text) -> (k, text, fp, next_text, next_fp): the next row in ascending (k, text), after the last the first.

    One exchange of the texts: rows go to ranges of k (bounds from approximate quantiles over all rows), and
    the first rows of each range also go to the range before, to stand behind its last.
    """
    spark = docs.sparkSession
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = min(most_buckets, max(1, total // bucket_bytes), max(1, rows))
    cuts = docs.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100_000).alias("q")).first()["q"] if n > 1 else None
    bounds = sorted(set(cuts or []))  # at most most_buckets numbers
    half = [1 << k for k in range(len(bounds).bit_length())][::-1]
    if bounds:
        table = F.lit(bounds)
        bucket = F.aggregate(F.lit(half), F.lit(0), lambda lo, h: F.when(F.get(table, lo + h - 1) <= F.col("k"), lo + h).otherwise(lo))
    else:
        bucket = F.lit(0)
    dealt = docs.withColumn("bucket", bucket)
    heads = sorted((r["bucket"], r["k"]) for r in dealt.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    before = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]  # the first range follows the last
    behind = spark.createDataFrame(before, "k long, bucket int")
    guests = docs.join(F.broadcast(behind), "k").select("k", "text", "bucket", F.lit(True).alias("guest"))
    both = dealt.select("k", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests).withColumn("fp", fingerprint(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("guest", "k", "text")
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where(~F.col("guest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = -(1 << 63)
    docs = read_table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("e", let(edited, lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("sha"), fingerprint(t).alias("fp"))))
    return rows.select(
        F.when(F.col("k") != least, F.col("k")).alias("doc_id"), n.cast("long").alias("n_chars"), F.col("e.sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        F.col("e.fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("e.fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
