"""Rows with nulls, empty and very long texts, ties and repeated rows, and columns whose names clash."""

from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, ids string, node string, label string"
LONG = " ".join(f"word{k % 997} and{k % 89}" for k in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall trees near a river bend in autumn light"
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " today"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two three"),
    (9, LONG), (10, LONG + " tail"), (None, BASE), (None, None), (11, "unrelated text. It has two sentences!\nAnd a line"), (12, "ONE two\tthree"),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, None, "s", None if t is None else len(t), 0.5, "x", "y", "z", "l") for i, t in texts]
    return spark.createDataFrame(rows, T.StructType.fromDDL(DOCUMENT))


def real(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")
