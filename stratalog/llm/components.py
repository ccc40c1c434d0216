"""Connected components of a link table, wholly as DataFrames.

Alternates the large-star and small-star steps, which keep connectivity and end in stars
around each component's least node.  Each round is written to the shared folder, so a lost executor costs
at most a round; the round before is then removed.  Nothing but two sums a round reaches the driver.  The links of a node
with very many go to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import dropped, salted_join, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b), in any order, repeated or not -> (node, component), the least node of each component.

    Loops are ignored; null ends are not allowed.  No links: an empty table.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n_rows"))
        near = salted_join(both.where("b > a"), least.drop("n_rows"), "a", ["b"], rows=now[0], counts=least)
        large = stored(near.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        floor = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
        down = salted_join(large, floor.drop("n_rows"), "a", ["b"], rows=now[0], counts=floor)
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = down.select(F.explode(ends).alias("x")).select("x.*")
        after = stored(small.where("a <> b").distinct(), "links")
        dropped(edges, large)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
