"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # a node's larger neighbours point to the least of all its neighbours; the join may split a hub's edges
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) of every node with an edge: label is the least node reachable. `edges` has u and v, of one type, either way around.

    Edges and labels stay distributed; each round is written to the shared folder, so a lost executor costs one round.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
