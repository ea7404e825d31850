"""Edges written once by what a step starts from, so that each layer of a walk reads only the folders that its frontier needs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.storage import shared_dir, written

c = F.col
#: Edges a bucket; a bucket is a folder for each way and kind.
PER_BUCKET = 4_000_000
MOST_BUCKETS = 1024
#: What a frontier may measure, as text, to be sent to every task.
SENT_BYTES = 16 << 20


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


class Steps:
    """Steps (id, b, bucket) out of ids, in parts of (table, number of buckets); `bucket` is a folder, found by hash of the id."""

    def __init__(self, *parts: tuple[DataFrame, int]):
        self.parts = parts

    def near(self, front: DataFrame) -> DataFrame | None:
        """(columns of `front`, b) of the steps out of `front` (id, ...), a step for each edge; None if it has no rows.

        The frontier is measured first: its buckets, at most as many as there are folders, pick what is read, and it is sent to all tasks if it
        holds SENT_BYTES at most. A larger one is shuffled, where adaptive execution splits the partitions of hubs.
        """
        size = F.sum(F.length(F.to_json(F.struct(*front.columns)))).alias("size")
        found = front.agg(F.count("*").alias("n"), size, *[F.collect_set(_bucket("id", n)).alias(f"b{i}") for i, (_, n) in enumerate(self.parts)]).first()
        if not found["n"]:
            return None
        hit = []
        for i, (table, n) in enumerate(self.parts):
            hit.append((table if len(found[f"b{i}"]) == n else table.filter(c("bucket").isin(*found[f"b{i}"]))).select("id", "b"))
        steps = reduce(DataFrame.unionByName, hit)
        small = found["size"] <= SENT_BYTES
        return steps.join(F.broadcast(front) if small else front, "id").select(*[c(x) for x in front.columns], "b")


class Adjacency:
    """The edges (src, dst, kind) of a graph in both ways, in folders by way, kind and bucket of the id that a step starts from.

    Files hold ranges of (id, b), so the edges of a hub lie in many files and those of an id otherwise together. Repeated edges stay.
    `parts` are (folder, table, number of buckets): tables of edges that were written one by one are walked as one.
    """

    def __init__(self, *parts: tuple[str, DataFrame, int]):
        self.parts = parts

    @classmethod
    def build(cls, edges: DataFrame, path: str | None = None, per_bucket: int = PER_BUCKET) -> Adjacency:
        """`edges` written to `path` (a new folder of the shared one if None); edges with a null end are no steps."""
        spark = edges.sparkSession
        path = path or f"{shared_dir(spark)}/adjacency_{uuid.uuid4().hex}"
        own = written(edges.select("src", "dst", "kind").dropna(), "edges")
        buckets = max(1, min(MOST_BUCKETS, own.count() // per_bucket))
        way = lambda name, a, b: own.select(F.lit(name).alias("way"), "kind", c(a).alias("id"), c(b).alias("b"))
        both = way("out", "src", "dst").unionByName(way("in", "dst", "src")).withColumn("bucket", _bucket("id", buckets))
        order = ["way", "kind", "bucket", "id", "b"]
        both.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("way", "kind", "bucket").parquet(path)
        return cls.read(spark, path, buckets)

    @classmethod
    def read(cls, spark: SparkSession, path: str, buckets: int) -> Adjacency:
        return cls((path, spark.read.schema("id string, b string, way string, kind string, bucket int").parquet(path), buckets))

    def __add__(self, other: Adjacency) -> Adjacency:
        return Adjacency(*self.parts, *other.parts)

    def edges(self) -> DataFrame:
        """(src, dst, kind) of all edges."""
        return reduce(DataFrame.unionByName, [t.filter("way = 'out'").select(c("id").alias("src"), c("b").alias("dst"), "kind") for _, t, _ in self.parts])

    def steps(self, direction: str = "out", kinds: list[str] | None = None) -> Steps:
        """Steps along `out`, `in` or `both`, of the kinds given (all if None)."""
        hit = F.lit(True) if kinds is None else c("kind").isin(*kinds)
        if direction != "both":
            hit = hit & (c("way") == direction)
        return Steps(*[(t.filter(hit).select("id", "b", "bucket"), n) for _, t, n in self.parts])


class Scanned(Adjacency):
    """Edges (src, dst, kind) that each layer reads anew and nothing is written of: for a walk of few layers over tables that are cheap to read."""

    def __init__(self, edges: DataFrame):
        super().__init__()
        self.table = edges.select("src", "dst", "kind").dropna()

    def edges(self) -> DataFrame:
        return self.table

    def steps(self, direction: str = "out", kinds: list[str] | None = None) -> Steps:
        own = self.table if kinds is None else self.table.filter(c("kind").isin(*kinds))
        way = lambda a, b: own.select(c(a).alias("id"), c(b).alias("b"), F.lit(0).alias("bucket"))
        out, back = way("src", "dst"), way("dst", "src")
        return Steps((out if direction == "out" else back if direction == "in" else out.unionByName(back), 1))


def steps_of(pairs: DataFrame) -> Steps:
    """Steps (a, b) that are walked once: written as they are, in one bucket, without those that lack an end."""
    return Steps((written(pairs.select(c("a").alias("id"), "b").dropna().withColumn("bucket", F.lit(0)), "steps"), 1))
