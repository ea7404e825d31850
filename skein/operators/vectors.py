"""Vector collections in shared storage, searched with filters without computing most of the distances.

A collection keeps each vector's distances to a few pivots. By the triangle inequality they bound its distance from a query's vector from
below and above; rows that can't be among the nearest are dropped by these columns, before their vectors are read. Files lie by nearest pivot
and are sorted by the distance to it, so that whole parts of files are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import score as S
from skein.operators.relational import capped_per_key, with_neighbours
from skein.sources.storage import shared_dir, written

c = F.col
#: Vectors that pivots are chosen from, rows at most however many there are.
SAMPLE = 1024


@dataclass(frozen=True)
class Collection:
    """`rows` has the columns given, `embedding`, `far` (distances of unit vectors to the pivots; null for vectors of another length or of no
    direction), `cell` (the nearest pivot) and `near` (the distance to it)."""

    rows: DataFrame
    key: str
    pivots: np.ndarray


@dataclass(frozen=True)
class Nearest:
    """The nearest (key, distance), how many rows the filter left, and of how many a distance was computed."""

    rows: DataFrame
    scoped: int
    computed: int


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _apart(units: np.ndarray, n: int) -> np.ndarray:
    """Up to n vectors, each the farthest from those before it."""
    if not len(units):
        return units
    chosen, gap = [0], np.full(len(units), np.inf)
    while len(chosen) < min(n, len(units)):
        gap = np.minimum(gap, np.linalg.norm(units - units[chosen[-1]], axis=1))
        if gap.max() < 1e-9:
            break
        chosen.append(int(gap.argmax()))
    return units[chosen]


def build(rows: DataFrame, key: str, pivots: int = 8) -> Collection:
    """A collection of rows with a vector (`embedding`) and a key each. Pivots come from SAMPLE vectors of the commonest length; null vectors take no part, empty
    ones and others are compared as they are. An empty table gives a collection that finds nothing."""
    spark = rows.sparkSession
    given = rows.filter(c("embedding").isNotNull()).withColumn("embedding", c("embedding").cast("array<double>"))
    sizes = given.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = sizes.n if sizes else 0
    some = given.filter((F.size("embedding") == dims) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))).orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding").toArrow()
    sample = np.array(some.column(0).to_pylist(), float).reshape(-1, max(dims, 1))
    chosen = _apart(_unit(sample) if len(sample) else sample, pivots)
    place = given.columns.index("embedding")
    schema = T.StructType([*given.schema.fields, T.StructField("far", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            far, cell, near = [None] * len(batch), [-1] * len(batch), [0.0] * len(batch)
            fits = [i for i, n in enumerate(column.value_lengths().to_pylist()) if n == dims and len(chosen)]
            v = np.array([column[i].as_py() for i in fits], float).reshape(-1, max(dims, 1))
            norm = np.linalg.norm(v, axis=1)
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            if len(good):
                d = np.sqrt(np.maximum(0, 2 - 2 * (_unit(v[good]) @ chosen.T)))
                for i, row in zip(good.tolist(), d.tolist()):
                    far[fits[i]] = row
                    cell[fits[i]] = int(np.argmin(row))
                    near[fits[i]] = min(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(near, pa.float64())], names=[f.name for f in schema])

    path = f"{shared_dir(spark)}/vectors_{uuid.uuid4().hex}"
    given.mapInArrow(run, schema).repartitionByRange("cell", "near").sortWithinPartitions("cell", "near").write.partitionBy("cell").parquet(path)
    return Collection(spark.read.schema(schema).parquet(path), key, chosen)


def nearest(collection: Collection, query: list[float], n: int, where: Column | None = None) -> Nearest:
    """The n nearest rows of those that `where` holds of, by cosine distance, ties to the smaller key; the distances are those of cosine_distance()."""
    rows = collection.rows if where is None else collection.rows.filter(where)
    q = np.array(query, float)
    pivots, size = collection.pivots, float(np.linalg.norm(q)) if len(q) else 0.0
    bounded = len(pivots) > 0 and len(q) == pivots.shape[1] and 0 < size < np.inf
    asked = F.array(*[F.lit(float(x)) for x in q]).cast("array<double>")
    left = rows
    if bounded:
        own = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ (q / size))))
        to = F.array(*[F.lit(float(x)) for x in own])
        upper = F.array_min(F.zip_with("far", to, lambda a, b: a + b))
        lower = F.array_max(F.zip_with("far", to, lambda a, b: F.abs(a - b)))
        # rows without bounds may be anywhere, but n others are within `reach`
        reach = rows.filter("far IS NOT NULL").select(upper.alias("upper")).orderBy("upper").limit(n).agg(F.max("upper").alias("most"), F.count("*").alias("n")).first()
        if reach.n == n:
            most = reach.most + 1e-6
            cells = c("cell") == -1
            for i, d in enumerate(own.tolist()):
                cells = cells | ((c("cell") == i) & c("near").between(d - most, d + most))
            left = rows.filter(cells & (c("far").isNull() | (lower <= most)))
    distance = F.round(S.cosine_distance(c("embedding"), asked), 9)
    scored = written(left.select(c(collection.key), distance.alias("distance")), "distances")
    best = scored.orderBy("distance", collection.key).limit(n)
    return Nearest(best, rows.count(), scored.count())


def archive_search(collection: Collection, chunks: DataFrame, query: list[float], k: int = 10, project: str | None = None, topic: str | None = None, most: int = 3, text: str = "text") -> DataFrame:
    """(key, session_id, chunk, distance, expanded): the k nearest chunks of a project and topic, of the 2k nearest `most` a session at most, each
    with the text of the chunks before and after it. `chunks` (session_id, chunk, text) is the archive, of which the collection has a row each."""
    where = F.lit(True)
    for name, value in (("project", project), ("topic", topic)):
        if value is not None:
            where = where & (c(name) == value)
    best = nearest(collection, query, 2 * k, where).rows
    named = collection.rows.select(collection.key, "session_id", "chunk").join(F.broadcast(best), collection.key)  # 2k rows
    kept = written(capped_per_key(named, ["session_id"], [c("distance"), c(collection.key)], most).orderBy("distance", collection.key).limit(k), "archive_hits")
    # the neighbours of k chunks, not those of the archive
    beside = F.broadcast(kept.select("session_id", F.explode(F.array(c("chunk") - 1, c("chunk"), c("chunk") + 1)).alias("chunk")).distinct())
    around = with_neighbours(chunks.join(beside, ["session_id", "chunk"], "left_semi"), ["session_id"], "chunk", text)
    return kept.join(around, ["session_id", "chunk"]).select(collection.key, "session_id", "chunk", "distance", "expanded")
