"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Candidates that lie near each other share a shard, each with a ball tree; a shard is found by a few comparisons that a
bounded sample fixed. Groups of queries meet the shards' root balls first: a query searches the stripe of shards with the
highest bound q.c + |q| r, and then, with the k-th score of that, only the stripes whose bound still reaches it. A task
searches the shards of its stripe one after another and carries each query's current k-th score from one to the next.
Nodes are ordered by their bound; those below the k-th score are never opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored

SHARD_ROWS, LEAF_ROWS = 4096, 128
#: Largest stripe and group of queries; smaller ones where there would be fewer than two cells for each partition.
STRIPE_SHARDS, GROUP_QUERIES = 16, 32_768
#: Bytes of vectors that a shard, a stripe, a group of queries and a pack of roots hold at most: long vectors get smaller ones.
CELL_BYTES = 64 << 20
#: Roots that a group of queries meets at a time, and rows of the sample that the split into cells is learned from.
PACK_ROOTS, SAMPLE_ROWS, SAMPLED_LENGTHS, CELLS = 4096, 4096, 64, 256
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; rows without id, or with null or non-finite parts, are left out."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    sound = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    # floor() of a double is a long in SQL, so values beyond it are kept as doubles, which are whole numbers there
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return vectors.filter(sound & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(e, whole).alias("v"))


@dataclass
class BallTree:
    """Balls of a binary tree over rows of `points`; leaves hold runs of rows."""

    points: np.ndarray
    ids: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    left: np.ndarray  # child, or -1 at a leaf; the right child follows it
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> BallTree:
        order, nodes, todo = np.arange(len(ids)), [[0, len(ids), -1]], [0]
        while todo:
            k = todo.pop()
            lo, hi, _ = nodes[k]
            if hi - lo <= leaf:
                continue
            own = points[order[lo:hi]]
            axis = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else 0
            if own.shape[1] == 0 or own[:, axis].max() == own[:, axis].min():
                continue  # equal vectors: a ball of radius 0 however large
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], middle)]
            nodes[k][2] = len(nodes)
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[lo, lo + middle, -1], [lo + middle, hi, -1]]
        table = np.array(nodes, np.int64)
        center, radius = np.zeros((len(nodes), points.shape[1])), np.zeros(len(nodes))
        for k, (lo, hi, _) in enumerate(nodes):
            own = points[order[lo:hi]]
            center[k] = own.mean(0)
            radius[k] = np.sqrt(((own - center[k]) ** 2).sum(1).max())
        return cls(points[order], ids[order], center, radius, table[:, 2], table[:, 0], table[:, 1])


@dataclass
class Best:
    """The k best (score, id) of each query so far; unused places have `used` false."""

    k: int
    score: np.ndarray
    ids: np.ndarray
    used: np.ndarray

    @classmethod
    def empty(cls, n: int, k: int) -> Best:
        return cls(k, np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k), bool))

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, used: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], 1)
        u = np.concatenate([self.used[rows], used], 1)
        order = np.lexsort((i, -s, ~u), axis=-1)[:, : self.k]
        self.score[rows], self.ids[rows], self.used[rows] = (np.take_along_axis(x, order, 1) for x in (s, i, u))

    def floor(self) -> np.ndarray:
        """k-th score of each query, -inf while there are fewer."""
        return np.where(self.used[:, -1], self.score[:, -1].astype(np.float64), -np.inf)


def scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2**53, else as Python integers, held to a long."""
    most = (np.abs(q).max(initial=0) * np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return q @ p.T
    whole = lambda a: np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    return np.clip(whole(q) @ whole(p).T, -_LONG - 1, _LONG)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, known: np.ndarray, best: Best) -> int:
    """Adds to `best` what the tree holds; returns how many (query, leaf) pairs were opened. `known`: a k-th score found elsewhere."""
    norm = np.sqrt((queries**2).sum(1))
    slack = lambda b: b + 1e-9 * np.abs(b) + 1e-6  # noqa: E731  rounding of the bound
    bound = lambda rows, k: slack(queries[rows] @ tree.center[k] + norm[rows] * tree.radius[k])
    floor = lambda: np.maximum(known, best.floor())
    opened, everyone = 0, np.arange(len(queries))
    level, leaves = [(0, everyone, bound(everyone, 0))], []
    while level:  # down the tree, with the queries that a node may still serve
        at, below = floor(), []
        for k, rows, ub in level:
            live = ub >= at[rows]
            rows, ub = rows[live], ub[live]
            if not len(rows):
                continue
            if tree.left[k] < 0:
                leaves.append((k, rows, ub))
            else:
                below += [(c, rows, bound(rows, c)) for c in (tree.left[k], tree.left[k] + 1)]
        level = below
    if not leaves:
        return 0
    ub = np.full((len(queries), len(leaves)), -np.inf)
    for j, (_, rows, b) in enumerate(leaves):
        ub[rows, j] = b
    order = np.argsort(-ub, axis=1, kind="stable")
    for turn in range(len(leaves)):  # each query opens its most promising leaf, then the next
        pick = order[:, turn]
        live = ub[everyone, pick] >= floor()
        live &= ub[everyone, pick] > -np.inf
        if not live.any():
            break
        for j in np.unique(pick[live]):
            rows, k = everyone[live & (pick == j)], leaves[j][0]
            a, b = tree.lo[k], tree.hi[k]
            got = scores(queries[rows], tree.points[a:b])
            opened += len(rows)
            use = (tree.ids[a:b] != query_ids[rows][:, None]) & (got >= floor()[rows][:, None])
            busy = np.flatnonzero(use.any(0))
            if len(busy):
                if got.dtype == object and best.score.dtype != object:
                    best.score = np.vectorize(int, otypes=[object])(best.score)
                best.merge(rows, got[:, busy], tree.ids[a:b][busy], use[:, busy])
    return opened


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def _trees(group: pa.Table) -> pa.Table:
    ids, points = np.array(group["vec_id"]), _matrix(group["v"])
    order = np.argsort(ids, kind="stable")
    t = BallTree.build(points[order], ids[order])
    raw = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    keys = {c: group[c][:1] for c in ("dims", "cell", "part")}
    return pa.table(keys | {"points": raw(t.points), "ids": raw(t.ids), "center": raw(t.center), "radius": raw(t.radius), "nodes": raw(np.stack([t.left, t.lo, t.hi])), "root": pa.array([t.center[0]], pa.list_(pa.float64())), "reach": pa.array([float(t.radius[0])])})


def _tree(row: dict) -> BallTree:
    ids = np.frombuffer(row["ids"], np.int64)
    radius = np.frombuffer(row["radius"])
    left, lo, hi = np.frombuffer(row["nodes"], np.int64).reshape(3, -1)
    return BallTree(np.frombuffer(row["points"]).reshape(len(ids), -1), ids, np.frombuffer(row["center"]).reshape(len(radius), -1), radius, left, lo, hi)


def split_cells(sample: np.ndarray, cells: int) -> list:
    """A tree of comparisons [axis, value, below, else], or a cell's number, that cuts the sample at the medians of its widest axes."""
    count = iter(range(2 * cells))

    def cut(points: np.ndarray, many: int):
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(0)
        if many < 2 or not spread.size or spread.max() == 0:
            return next(count)
        axis = int(spread.argmax())
        value = float(np.median(points[:, axis]))
        low = points[:, axis] < value
        if not low.any():
            value = float(points[:, axis][points[:, axis] > value].min())
            low = points[:, axis] < value
        return [axis, value, cut(points[low], many // 2), cut(points[~low], many - many // 2)]

    return cut(sample, cells)


def _cell(tree, v: Column) -> Column:
    if not isinstance(tree, list):
        return F.lit(tree)
    axis, value, below, other = tree
    return F.when(F.get(v, F.lit(axis)) < F.lit(value), _cell(below, v)).otherwise(_cell(other, v))


def _cells(sized: DataFrame, shard_rows: int) -> Column:
    """The cell of a vector (dims, v). Only how many nodes a search opens depends on it, not what it finds: lengths that few
    vectors have, or that aren't among the commonest, are one cell."""
    common = sized.groupBy("dims").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).orderBy(F.desc("n"), "dims").limit(SAMPLED_LENGTHS).collect()
    out = F.lit(0)
    for r in common:
        own = sized.filter(F.col("dims") == r.dims).orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
        cells = min(CELLS, 1 << max(0, (r.n // shard_rows).bit_length()))
        out = F.when(F.col("dims") == r.dims, _cell(split_cells(np.array([x.v for x in own]), cells), F.col("v"))).otherwise(out)
    return out


def _bounds(best_only: bool):
    """Which stripes a group of queries has to search: the one of the highest bound, or all others that reach the k-th score."""
    kind = pa.schema([("vec_id", pa.int64()), ("stripe", pa.int64()), ("bound", pa.float64())])

    def run(asked: pa.Table, roots: pa.Table) -> pa.Table:
        if not len(asked) or not len(roots):
            return kind.empty_table()
        ids, known, done, queries = np.array(asked["vec_id"]), np.array(asked["known"]), np.array(asked["done"]), _matrix(asked["v"])
        stripe, center, reach = np.array(roots["stripe"]), _matrix(roots["root"]), np.array(roots["reach"])
        order = np.argsort(stripe, kind="stable")
        names, first = np.unique(stripe[order], return_index=True)
        out = []
        for lo in range(0, len(ids), 512):
            q = queries[lo : lo + 512]
            b = q @ center.T + np.sqrt((q**2).sum(1))[:, None] * reach
            b = np.maximum.reduceat((b + 1e-9 * np.abs(b) + 1e-6)[:, order], first, axis=1)  # with room for rounding
            if best_only:
                x, y = np.arange(len(q)), b.argmax(1)
            else:
                x, y = np.nonzero((b >= known[lo : lo + 512, None]) & (names[None, :] != done[lo : lo + 512, None]))
            out.append((ids[lo : lo + 512][x], names[y], b[x, y]))
        return pa.table([np.concatenate([o[i] for o in out]) for i in range(3)], schema=kind)

    return run


def _searched(k: int):
    """The k best of each query in a stripe, whose shards are searched by falling bound of their roots."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(asked: pa.Table, trees: pa.Table) -> pa.Table:
        if not len(asked) or not len(trees):
            return kind.empty_table()
        ids, known, queries = np.array(asked["vec_id"]), np.array(asked["known"]), _matrix(asked["v"])
        best = Best.empty(len(ids), k)
        bound = queries.mean(0) @ _matrix(trees["root"]).T + np.sqrt((queries**2).sum(1).max()) * np.array(trees["reach"])
        for i in np.argsort(-bound, kind="stable").tolist():
            search(_tree(trees.slice(i, 1).to_pylist()[0]), queries, ids, known, best)
        at = np.nonzero(best.used)
        return pa.table([pa.array(ids[at[0]]), pa.array(best.ids[at]), pa.array([int(s) for s in best.score[at]], pa.int64())], schema=kind)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    Both inputs are as from quantized(). A query meets the vectors of its own length, but those of its own id;
    of queries with one id the smallest counts, and repeated vectors are candidates each. With fewer candidates
    than k all are returned; empty tables give no rows. A score beyond a long is held to it.
    """
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = stored(vectors.withColumn("dims", F.size("v")), "vectors")
    fits = max(1, CELL_BYTES // (8 * max(1, sized.agg(F.max("dims")).first()[0] or 0)))  # vectors of a cell
    shard_rows = min(shard_rows, fits)
    celled = sized.withColumn("cell", _cells(sized, shard_rows))
    parts = celled.groupBy("dims", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))  # SAMPLED_LENGTHS * CELLS rows, and one for each other length
    placed = celled.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    built = placed.select("dims", "cell", "part", "vec_id", "v").groupBy("dims", "cell", "part")
    trees = stored(built.applyInArrow(_trees, "dims int, cell int, part long, points binary, ids binary, center binary, radius binary, nodes binary, root array<double>, reach double"), "ball_trees")
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v")), "queries")
    shards, wanted = trees.count(), asked.count()
    stripe_shards = min(STRIPE_SHARDS, max(1, fits // shard_rows), max(1, shards // (2 * partitions)))
    groups = max(1, -(-wanted // min(GROUP_QUERIES, fits, max(512, -(-wanted // (2 * partitions))))))
    # shards by number, near ones after each other: three numbers a shard
    number = F.row_number().over(Window.partitionBy("dims").orderBy("cell", "part")) - 1
    named = trees.select("dims", "cell", "part").withColumn("number", number).select("dims", "cell", "part", F.floor(F.col("number") / stripe_shards).alias("stripe"), F.floor(F.col("number") / min(PACK_ROOTS, fits)).alias("pack"))
    trees = stored(trees.join(named, ["dims", "cell", "part"]), "stripes")
    packs = trees.select("dims", "pack").distinct()
    asked = asked.withColumn("group", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(groups)))

    def cogrouped(left: DataFrame, right: DataFrame, *keys: str):
        # a number of partitions that is asked for stays, however small the rows are: a cell is much work
        own = right.withColumnsRenamed({k: f"{k}_of_tree" for k in keys})
        other = [f"{k}_of_tree" for k in keys]
        return left.repartition(partitions, *keys).groupBy(*keys).cogroup(own.repartition(partitions, *other).groupBy(*other))

    def stripes(asked: DataFrame, best_only: bool) -> DataFrame:
        """(vec_id, stripe) that _bounds names for the queries (vec_id, v, dims, group, known, done)."""
        met = asked.join(packs, "dims")
        roots = trees.select("dims", "pack", "stripe", "root", "reach").join(met.select("dims", "pack", "group").distinct(), ["dims", "pack"])
        live = cogrouped(met, roots, "dims", "pack", "group").applyInArrow(_bounds(best_only), "vec_id long, stripe long, bound double")
        live = live.groupBy("vec_id").agg(F.max_by("stripe", F.struct("bound", "stripe")).alias("stripe")) if best_only else live.select("vec_id", "stripe")
        return stored(live, "live_stripes")

    def searched(asked: DataFrame, live: DataFrame) -> DataFrame:
        """The k best of each query in each of its live stripes. A stripe's trees are sent to a group of queries if one of them is live there."""
        pairs, cell = live.join(asked, "vec_id"), ["dims", "stripe", "group"]
        sent = trees.drop("cell", "part", "pack").join(pairs.select(*cell).distinct(), ["dims", "stripe"])
        return cogrouped(pairs.select(*cell, "vec_id", "v", "known"), sent, *cell).applyInArrow(_searched(k), "query_id long, vec_id long, score long")

    fresh = asked.withColumns({"known": F.lit(float("-inf")), "done": F.lit(-1).cast("long")})
    chosen = stripes(fresh, True)
    first = stored(searched(fresh, chosen), "first_stripe")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("kth"), F.count("*").alias("found"))
    tops = asked.join(chosen.withColumnRenamed("stripe", "done"), "vec_id").join(kth, "vec_id", "left")
    tops = tops.withColumn("known", F.when(F.col("found") == k, F.col("kth").cast("double")).otherwise(float("-inf"))).drop("kth", "found")
    rest = searched(tops, stripes(tops, False))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
