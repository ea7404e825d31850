"""Sharding by histogram sort, near-equal in bytes.

Rows are ordered by (hash of the text, hash of the document's id). Candidate boundaries between shards are probed all at
once: the exact bytes below each are counted over all partitions, and the intervals that hold the splitters shrink until
each splitter meets the tolerance. Then rows are exchanged once, each shard dealt over places by hash; what the driver
holds depends on the number of shards alone.
Equal texts stay in one shard unless their group alone would break the tolerance; such a group is cut by the second hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import fresh_names, stored

SHARDS, TOLERANCE, PROBES = 8, 0.01, 31
#: Bytes of text that one task is dealt, while there are no more than so many places; beyond that places grow.
PLACE_BYTES, MOST_PLACES = 64 << 20, 100_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _sums_below(table: DataFrame, key: str, probes: list[int]) -> list[int]:
    """Exact bytes of rows with a key below each of the ascending probes; one pass, `len(probes)` sums from each task."""
    edges = np.array(probes, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, np.array(batch.column(0)), side="right")
            np.add.at(total, at, np.array(batch.column(1)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "bytes"])

    found = {r.at: r.bytes for r in table.select(key, "size").mapInArrow(run, "at long, bytes long").groupBy("at").agg(F.sum("bytes").alias("bytes")).collect()}
    return np.cumsum([found.get(i, 0) for i in range(len(edges))]).tolist()


def refine(table: DataFrame, key: str, targets: list[int], slack: float, start: int = 0, total: int | None = None) -> list[tuple[int, int, bool]]:
    """For each target (ascending bytes): (boundary, bytes below it, whether it is within `slack`).

    Where no boundary is, the boundary is the one key whose rows reach over the target.
    """
    low = [(_LOW, start)] * len(targets)
    high = [(_HIGH, total)] * len(targets)
    out: list[tuple[int, int, bool] | None] = [None] * len(targets)
    while any(o is None for o in out):
        probes = set()
        for i, goal in enumerate(targets):
            if out[i] is None:
                (a, fa), (b, fb) = low[i], high[i]
                n = min(PROBES, b - a - 1)
                probes |= {a + (b - a) * k // (n + 1) for k in range(1, n + 1)}
                if fb > fa and n > 2:  # hashes are spread evenly, so the goal is near its share of the interval
                    middle = a + (b - a) * (goal - fa) // (fb - fa)
                    step = max(1, (b - a) // 2000)
                    probes |= {p for p in (middle - step, middle, middle + step) if a < p < b}
        ordered = sorted(probes)
        below = [start + x for x in _sums_below(table, key, ordered)] if ordered else []
        for i, goal in enumerate(targets):
            if out[i] is not None:
                continue
            for p, f in zip(ordered, below):
                if low[i][0] < p < high[i][0]:
                    if f <= goal:
                        low[i] = (p, f)
                    else:
                        high[i] = (p, f)
                        break
            (a, fa), (b, fb) = low[i], high[i]
            near = (a, fa) if goal - fa <= fb - goal else (b, fb)
            if abs(near[1] - goal) <= slack:
                out[i] = (*near, True)
            elif b - a <= 1:
                out[i] = (a, fa, False)
    return out


def _place(key: Column, second: Column, splitters: list[tuple[int, int]], first: int = 0) -> Column:
    """How many splitters (ascending, key then second) aren't above the row, as a balanced tree of comparisons."""
    if not splitters:
        return F.lit(first)
    m = len(splitters) // 2
    a, b = splitters[m]
    at_or_past = (key > F.lit(a).cast("long")) | ((key == F.lit(a).cast("long")) & (second >= F.lit(b).cast("long")))
    return F.when(at_or_past, _place(key, second, splitters[m + 1 :], first + m + 1)).otherwise(_place(key, second, splitters[:m], first))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text", place_bytes: int = PLACE_BYTES, most_places: int = MOST_PLACES) -> DataFrame:
    """`docs` with columns size (UTF-8 bytes of the text and 1), shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Names that clash get an underscore. Each shard's bytes differ from the mean by `tolerance` of it at most, unless
    single rows, or rows equal in id and text, are larger. Null text has no bytes and its own group; null ids are one id. Repeated
    rows are rows of their own. An empty table gives no rows.
    """
    body, ident = F.col(f"`{text}`"), F.col(f"`{key}`")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1
    first, second = F.xxhash64(body.isNull(), body), F.xxhash64(F.lit("second"), ident)
    digest = stored(docs.select(first.alias("first"), second.alias("second"), size.alias("size")), "shard_keys")
    total = digest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * i // shards for i in range(1, shards)]
    splitters: list[tuple[int, int]] = []
    if total:
        slack = tolerance * total / shards / 2
        found = refine(digest, "first", targets, slack, 0, total)
        splitters = [(p, _LOW) for p, _, _ in found]
        for hot in sorted({p for p, _, ok in found if not ok}):  # groups too large to stay whole: fewer than splitters
            own = [i for i, f in enumerate(found) if f[0] == hot and not f[2]]
            group = digest.filter(F.col("first") == hot)
            held = group.agg(F.sum("size")).first()[0]
            base = found[own[0]][1]
            for i, (p, _, _) in zip(own, refine(group, "second", [targets[i] for i in own], slack, base, base + held)):
                splitters[i] = (hot, p)
    splitters.sort()
    # equal rows share a place; all others of a shard, copies of one text included, are dealt over its places evenly
    per_shard = max(1, min(-(-total // (shards * place_bytes)), most_places // shards))
    n = shards * per_shard
    place = lambda first, second: (_place(first, second, splitters) * per_shard + F.pmod(F.xxhash64(F.lit("place"), first, second), F.lit(per_shard))).cast("int")
    counts = digest.groupBy(place(F.col("first"), F.col("second")).alias("place")).agg(F.count("*").alias("n"))  # `most_places` rows at most
    earlier = Window.partitionBy(F.floor(F.col("place") / per_shard)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size_, shard_, slot_, place_, first_, second_, index_, start_ = fresh_names(docs.columns, "size", "shard", "slot", "place", "first", "second", "index", "start")
    starts = stored(counts.select(F.col("place").alias(place_), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start_)), "places")
    q = lambda c: F.col(f"`{c}`")
    keyed = docs.withColumns({size_: size, first_: first, second_: second})
    keyed = keyed.withColumn(place_, place(q(first_), q(second_)))
    # the only exchange of rows; a place is a partition, so the row's index in it gives its slot
    sent = keyed.repartitionById(n, q(place_)).sortWithinPartitions(first_, second_).withColumn(index_, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    slotted = sent.join(F.broadcast(starts), place_)  # bounded by `most_places`
    return slotted.select(*[q(c) for c in docs.columns], q(size_), F.floor(q(place_) / per_shard).cast("int").alias(shard_), (q(start_) + q(index_)).alias(slot_))
