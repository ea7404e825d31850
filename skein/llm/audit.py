"""Filter interaction audit by an incidence matrix product.

Every document is reduced to a mask of the filters that it fails. The masks are counted by part, for all documents and for those with
each label; these histograms, stacked as rows of 32 counts, are multiplied by integer matrices of 32 masks by 600 columns, a column for
each step of each of the 120 orders. The products are what each step keeps, removes, finds removed already, or is alone to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Hasher, byte_views, same_slices, words

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 2
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_SYMBOL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CAPITAL[0x41:0x5B] = True


class _Collision(Exception):
    """Two different words have one hash."""


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int, hasher: Hasher) -> np.ndarray:
    """Different words of each of n documents; words of one hash are compared byte by byte."""
    _, first, ids = np.unique(hasher.slices(data, starts, ends), return_index=True, return_inverse=True)
    rep, sizes = first[ids], ends - starts
    if not ((sizes == sizes[rep]).all() and same_slices(data, starts, data, starts[rep], sizes).all()):
        raise _Collision
    return np.bincount(np.unique(doc * max(1, len(first)) + ids) // max(1, len(first)), None, n)


def text_masks(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """The masks of A to D of the documents that lie end to end in `data`."""
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    count = np.bincount(doc, None, n)
    while True:
        try:
            distinct = _distinct(data, starts, ends, doc, n, hasher)
            break
        except _Collision:
            hasher = Hasher()
    of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    points, capitals = of((data & 0xC0) != 0x80), of(_CAPITAL[data])
    fails = [count < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * count, 100 * capitals > MAX_CAPITALS_PERCENT * points, of(_SYMBOL[data]) > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest of the text) of each document; texts don't go on from here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in byte_views(batch.column(2)):
                raw = memoryview(np.ascontiguousarray(data))
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text_masks(data, offsets, hasher).astype(np.int32)), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return docs.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask of A to E, all of them and those with each label.

    No row is joined with the copies of its text: rows are first counted by text, part, mask and labels, where the least id and its
    count are kept; of these counts those that hold the text's least id of all parts don't fail E.
    """
    one = _masked(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))  # repeated rows become one
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # rows without an id have no label and are many tasks' work
    lone = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(1 << 20)) + 1).otherwise(0)
    marked = one.withColumn("lone", lone).withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long")))
    both = marked.join(known.withColumn("zero", F.lit(0)), (F.col("key") == F.col("id")) & (F.col("lone") == F.col("zero")), "left")
    rows = both.select("doc_id", "digest", "part", "mask", "n", F.coalesce("good", F.lit(0).cast("long")).alias("good"), F.coalesce("toxic", F.lit(0).cast("long")).alias("toxic"))
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("least"),
        # one id has one row here, unless its rows differ in part or label
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("at_least"),
    )
    # a text has as many rows here as it has parts and labels
    back = copies.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    passes = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least.n")).otherwise(0)
    split = back.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", passes.alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - passes).alias("n")))).alias("m"))
    times = lambda c: F.sum(F.col(c) * F.col("m.n")).alias(c)
    return split.filter("m.n > 0").groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum("m.n").alias("n"), times("good"), times("toxic"))


@lru_cache(1)
def matrices() -> dict[str, np.ndarray]:
    """Incidence matrices of 32 masks by 600 columns (order, then step), and `by_filter`, of 600 columns by 600, which sums a filter's steps."""
    masks = np.arange(1 << STEPS)[:, None]
    own = np.array([BIT[o[s]] for o in ORDERS for s in range(STEPS)])[None, :]
    before = np.array([sum(BIT[f] for f in o[:s]) for o in ORDERS for s in range(STEPS)])[None, :]
    fails, gone = (masks & own) > 0, (masks & before) > 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own, "by_filter": own.T == own}
    return {k: v.astype(np.int64) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def outcomes(all_: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of stacked histograms (parts by 32 masks): arrays of parts by 600."""
    m = matrices()
    out = {name: all_ @ m[name] for name in ("kept", "removed", "redundant", "unique_fails")}
    return out | {"good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"], "shapley": out["removed"] @ m["by_filter"]}


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, COUNTS): 600 rows for each part, for the five filters in each of their 120 orders.

    A null text is empty, a null part the empty string. Copies of a text fail E unless their id is the least in the table; repeated rows
    of the least id all pass, and rows without an id never fail E, nor have they a label. A document has a label if any row of `labels`
    gives it; null labels give none. Only the three named columns of `docs` are read. An empty table gives no rows.
    """
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    found = histograms(named, labels)
    rows = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = pa.array(np.repeat(ORDERS, STEPS)), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
        for whole in batches:
            for k in range(0, len(whole), 64):
                batch = whole.slice(k, 64)
                cells, stacked = batch.column(1).flatten(), np.zeros((3, len(batch), 1 << STEPS), np.int64)
                owner = np.repeat(np.arange(len(batch)), np.array(batch.column(1).value_lengths()))
                mask, *values = (np.array(cells.field(f)) for f in range(4))
                for h, v in zip(stacked, values):
                    h[owner, mask] = v
                got = outcomes(*stacked)
                parts = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), len(orders))))
                tiled = lambda a: pa.chunked_array([a] * len(batch)).combine_chunks()
                yield pa.RecordBatch.from_arrays([parts, tiled(orders), tiled(steps), *(pa.array(got[c].ravel()) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d
), m AS (
  SELECT part, doc_id,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS mask
  FROM w
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), h AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (own + before)::INT = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & before::INT = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & before::INT <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & before::INT = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r
"""
