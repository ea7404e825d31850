"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a set of three-word shingles, and a document holds the window only if it holds all of them. So one shingle, the
rarest over all documents, is the prefix that is necessary: documents meet windows at that shingle alone. Bounds of length and position
follow, then the words themselves are compared. Texts aren't exchanged: a document's row goes on with the words around its shingles that may
be some window's prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Hasher, byte_views, stored, words
from skein.llm.dealt import attached

WINDOW, SHINGLE = 10, 3
#: Bits of the filter of shingles: so many for each shingle, within these bounds (32 MB at most).
FILTER_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28

#: A-Z in lower case; bytes that are in no word become blanks.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[0x41:0x5B] += 0x20
for _a, _b in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    _BYTES[_a:_b] = 0x20


def _windows(items: DataFrame, seed: int) -> DataFrame:
    """(item, words, n, tokens): the windows of each item, their words joined by blanks, and the hashes of their shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in batches:
            for lo, _, data, offsets in byte_views(batch.column(1)):
                data = _BYTES[data]
                starts, ends, doc = words(data, offsets)
                sums, size = hasher.sums(hasher.slices(data, starts, ends)), np.bincount(doc, None, len(offsets) - 1)
                first = np.concatenate([[0], np.cumsum(size)])
                tokens = {}
                for k in range(1, SHINGLE + 1):
                    at, h = hasher.of_sums(sums, doc, k)
                    tokens[k] = np.zeros(len(starts), np.int64)
                    tokens[k][at] = h.view(np.int64)
                raw = data.tobytes()
                spelled = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
                for d in np.flatnonzero(size).tolist():
                    n = min(WINDOW, int(size[d]))
                    k, heads, item = min(SHINGLE, n), range(int(first[d]), int(first[d + 1]) - n + 1), batch.column(0)[lo + d].as_py()
                    for some in range(0, len(heads), 4096):
                        at = heads[some : some + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([item] * len(at), pa.string()), pa.array([" ".join(spelled[a : a + n]) for a in at]), pa.array([n] * len(at), pa.int32()), pa.array([tokens[k][a : a + n - k + 1] for a in at], pa.list_(pa.int64()))],
                            names=["item", "words", "n", "tokens"],
                        )

    return items.mapInArrow(run, "item string, words string, n int, tokens array<long>")


def _filter(tokens: DataFrame) -> np.ndarray:
    """A bitmap with two bits for each token, FILTER_BITS bits a token in all, MOST_BITS at most."""
    count = tokens.count()
    bits = int(np.clip(FILTER_BITS << max(0, count - 1).bit_length(), LEAST_BITS, MOST_BITS))
    place = lambda t: F.pmod(t, F.lit(bits))
    at = tokens.select(F.explode(F.array(place(F.col("token")), place(F.shiftright("token", 32)))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[np.array(rows.column(0), np.int64)] = np.array(rows.column(1)).view(np.uint64)
    return out


def _held(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the tokens that the filter lets through."""
    low, one = np.uint64(64 * len(bitmap) - 1), np.uint64(1)
    bit = lambda at: (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & one
    some = np.flatnonzero(bit(tokens & low))
    return some[bit((tokens[some] >> np.uint64(32)) & low).astype(bool)]


def _token_counts(docs: DataFrame, sizes: list[int], bitmap, seed: int) -> DataFrame:
    """(token, n): how often each shingle of the filter stands in all documents (and some that only seem to be of the filter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in byte_views(batch.column(0)):
                data = _BYTES[data]
                starts, ends, doc = words(data, offsets)
                sums = hasher.sums(hasher.slices(data, starts, ends))
                for k in sizes:
                    h = hasher.of_sums(sums, doc, k)[1]
                    found.append(h[_held(h, bitmap.value)])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


_CANDIDATE = pa.list_(pa.struct([("pos", pa.int64()), ("token", pa.int64()), ("before", pa.int32()), ("words", pa.string())]))


def _candidates(docs: DataFrame, sizes: list[int], bitmap, seed: int) -> DataFrame:
    """(rid, doc_id, n_words, found) of each document: its shingles of the filter, each with the words of all windows that could lie over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in batches:
            for lo, hi, data, offsets in byte_views(batch.column(2)):
                data = _BYTES[data]
                starts, ends, doc = words(data, offsets)
                size = np.bincount(doc, None, len(offsets) - 1)
                first = np.concatenate([[0], np.cumsum(size)])
                sums, raw = hasher.sums(hasher.slices(data, starts, ends)), data.tobytes()
                out: list[list] = [[] for _ in size]
                for k in sizes:
                    at, h = hasher.of_sums(sums, doc, k)
                    held = _held(h, bitmap.value)
                    at, tokens = at[held], h[held].view(np.int64)
                    owner = doc[at]
                    reach = WINDOW - k if k == SHINGLE else 0  # a shorter shingle is a whole window
                    a, b = np.maximum(at - reach, first[owner]), np.minimum(at + k + reach, first[owner + 1])
                    for d, pos, token, before, x, y in zip(owner.tolist(), (at - first[owner]).tolist(), tokens.tolist(), (at - a).tolist(), starts[a].tolist(), ends[b - 1].tolist()):
                        out[d].append({"pos": pos, "token": token, "before": before, "words": b" ".join(raw[x:y].split()).decode()})
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size.astype(np.int64)), pa.array(out, _CANDIDATE)], names=["rid", "doc_id", "n_words", "found"])

    schema = "rid long, doc_id {}, n_words long, found array<struct<pos:long,token:long,before:int,words:string>>"
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, schema.format(docs.schema["doc_id"].dataType.simpleString()))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, window items).

    `documents` (rid, doc_id, n_words) has a row for each row of `docs`, numbered by rid; `hits` (rid, start, n, wid) tells which window
    lies where, in words from 0; `window items` (wid, item) tells which items have the window. Each is written to the shared folder.
    """
    seed = Hasher().seed
    named = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    of_items = stored(_windows(named, seed).withColumn("wid", F.substring(F.unhex(F.sha2("words", 256)), 1, 16)), "item_windows")
    windows = of_items.groupBy("wid").agg(*[F.first(c).alias(c) for c in ("words", "n", "tokens")])
    grams = stored(windows.select("wid", "words", "n", F.posexplode("tokens").alias("offset", "token")), "window_shingles")
    sizes = sorted(r.k for r in grams.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())  # SHINGLE values at most
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    context = docs.sparkSession.sparkContext
    counts = stored(_token_counts(texts.select("text"), sizes, context.broadcast(_filter(grams.select("token").distinct())), seed), "shingle_counts")
    # a window with a shingle that no document holds can't occur; of the others the rarest shingle is the prefix
    rarity = attached(grams, "token", ["wid", "offset"], counts.withColumnRenamed("n", "often"))
    least = rarity.groupBy("wid").agg(F.min(F.struct("often", "token", "offset")).alias("least"), F.count("*").alias("known"), F.first("words").alias("words"), F.first("n").alias("n"))
    whole = F.col("known") == F.col("n") - F.least("n", F.lit(SHINGLE)) + 1
    prefixes = stored(least.filter(whole).select("wid", "n", F.col("words").alias("window"), F.col("least.token").alias("token"), F.col("least.offset").alias("offset")), "prefixes")
    kept = sorted(r.k for r in prefixes.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    rows = stored(_candidates(texts, kept, context.broadcast(_filter(prefixes.select("token").distinct())), seed), "shingles_found")
    found = rows.filter(F.size("found") > 0).select("rid", "n_words", F.explode("found").alias("f")).select("rid", "n_words", "f.*")
    met = attached(found, "token", ["rid", "pos"], prefixes)
    start, at = F.col("pos") - F.col("offset"), F.col("before") - F.col("offset")
    bounded = met.filter((F.col("n_words") >= F.col("n")) & (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (at >= 0))
    same = F.array_join(F.slice(F.split("words", " "), at + 1, F.col("n")), " ") == F.col("window")
    hits = stored(bounded.filter(same).select("rid", start.alias("start"), "n", "wid"), "hits")
    return rows.select("rid", "doc_id", "n_words"), hits, of_items.select("wid", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of `docs`.

    Null and empty texts have no words; rows that repeat each get the same result. Null item ids count as the empty string, items that
    repeat an id as one. Texts of any length are read whole, and only the named columns. Without items nothing is hit, and without
    documents there are no rows.
    """
    rows, hits, window_items = contamination(docs, items, doc_id, text, item_id, item_text)
    spans = hits.repartition("rid").groupBy("rid", "start").agg((F.col("start") + F.max("n")).alias("end"))
    so_far = F.max("end").over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(so_far, F.lit(0))), F.lit(0))).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    # documents with the same windows have the same items, which are found once
    sets = stored(hits.groupBy("rid").agg(F.sort_array(F.collect_set("wid")).alias("wids")).withColumn("sig", F.sha2(F.array_join(F.transform("wids", F.hex), ","), 256)), "window_sets")
    members = stored(sets.groupBy("sig").agg(F.first("wids").alias("wids")).select("sig", F.explode("wids").alias("wid")), "set_windows")
    listed = attached(members, "wid", "sig", window_items).select("sig", "item").distinct().groupBy("sig").agg(F.sort_array(F.collect_list("item")).alias("items"))
    digests = listed.select("sig", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    of_doc = attached(sets.select("rid", "sig"), "sig", "rid", digests).select("rid", "n_items", "items_sha256")
    zero = F.lit(0).cast("long")
    return rows.join(covered, "rid", "left").join(of_doc, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (
  SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0
), n AS (SELECT DISTINCT n FROM s), o AS (
  SELECT rid, n.n AS n, unnest(range(1, CAST(len(w) - n.n + 2 AS BIGINT))) AS start, unnest(list_transform(range(1, CAST(len(w) - n.n + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + n.n - 1], ' '))) AS win
  FROM d, n WHERE len(w) >= n.n
), h AS (SELECT rid, start, n, item FROM o JOIN s USING (n, win)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(start, start + n)) AS pos FROM (SELECT DISTINCT rid, start, n FROM h)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""
