"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles. A register keeps the truncated, exponentially spaced level of the
least of the elements' random values, so registers of a union are the maxima of the registers. Bands of registers find
candidates, the registers' order and the set sizes estimate similarity jointly by likelihood, and candidates that the
estimate doesn't rule out are verified on the full sets. Documents of one set are one class; only classes are compared.

Inside a band's bucket the members are compared with one leader, then with another, and at last every two members that
are still in different components are, in blocks inside a task that yields only the pairs worth verifying. No link
between members of a bucket is lost, and a bucket of thousands of copies costs a comparison each.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Hasher, byte_views, mixed, stored, words
from skein.llm.components import components


@dataclass(frozen=True)
class Settings:
    """`base`, `rate` and `levels` are SetSketch's b, a and q; `margin` is how far below the threshold an estimate may
    lie: five standard deviations of it. `sample` is about how many shingles of a long text the last comparison looks at before
    texts are verified, `block` how many members of a bucket a task compares at a time, `salts` into how many parts a hot key is dealt. At the threshold, a pair shares no band once in 50,000 times, above it less often."""

    shingle: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    levels: int = 65534
    margin: float = 0.16
    sample: int = 1024
    block: int = 2048
    seed: int = 11
    salts: int = 256

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, hasher: Hasher, second: Hasher | None = None) -> list:
    """Sorted distinct hashes of the shingles of each document; a document of fewer than n words has its whole sequence as one.

    With a `second` hasher, pairs of the set and its elements' second hashes.
    """
    data = _LOWER[data]
    starts, ends, doc = words(data, offsets)
    first = np.searchsorted(doc, np.arange(len(offsets)))

    def windows_of(hasher: Hasher):
        h = hasher.slices(data, starts, ends)
        at, w = hasher.windows(h, doc, n)
        edges = np.searchsorted(doc[at], np.arange(len(offsets)))

        def of(i: int) -> np.ndarray:
            many = first[i + 1] - first[i]
            if many >= n or not many:
                return w[edges[i] : edges[i + 1]]
            return mixed(hasher.windows(h[first[i] : first[i + 1]], np.zeros(many, np.int64), many)[1] + np.uint64(many))

        return of

    of = windows_of(hasher)
    if second is None:
        return [np.unique(of(i)) for i in range(len(offsets) - 1)]
    check, out = windows_of(second), []
    for i in range(len(offsets) - 1):
        own, k = np.unique(of(i), return_index=True)
        out.append((own, check(i)[k]))
    return out


def common_shingles(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two sets, whose elements are equal if both their hashes are (122 bits)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    return int(np.count_nonzero(x[1][i] == y[1][j]))


class Sketcher:
    def __init__(self, s: Settings):
        self.s = s
        self.factors = np.random.default_rng(s.seed).integers(0, 1 << 31, s.registers, np.uint32) * np.uint32(2) + np.uint32(1)
        self.room = np.empty((512, s.registers), np.uint32)

    def registers(self, elements: np.ndarray) -> np.ndarray:
        """Levels of the least random value of each register, higher for lesser ones."""
        x = (elements >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.s.registers, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), len(self.room)):
            part = x[k : k + len(self.room)]
            room = self.room[: len(part)]
            np.multiply(part[:, None], self.factors[None, :], out=room)
            np.minimum(least, room.min(0), out=least)
        value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)  # the least of the exponential values
        level = np.floor(1 - np.log(self.s.rate * value) / np.log(self.s.base))
        # truncated from above; shifted so that sets of one element have low levels too
        return np.clip(level + self.s.levels // 2, 0, self.s.levels + 1).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Similarity of pairs of sets (rows of registers, sizes) by maximum likelihood over the registers' order."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        above, under = p(u - v * j), p(v - u * j)
        return more * np.log(above) + less * np.log(under) + same * np.log(np.clip(1 - above - under, 1e-12, 1))

    lo, hi = np.zeros(len(a)), top.copy()
    for _ in range(30):  # the likelihood has one peak
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def sketched(docs: DataFrame, s: Settings, doc_id: str, text: str, seed: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, high, low, sketch) of each row of `docs`; high and low are a 128-bit digest of the set, null
    with the sketch for empty sets. Shingles count as one if they agree in 61 bits at a base that is secret until the run."""
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, hasher = Sketcher(s), Hasher(seed)
        for batch in batches:
            sizes, high, low, sketches = [], [], [], []
            for _, _, data, offsets in byte_views(batch.column(2)):
                for own in shingle_sets(data, offsets, s.shingle, hasher):
                    digest = xxhash.xxh3_128_intdigest(own.tobytes())
                    sizes.append(len(own))
                    high.append((digest >> 64) - (1 << 63) if len(own) else None)
                    low.append((digest & ((1 << 64) - 1)) - (1 << 63) if len(own) else None)
                    sketches.append(sketcher.registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "text_key", "n_shingles", "high", "low", "sketch"])

    return named.mapInArrow(run, "doc_id long, text_key long, n_shingles long, high long, low long, sketch binary")


def _attached(rows: DataFrame, key: str | list[str], other: str, table: DataFrame, s: Settings) -> DataFrame:
    """`rows` joined with `table` (one row for each key) by `key`, a hot key dealt by the hash of `other` into `salts` parts.

    A row of `table` is sent once for each part that has rows, `salts` times at most, so no task gets all rows of a key.
    """
    dealt = rows.withColumn("salt", F.pmod(F.hash(other), F.lit(s.salts)))
    keys = [key] if isinstance(key, str) else key
    sent = dealt.select(*keys, "salt").distinct().join(table, keys)
    return dealt.join(sent, [*keys, "salt"]).drop("salt")


def _estimated(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that their registers don't rule out."""
    least = s.percent / 100 - s.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(batch), -1) for k in (2, 4))
            na, nb = (np.array(batch.column(k), float) for k in (3, 5))
            keep = np.flatnonzero(estimate(a, b, na, nb, s.base) >= np.minimum(least, np.minimum(na / nb, nb / na)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    of = lambda side: sketches.select(F.col("class").alias(side), F.col("sketch").alias(f"s{side}"), F.col("n_shingles").alias(f"n{side}"))
    both = _attached(_attached(pairs, "a", "b", of("a"), s), "b", "a", of("b"), s)
    return both.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings, seed: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(seed), Hasher(seed + 1)

        def sets(classes: pa.Array, column: pa.Array) -> list:
            """Sets of a column of texts; runs of one class, as leaders come in, are read once."""
            ids = np.array(classes)
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            once = [x for _, _, data, offsets in byte_views(column.take(pa.array(first))) for x in shingle_sets(data, offsets, s.shingle, hasher, second)]
            return [once[r] for r in np.searchsorted(first, np.arange(len(ids)), side="right") - 1]

        for batch in batches:
            keep = []
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                for i, (x, y) in enumerate(zip(sets(part.column(0), part.column(1)), sets(part.column(2), part.column(3)))):
                    both = common_shingles(x, y)
                    if 100 * both >= s.percent * (len(x[0]) + len(y[0]) - both):
                        keep.append(k + i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take)], names=["u", "v"])

    of = lambda side: texts.select(F.col("class").alias(side), F.col("text").alias(f"t{side}"))
    both = _attached(_attached(pairs, "b", "a", of("b"), s), "a", "b", of("a"), s)
    return both.select("a", "ta", "b", "tb").mapInArrow(run, "u long, v long")


def _samples(texts: DataFrame, s: Settings, seed: int) -> DataFrame:
    """(class, level, sample): the shingles of a class's text as 32-bit hashes, of long texts those below 2**(32 - level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in batches:
            levels, samples = [], []
            for _, _, data, offsets in byte_views(batch.column(1)):
                for own in shingle_sets(data, offsets, s.shingle, hasher):
                    level = max(0, (len(own) - 1) // s.sample).bit_length()
                    half = np.unique((own >> np.uint64(32)).astype("<u4"))
                    levels.append(level)
                    samples.append(half[: np.searchsorted(half, 1 << (32 - level))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), pa.array(samples, pa.binary())], names=["class", "level", "sample"])

    return texts.select("class", "text").mapInArrow(run, "class long, level int, sample binary")


def _similar_by_sample(x: np.ndarray, y: np.ndarray, level: int, s: Settings) -> bool:
    """Whether samples, cut to one level, leave a link possible; whole sets do so exactly but for equal half hashes."""
    if level:
        x, y = (v[: np.searchsorted(v, 1 << (32 - level))] for v in (x, y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    slack = 0.01 if not level else 0.01 + 5 * 0.44 / max(every, 1) ** 0.5
    return both >= (s.percent / 100 - slack) * every


def _cells(members: DataFrame, s: Settings) -> DataFrame:
    """Members dealt into cells (bucket, cell): a bucket of one block is a cell, of more blocks each two blocks are."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    own = _attached(members, "bucket", "class", blocks, s).withColumn("block", F.pmod(F.hash("class"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return own.withColumn("other", other).withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).drop("other", "blocks")


def _apart(members: DataFrame, s: Settings) -> DataFrame:
    """(a, b): pairs of members of a bucket, of different labels, that neither registers nor samples rule out.

    Each task reads cells whole, `block` members of two blocks at most; a pair counts in the first band that it shares.
    """
    least = s.percent / 100 - s.margin
    fewest = int((least - 0.05) * s.registers)

    def pairs_of(cell: pa.Table) -> tuple[list, list]:
        col = lambda name: np.array(cell[name].combine_chunks())
        classes, n, label, block, band = col("class"), col("n").astype(float), col("label"), col("block"), int(cell["band"][0].as_py())
        sketch = np.frombuffer(b"".join(cell["sketch"].to_pylist()), "<u2").reshape(len(classes), -1)
        level, samples = col("level"), [np.frombuffer(x, "<u4") for x in cell["sample"].to_pylist()]
        alone = len(set(block)) == 1
        mine, others = [], []
        for i in range(len(classes) - 1):
            j = np.arange(i + 1, len(classes))
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= s.percent * np.maximum(n[j], n[i]))]
            if not alone:
                j = j[block[j] != block[i]]
            if len(j):
                j = j[np.count_nonzero(sketch[j] == sketch[i], axis=1) >= fewest]
                mine.append(np.full(len(j), i))
                others.append(j)
        a, b = [], []
        mine, others = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (mine, others))
        for k in range(0, len(mine), 4096):
            x, y = mine[k : k + 4096], others[k : k + 4096]
            same = sketch[x] == sketch[y]
            first = same[:, : s.bands * s.rows].reshape(len(x), s.bands, s.rows).all(2).argmax(1) == band
            x, y = x[first], y[first]
            near = estimate(sketch[x], sketch[y], n[x], n[y], s.base) >= np.minimum(least, np.minimum(n[x] / n[y], n[y] / n[x]))
            for i, j in zip(x[near].tolist(), y[near].tolist()):
                if _similar_by_sample(samples[i], samples[j], max(level[i], level[j]), s):
                    a.append(min(classes[i], classes[j]))
                    b.append(max(classes[i], classes[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def cells(last: bool):
            """Whole cells of what is held; the last one may go on in the next batch."""
            rows = pa.concat_tables(held)
            held.clear()
            bucket, cell = np.array(rows["bucket"].combine_chunks()), np.array(rows["cell"].combine_chunks())
            edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
            edges = np.concatenate([[0], edges, [len(bucket)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi == len(bucket) and not last:
                    held.append(rows.slice(lo))
                elif hi - lo > 1:
                    yield pairs_of(rows.slice(lo, hi - lo))

        for batch in batches:
            if len(batch):
                held.append(pa.Table.from_batches([batch]))
                for a, b in cells(False):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held:
            for a, b in cells(True):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _cells(members, s).select("bucket", "cell", "band", "block", "class", "n", "label", "sketch", "level", "sample").repartition(n, "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of `docs`.

    component_id is the least doc_id reachable over links, itself included; kept is whether it is the row's own. Null
    and empty texts, and texts of separators alone, have empty sets and are linked with nothing. Null ids are never a
    component's id unless it has no other: then component_id is null and kept false. Rows that repeat an id are documents
    each. An empty table gives no rows.
    """
    s, seed = settings or Settings(), secrets.randbits(120)
    rows = stored(sketched(docs, s, doc_id, text, seed), "sketches")
    real = rows.filter(F.col("high").isNotNull())
    # one row, and one text, for each class; a class is numbered when it is written, so no two share a number
    classes = stored(
        real.groupBy("high", "low")
        .agg(F.min(F.struct("text_key", "doc_id")).alias("first"), F.min("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    width = 2 * s.rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sketch, {i * width + 1}, {width})")) for i in range(s.bands)])
    members = classes.select(F.posexplode(bands).alias("band", "bucket"), "class", F.col("n_shingles").alias("n"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class").alias("leader"), F.min_by("n", "class").alias("leader_n")).filter("size > 1").drop("size")
    members = stored(_attached(members, "bucket", "class", shared, s).select("bucket", "band", "class", "n", "leader", "leader_n"), "buckets")
    alike = lambda x, y: 100 * F.least(x, y) >= s.percent * F.greatest(x, y)  # noqa: E731  no pair beyond it can be linked
    active = members.select("class").distinct()
    wanted = classes.join(active, "class", "left_semi").select("class", F.col("first.text_key").alias("k"), F.col("first.doc_id").alias("d"))
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"), F.col(f"`{text}`").alias("text"))
    texts = stored(named.join(wanted, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("class", "text").dropDuplicates(["class"]), "class_texts")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "pairs")
        return stored(_verified(stored(_estimated(pairs, classes, s), "candidates"), texts, s, seed), "links")

    first = members.filter((F.col("class") != F.col("leader")) & alike(F.col("n"), F.col("leader_n"))).select(F.col("leader").alias("a"), F.col("class").alias("b"))
    found = links(first)
    labels = stored(components(found), "labels")

    def mixed_buckets(own: DataFrame) -> DataFrame:
        return own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")

    def labelled() -> DataFrame:
        """Members of the buckets that more than one component shares."""
        own = members.join(labels.withColumnRenamed("node", "class"), "class", "left").select("bucket", "band", "class", "n", F.coalesce("label", "class").alias("label"))
        return stored(_attached(own, "bucket", "class", mixed_buckets(own), s), "mixed")

    # another leader, at random, for what the first did not link
    left = labelled()
    other = left.groupBy("bucket").agg(F.min_by(F.struct("class", "n", "label"), F.xxhash64("bucket", "class")).alias("o"))
    second = _attached(left, "bucket", "class", other, s).filter((F.col("label") != F.col("o.label")) & alike(F.col("n"), F.col("o.n")))
    found = found.union(links(second.select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b"))))
    labels = stored(components(found), "labels")
    # every two members of a bucket that are still apart
    left = labelled()
    samples = _samples(texts.join(left.select("class").distinct(), "class", "left_semi"), s, seed)
    signs = stored(samples.join(classes.select("class", "sketch"), "class"), "samples")
    found = found.union(stored(_verified(stored(_apart(left.join(signs, "class"), s), "candidates"), texts, s, seed), "links"))
    labels = components(found)

    least = classes.select("class", "least").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    ids = least.groupBy("label").agg(F.min("least").alias("component_id"))
    named_classes = _attached(least, "label", "class", ids, s).select("class", "component_id").join(classes.select("class", "high", "low"), "class").drop("class")
    out = _attached(rows.filter(F.col("high").isNotNull()).select("doc_id", "n_shingles", "high", "low", "text_key"), ["high", "low"], "doc_id", named_classes, s)
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(rows.filter(F.col("high").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    component = F.col("component_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM w
), sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
items AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sized
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least ON node = doc_id
"""
