import collections
import random
import zlib

from pyspark.sql import functions as F

from skein.llm.queries import op2_sharding
from skein.llm.sharding import shard


def check(rows, got, shards, tolerance, bound):
    assert len(got) == len(rows)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.size == len((r.text or "").encode()) + 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= tolerance * mean + bound for s in range(shards)), sizes


def test_bytes_are_near_equal_and_groups_whole(spark):
    rnd = random.Random(3)
    rows = [(i, "é" * rnd.randint(0, 400)) for i in range(20_000)] + [(None, None), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shard(docs, shards=8, place_bytes=200_000).collect()
    check(rows, got, 8, 0.0101, 2 * 401 * 60)
    places = collections.defaultdict(set)
    for r in got:
        places[r.text].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 7  # only groups at a border that are too large may be cut


def test_a_hot_group_is_cut(spark):
    rows = [(i, "the same text") for i in range(5000)] + [(10_000 + i, f"other {i}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, shard(docs, shards=4).collect(), 4, 0.0101, 30)


def test_null_text_ties_clashes_and_empty(spark):
    rows = [(None, None, 1)] * 4 + [(1, "", 2), (1, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard(docs, shards=2)
    assert got.columns == ["doc_id", "text", "shard", "size", "_shard", "slot"] and got.count() == 6
    assert shard(docs.filter("false")).collect() == []


def test_splitters_equal_those_of_a_sort(spark):
    """Rows in order of their hashes: a shard ends within the tolerance of its share of the running bytes."""
    rnd = random.Random(5)
    rows = [(i, "x" * rnd.randint(0, 90)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = F.xxhash64(F.col("text").isNull(), F.col("text")), F.xxhash64(F.lit("second"), F.col("doc_id"))
    got = shard(docs, shards=5, place_bytes=10_000).select("shard", "size", key[0].alias("a"), key[1].alias("b")).collect()
    order = sorted(got, key=lambda r: (r.a, r.b))
    assert [r.shard for r in order] == sorted(r.shard for r in got)
    total, running = sum(r.size for r in got), 0
    for k, r in enumerate(order[:-1]):
        running += r.size
        if order[k + 1].shard != r.shard:
            assert abs(running - total * order[k + 1].shard / 5) <= 0.005 * total / 5 + 91


def test_places_do_not_change_the_shards_and_are_bounded(spark):
    rows = [(i, f"text {i % 900}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.shard for r in shard(docs, shards=4).collect()}
    for options in ({"place_bytes": 500}, {"place_bytes": 1, "most_places": 40}):
        many = shard(docs, shards=4, **options)
        assert {r.doc_id: r.shard for r in many.collect()} == one
    assert many.rdd.getNumPartitions() == 40


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "é" * 9, *[f"text {i}" for i in range(300)]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_sharding(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {r.law for r in got} == {"bytes"} and {r.shard for r in got} == set(range(8)) and {r.grown_shard for r in got} == {None}
