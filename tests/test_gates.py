"""Batched embedding and the reconciliation of a registry."""

from skein.streaming import gates


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_embedding_goes_by_batches_and_outlives_a_failed_one(spark):
    def embed(texts):
        if len(texts) > 4 or "bad" in texts:
            raise RuntimeError(texts)
        return [[len(texts), len(t or "")] for t in texts]

    table = spark.createDataFrame([(i, "bad" if i == 5 else None if i == 9 else "x" * i, i) for i in range(10)], "id long, t string, n int").coalesce(1)
    got = {r.id: r.embedding for r in gates.embedded(table, "t", embed, 4).collect()}
    assert got == {i: None if 4 <= i < 8 else [4.0 if i < 8 else 2.0, 0.0 if i == 9 else float(i)] for i in range(10)}
    assert gates.embedded(table, "t", lambda x: [], 4).filter("embedding IS NULL").count() == 10
    assert gates.embedded(table.limit(0), "t", embed).collect() == []


def test_registry_is_reconciled_once_a_batch(spark, tmp_path):
    registry = spark.createDataFrame([("a", "/a"), ("b", "/b"), ("b", "/b")], "slug string, path string")
    bound = spark.createDataFrame([("b", "/b"), ("old", "/old"), ("orphan", None)], "slug string, source_path string")
    want = [("a", "add", "/a"), ("old", "remove", "/old")]
    assert rows(gates.reconciled(registry, bound)) == want
    assert rows(gates.reconciled(registry.limit(0), bound)) == [("b", "remove", "/b"), ("old", "remove", "/old")]
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = gates.reconcile_batches(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda: (registry, bound), lambda d: seen.append(rows(d)), f"{tmp_path}/c")
    stream.awaitTermination(120)
    assert seen == [want]
