import numpy as np
from pyspark.sql import functions as F

from skein.operators import vectors as V


def brute(rows, query, n, keep=lambda r: True):
    out = []
    for r in rows:
        if r[1] is not None and keep(r):
            k = min(len(r[1]), len(query))
            a, b = np.array(r[1][:k], float), np.array(query[:k], float)
            size = np.linalg.norm(a) * np.linalg.norm(b)
            out.append((round(1.0 if not k or not size else 1 - float(a @ b) / size, 6), r[0]))
    return [k for _, k in sorted(out)[:n]], [d for d, _ in sorted(out)[:n]]


def test_nearest_equals_brute_force_and_drops_rows(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.1 * rnd.normal(size=16)).tolist(), "even" if i % 2 else "odd") for i in range(3000)]
    rows += [(5000, [0.0] * 16, "odd"), (5001, [1.0, 2.0], "odd"), (5002, None, "odd"), (5003, [], "even"), (5004, rows[7][1], "even"), (5005, [2 * x for x in rows[7][1]], "even")]
    collection = V.build(spark.createDataFrame(rows, "id long, embedding array<double>, project string").repartition(3), "id")
    for query in (rows[7][1], rows[100][1], rnd.normal(size=16).tolist(), [0.0] * 16, rows[3][1][:5]):
        for name in (None, "even"):
            got = V.nearest(collection, query, 9, None if name is None else F.col("project") == name)
            best = got.rows.collect()
            keys, distances = brute(rows, query, 9, lambda r: name in (None, r[2]))
            assert np.allclose([r.distance for r in best], distances, atol=1e-6)
            if query is rows[7][1]:
                assert [r.id for r in best] == keys and got.computed < got.scoped / 2
    assert V.nearest(collection, rows[0][1], 5, F.col("project") == "none").rows.collect() == []


def test_empty_collection(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert V.nearest(V.build(empty, "id"), [1.0], 3).rows.collect() == []


def test_archive_is_capped_and_expanded(spark):
    rows = [(10 * s + k, f"s{s}", k, "p", "t", [1.0, 0.1 * k + s, 0.5], f"text {s}.{k}") for s in range(3) for k in range(6)] + [(99, "s9", 0, "other", "t", [1.0, 0.0, 0.5], "far")]
    archive = spark.createDataFrame(rows, "id long, session_id string, chunk int, project string, topic string, embedding array<double>, text string")
    got = V.archive_search(V.build(archive.drop("text"), "id"), archive, [1.0, 0.0, 0.5], 5, project="p", topic="t").orderBy("distance").collect()
    assert [r.session_id for r in got].count("s0") == 3 and all(r.session_id != "s9" for r in got)
    assert got[0].expanded == "text 0.0\n---\ntext 0.1" and got[1].expanded == "text 0.0\n---\ntext 0.1\n---\ntext 0.2"
