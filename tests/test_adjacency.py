"""Walks over an adjacency that is written once, against the same walks over plain edges."""

import shutil

from pyspark.sql import functions as F

from skein.operators import adjacency as A
from skein.operators import graph as G
from tests.test_whole_graph import small  # noqa: F401
from skein.plans.surrogates import Tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def chain(spark, n=60, hub=900):
    """A line of ids, each also called by its second next, and a hub that calls a third of all; rows repeat, and some have no end."""
    line = [(f"n{i}", f"n{i + 1}", "calls") for i in range(n)] + [(f"n{i + 2}", f"n{i}", "extends") for i in range(n)]
    own = line + line[:20] + [("hub", f"h{i}", "calls") for i in range(hub)] + [(None, "n1", "calls"), ("n1", None, "calls")]
    return spark.createDataFrame(own, "src string, dst string, kind string")


def test_walks_equal_those_over_edges(spark):
    edges = chain(spark)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).dropna().distinct()
    adj = A.Adjacency.build(edges, per_bucket=50)
    assert adj.parts[0][2] > 10
    starts = spark.createDataFrame([("a", "n3"), ("a", "n9"), ("b", "hub"), ("c", "nowhere")], "root string, id string")
    for direction, kinds in (("out", ["calls"]), ("in", None), ("both", ["calls", "extends"])):
        assert rows(G.bfs(adj, nodes, starts, 4, direction, kinds)) == rows(G.bfs(edges, nodes, starts, 4, direction, kinds))
    short = lambda e: rows(G.shortest_paths(e, starts.filter("root = 'b' OR id = 'n3'"), 3).select("root", "id", F.array_join("path", ">")))
    assert short(adj) == short(edges)
    one, two = G.subgraph(adj, nodes, starts, 3, 20, "both"), G.subgraph(edges, nodes, starts, 3, 20, "both")
    assert rows(one[0]) == rows(two[0]) and rows(one[1]) == rows(two[1].dropna()) and one[2] == two[2]


def test_a_layer_reads_its_buckets_alone(spark):
    adj = A.Adjacency.build(chain(spark), per_bucket=50)
    near = adj.steps("out", ["calls"]).near(spark.createDataFrame([("n3",)], "id string"))
    assert rows(near) == [("n3", "n4")] * 2
    (_, table, buckets), = adj.parts
    files = {r[0] for r in table.select(F.input_file_name()).distinct().collect()}
    read = {r[0] for r in table.filter("way = 'out' AND kind = 'calls'").filter(F.col("bucket") == F.pmod(F.xxhash64(F.lit("n3")), F.lit(buckets))).select(F.input_file_name()).distinct().collect()}
    assert len(read) * 10 < len(files)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_a_large_frontier_is_shuffled(spark, monkeypatch):
    adj = A.Adjacency.build(chain(spark), per_bucket=50)
    front = spark.createDataFrame([(f"n{i}",) for i in range(60)], "id string")
    small_one = rows(adj.steps("out").near(front))
    monkeypatch.setattr(A, "SENT_BYTES", 10)
    near = adj.steps("out").near(front)
    assert rows(near) == small_one and len(small_one) > 100


def test_no_frontier_and_no_edges(spark):
    adj = A.Adjacency.build(chain(spark).limit(0))
    none, some = spark.createDataFrame([], "root string, id string"), spark.createDataFrame([("a", "n1")], "root string, id string")
    assert adj.steps().near(none) is None and rows(adj.steps().near(some)) == []
    assert rows(G.reachable(adj.steps(), some, None)) == []


def test_tables_are_walked_as_one(spark):
    edges = chain(spark).dropna()
    one, two = edges.filter("kind = 'calls'"), edges.filter("kind = 'extends'")
    adj = A.Adjacency.build(one, per_bucket=50) + A.Adjacency.build(two)
    starts = spark.createDataFrame([("a", "n3"), ("b", "hub")], "root string, id string")
    assert rows(G.reachable(adj.steps("both"), starts, 3)) == rows(G.reachable(G.directed(edges, "both"), starts, 3))


def test_a_session_writes_it_once_and_anew_where_its_folder_is_gone(spark, small):  # noqa: F811
    at = lambda: Tables(spark, small).adjacency("edges")
    one, two = at(), at()
    folder = one.parts[0][0]
    assert folder == two.parts[0][0] and rows(one.edges()) == rows(Tables(spark, small).edges)
    shutil.rmtree(folder.removeprefix("file://"))
    three = at()
    assert three.parts[0][0] != folder and rows(three.edges()) == rows(Tables(spark, small).edges)


def test_scanned_edges_give_the_walks_of_written_ones(spark):
    from skein.operators.adjacency import Scanned

    pairs = [(f"n{i}", f"n{(i * 7 + 3) % 40}", ("calls", "extends", "imports")[i % 3]) for i in range(60)] + [("n1", None, "calls"), (None, "n2", "calls"), ("n0", "n3", "calls")]
    edges = spark.createDataFrame([(a, b, k) for a, b, k in pairs + pairs], "src string, dst string, kind string")
    starts, nodes = spark.createDataFrame([("n0", "n0"), ("n5", "n5")], "root string, id string"), spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 2)], "id string")
    for way in ("out", "in", "both"):
        for kinds in (None, ["calls", "extends"]):
            want = {tuple(r) for r in G.bfs(edges, nodes, starts, 4, way, kinds).collect()}
            assert {tuple(r) for r in G.bfs(Scanned(edges), nodes, starts, 4, way, kinds).collect()} == want
            lengths = {tuple(r) for r in G.shortest_paths(edges, starts, 4, way, kinds).filter("depth > 0").select("root", "id", "depth").collect()}
            assert {tuple(r) for r in G.path_lengths(Scanned(edges), starts, 4, way, kinds).collect()} == lengths


def test_subgraph_without_a_cap(spark):
    """The query's cap of 100,000 nodes cut layers that its SQL has whole."""
    hub = spark.range(700).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit("calls").alias("kind"))
    nodes = hub.select(F.col("src").alias("id")).unionByName(spark.createDataFrame([("hub",)], "id string"))
    kept, _, cut = G.subgraph(hub, nodes, spark.createDataFrame([("hub",)], "id string"), 2, None, "in")
    assert kept.count() == 701 and not cut
