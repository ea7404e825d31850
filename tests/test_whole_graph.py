"""Graph queries without SQL, on tables of a few rows, against brute force."""

import pytest
from pyspark.sql import functions as F

from skein.operators.graph import _label_passing
from skein.plans.registry import QUERIES
from skein.plans.surrogates import Tables

ORDERS = [(k, 1 + k % 3) for k in (1, 2, 7, 10, 20, 33)]
#: l_orderkey, l_partkey, l_suppkey, l_linenumber; parts 50 and 100 are not defined
ITEMS = [(1, 3, 1, 1), (1, 4, 2, 2), (2, 4, 1, 1), (7, 50, 2, 1), (7, 5, 1, 2), (10, 3, 2, 1), (10, 6, 2, 2), (20, 5, 1, 1), (33, 100, 3, 3)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    for name, rows, schema in (
        ("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        ("nation", [(0, "NATION_0", 0), (1, "NATION_1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        ("customer", [(k, k % 2) for k in (1, 2, 3)], "c_custkey int, c_nationkey int"),
        ("supplier", [(k, k % 2) for k in (1, 2, 3)], "s_suppkey int, s_nationkey int"),
        ("part", [(k,) for k in (3, 4, 5, 6, 50, 100)], "p_partkey int"),
        ("orders", ORDERS, "o_orderkey int, o_custkey int"),
        ("lineitem", ITEMS, "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def edges():
    out = {(f"nation::NATION_{k}", f"region::{r}", "extends") for k, r in ((0, "ASIA"), (1, "EUROPE"))}
    out |= {(f"customer::c{k}", f"nation::NATION_{k % 2}", "declared_in") for k in (1, 2, 3)} | {(f"supplier::s{k}", f"nation::NATION_{k % 2}", "extends") for k in (1, 2, 3)}
    out |= {(f"order::o{k}", f"customer::c{c}", "references") for k, c in ORDERS}
    for o, p, s, _ in ITEMS:
        out |= {(f"order::o{o}", f"part::p{p}", "calls"), (f"supplier::s{s}", f"part::p{p}", "calls")}
        out |= {(f"part::p{p}", f"supplier::s{s}", "imports")} if p % 50 else set()
    return out


def test_whole_graph_has_all_orders_and_items(spark, small):
    t = Tables(spark, small)
    got = [tuple(r) for r in t.edges.collect()]
    assert set(got) == edges() and len(got) == len(set(got))
    assert {r.id for r in t.nodes.filter(F.col("id").startswith("order::")).collect()} == {f"order::o{k}" for k, _ in ORDERS}


def test_communities_of_the_whole_graph(spark, small):
    import pandas as pd

    own = pd.DataFrame([(a, b) for a, b, k in edges() if k in ("calls", "imports", "extends")], columns=["a", "b"])
    want = {tuple(r) for r in _label_passing(20)(own).itertuples(index=False)}
    assert {(r.id, r.label) for r in QUERIES["g08_communities"](spark, small).collect()} == want
    sizes = pd.Series([x for _, x in want]).value_counts()
    assert {(r.label, r["size"]) for r in QUERIES["a17_community_summary"](spark, small).collect()} == {(k, n) for k, n in sizes.items() if n >= 3}


def test_shortest_path_over_the_whole_graph(spark, small):
    near, front, seen = {}, ["order::o20"], {"order::o20": 0}
    for a, b, _ in edges():
        near.setdefault(a, []).append(b)
    while front:
        front = [b for a in front for b in near.get(a, []) if b not in seen and not seen.update({b: seen[a] + 1})]
    got = QUERIES["g07_shortest_path"](spark, small).collect()
    assert [r.depth for r in got] == [seen["region::ASIA"]]
    path = got[0].path.split(" > ")
    assert path[0] == "order::o20" and all((a, b) in {e[:2] for e in edges()} for a, b in zip(path, path[1:]))


def test_flows_of_all_orders(spark, small):
    calls = sorted({(f"order::o{o}", f"part::p{p}") for o, p, _, _ in ITEMS})
    got = {(r.src, r.dst, r.depth) for r in QUERIES["g09_flows"](spark, small).collect()}
    assert got == {(a, b, 1) for a, b in calls}  # parts call nothing


@pytest.mark.parametrize("seed, n, m, passes", [(1, 12, 20, 20), (2, 30, 40, 20), (3, 25, 60, 2), (4, 9, 9, 1)])
def test_communities_of_random_graphs_without_a_task_for_a_component(spark, seed, n, m, passes):
    """The loop ran in one task for each component; the same labels now come from joins."""
    import random

    import pandas as pd

    from skein.operators.graph import communities

    draw = random.Random(seed)
    pairs = [(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(m)]
    got = communities(spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string"), passes)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in _label_passing(passes)(pd.DataFrame(pairs, columns=["a", "b"])).itertuples(index=False)}


@pytest.mark.parametrize("seed, n, m, deep", [(1, 6, 14, 8), (2, 12, 25, 2), (3, 9, 30, 1)])
def test_flows_of_random_graphs_without_a_call_for_each_entry(spark, seed, n, m, deep):
    """Each entry was a group of its own in Python; a task now reads its entries in order."""
    import random

    from skein.operators.graph import flows

    draw = random.Random(seed)
    pairs = [(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(m)]
    known, roots = {f"n{i}" for i in range(n) if i % 4}, [f"n{i}" for i in range(0, n, 2)]
    got = flows(spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string"), spark.createDataFrame([(x,) for x in known], "id string"), spark.createDataFrame([(r,) for r in roots], "root string"), deep)
    assert "InPandas" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan

    def walk(root, at, depth, seen, out):
        for b in sorted({b for a, b in pairs if a == at}) if depth < deep else ():
            if b not in seen:
                seen.add(b)
                out.append((root, len(out), at, b, depth + 1))
                if b in known:
                    walk(root, b, depth + 1, seen, out)
        return out

    assert sorted(map(tuple, got.collect())) == sorted(x for r in roots for x in walk(r, r, 0, {r}, []))


def test_statements_are_dealt_over_partitions_by_their_rows(spark, monkeypatch):
    """All rows of an upsert lay in as many partitions as the session names, however many they were."""
    from skein.operators import graph as G

    monkeypatch.setattr(G, "UPSERT_ROWS", 10)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = spark.range(30 * n).selectExpr("concat('n', id) AS id", "'function' AS kind", "'p' AS path", "CAST(id AS INT) AS line")
    put = spark.range(0, 60 * n, 2).selectExpr("concat('n', id) AS id", "'s' AS path", "CAST(id AS INT) AS line", "concat('t', id) AS text")
    got = G.upsert_statements(nodes, put)
    assert "RepartitionByExpression [id" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and f", {3 * n + 1}" in plan
    rows = {r.id: (r.kind, r.text) for r in got.collect()}
    assert len(rows) == got.count() and rows == {f"n{i}": ("function", None) if i % 2 else ("stmt", f"t{i}") for i in range(60 * n) if i < 30 * n or i % 2 == 0}


def test_ranges_without_edges_inside_are_counted_once_a_pass(spark, monkeypatch):
    """Ids were counted anew after each lower neighbour that changed, some of them several times a pass, with all pairs shuffled each time."""
    import random

    import pandas as pd

    from skein.operators import graph as G

    draw, write, seen = random.Random(5), G.written, []
    monkeypatch.setattr(G, "written", lambda df, label="step": seen.append(label) or write(df, label))
    pairs = [(f"a{draw.randrange(60)}", f"b{draw.randrange(15)}") for _ in range(150)] + [(f"c{draw.randrange(4)}", f"b{draw.randrange(15)}") for _ in range(40)] + [("a1", "a1"), ("z", "z")]
    got = G.communities(spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string"), 2)
    assert seen.count("labels") == 2 * 3 and "waiting" not in seen
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in G._label_passing(2)(pd.DataFrame(pairs, columns=["a", "b"])).itertuples(index=False)}
    assert G._bands(spark.createDataFrame([(0, 2), (1, 3), (2, 4)], "a long, b long")) == [0, 2, 4]
    assert G._bands(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")) == [0]


def test_communities_where_few_labels_change(spark):
    """Only ids that hear a changed label are counted again, in ranges and in a graph that has none."""
    import random

    import pandas as pd

    from skein.operators.graph import communities

    for ends, passes in (("nn", 3), ("ab", 4)):
        draw = random.Random(7)
        pairs = [(f"{ends[0]}{draw.randrange(90)}", f"{ends[1]}{draw.randrange(90)}") for _ in range(120)]
        got = communities(spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string"), passes)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in _label_passing(passes)(pd.DataFrame(pairs, columns=["a", "b"])).itertuples(index=False)}
