"""Operators of the engine on small literal tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.operators import graph as G
from skein.operators import lifecycle as L
from skein.operators import lines as N
from skein.operators import relational as R
from skein.operators import retrieval as Q
from skein.sources import files, parsers
from skein.streaming import gates

c = F.col


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a::foo",), ("a::bar",), ("b::baz",), ("a::base",)], "id string")
    edges = [("a::foo", "a::bar", "calls"), ("a::bar", "b::baz", "calls"), ("a::foo", "b::baz", "references"), ("a::foo", "external::thing", "imports"), ("external::thing", "a::base", "imports"), ("a::foo", "a::base", "extends")]
    return nodes, spark.createDataFrame(edges, "src string, dst string, kind string")


def starts(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "root string, id string")


def test_bfs_walks_through_unresolved_ids(spark, graph):
    nodes, edges = graph
    assert rows(G.bfs(edges, nodes, starts(spark, "a::foo"), 1, kinds=["calls"])) == [("a::foo", "a::bar", 1)]
    assert rows(G.bfs(edges, nodes, starts(spark, "a::foo"), 3, kinds=["imports"])) == [("a::foo", "a::base", 2)]
    assert rows(G.impact(edges, nodes, starts(spark, "b::baz"), "up", 2)) == [("b::baz", "a::bar", 1), ("b::baz", "a::foo", 1)]
    assert rows(G.impact(edges, nodes, starts(spark, "a::foo"), "both", 2)) == [("a::foo", "a::bar", 1), ("a::foo", "a::base", 1), ("a::foo", "b::baz", 1)]  # by the reference to it
    with pytest.raises(ValueError):
        G.directed(edges, "out", ["nonsense"])


def test_impact_follows_the_suffixes_of_one_owner(spark):
    nodes = spark.createDataFrame([(i,) for i in ("m::Store::open", "main", "cli::run", "x::Other::close", "y::Other::close", "cmd::go", "z::go")], "id string")
    edges = spark.createDataFrame([("main", "Store::open", "calls"), ("cli::run", "open", "calls"), ("cli::run", "main", "calls"), ("main", "Other::close", "calls"), ("cli::run", "go", "calls"), ("m::Store::open", "open", "calls")], "src string, dst string, kind string")
    assert rows(G.impact(edges, nodes, starts(spark, "m::Store::open"), "up", 3)) == [("m::Store::open", "cli::run", 2), ("m::Store::open", "main", 1)]
    assert rows(G.impact(edges, nodes, starts(spark, "x::Other::close", "cmd::go"), "up", 3)) == []  # others end alike
    assert rows(G.impact(edges, nodes, starts(spark, "m::Store::open"), "down", 3)) == []
    near = rows(G.in_neighbours(edges, nodes.withColumn("path", F.lit("f")), ["calls"]))
    assert [x[:2] for x in near if "::" in x[0] and x[0].startswith("m::")] == [("m::Store::open", "cli::run"), ("m::Store::open", "main")]
    assert not [x for x in near if x[0] in ("x::Other::close", "cmd::go")]


def test_taint_report_has_paths_counts_and_a_cap(spark):
    nodes = spark.createDataFrame([("s1", "env"), ("s2", "ENV"), ("k1", "exec"), ("k2", "exec"), ("m", None)], "id string, text string")
    edges = spark.createDataFrame([("s1", "m", "data_dep"), ("m", "k1", "calls"), ("m", "k2", "calls"), ("s2", "k2", "data_dep"), ("s2", "k1", "imports")], "src string, dst string, kind string")
    found, cut, n_sources, n_sinks = G.taint_report(edges, nodes, ["env"], ["exec"], texts=("id", "text"))
    assert rows(found) == [("s1", "k1", 2, ["s1", "m", "k1"]), ("s1", "k2", 2, ["s1", "m", "k2"]), ("s2", "k2", 1, ["s2", "k2"])] and (cut, n_sources, n_sinks) == (False, 2, 2)
    found, cut, *_ = G.taint_report(edges, nodes, ["env"], ["exec"], max_findings=2, texts=("text",))
    assert [r[1] for r in rows(found)] == ["k1", "k2"] and cut
    assert rows(G.taint_report(edges, nodes.limit(0), ["env"], ["exec"])[0]) == []


def test_statements_take_the_place_of_nodes(spark):
    nodes = spark.createDataFrame([("a", "function", "f", 1), ("b", "type", "f", 2)], "id string, kind string, path string, line int")
    new = spark.createDataFrame([("b", "g", 3, "x = 1"), ("b", "g", 3, "x = 1"), ("c", None, None, None)], "id string, path string, line int, text string")
    assert rows(G.upsert_statements(nodes, new)) == [("a", "function", "f", 1, None), ("b", "stmt", "g", 3, "x = 1"), ("c", "stmt", None, None, None)]


def test_paths_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("x", "y", "calls"), ("y", "x", "calls"), ("a", "z", "calls"), ("z", "c", "calls")], "src string, dst string, kind string")
    got = {r.id: (r.depth, r.path) for r in G.shortest_paths(edges, starts(spark, "a")).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "z": (1, ["a", "z"]), "c": (2, ["a", "b", "c"])}
    nodes = spark.createDataFrame([(i,) for i in "abcxyz"], "id string")
    assert rows(G.bfs(edges, nodes, starts(spark, "x"), 9)) == [("x", "y", 1)]


def test_subgraph_stops_at_its_cap(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls") for i in range(9)], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(10)], "id string")
    kept, among, cut = G.subgraph(chain, nodes, starts(spark, "n0"), 9, 3)
    assert rows(kept) == [("n0", 0), ("n1", 1), ("n2", 2)] and cut
    assert rows(among) == [("n0", "n1", "calls"), ("n1", "n2", "calls")]


def test_communities_of_two_triangles(spark):
    pairs = [(f"a::f{i}", f"a::f{j}") for i, j in ((1, 2), (2, 3), (3, 1))] + [(f"b::g{i}", f"b::g{j}") for i, j in ((1, 2), (2, 3), (3, 1))]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs] + [("a::f1", "b::g1", "references")], "src string, dst string, kind string")
    assert {(r.name, r.size) for r in G.community_summary(G.communities(edges)).collect()} == {("a", 3), ("b", 3)}


def test_flows_go_depth_first(spark):
    edges = spark.createDataFrame([("m", "b", "calls"), ("m", "a", "calls"), ("a", "c", "calls"), ("c", "m", "calls"), ("b", "gone", "calls"), ("gone", "z", "calls")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(i,) for i in "mabcz"], "id string")
    got = [(r.src, r.dst, r.depth) for r in G.flows(edges, nodes, spark.createDataFrame([("m",)], "root string")).orderBy("step").collect()]
    assert got == [("m", "a", 1), ("a", "c", 2), ("m", "b", 1), ("b", "gone", 2)]


def test_taint_and_waves(spark):
    nodes = spark.createDataFrame([("h#s3", "let x = env::var()"), ("h#s4", "Command::new(x)"), ("k", "other")], "id string, text string")
    edges = spark.createDataFrame([("h#s3", "h#s4", "data_dep"), ("h#s3", "k", "cfg")], "src string, dst string, kind string")
    assert rows(G.taint(edges, nodes, ["ENV::VAR"], ["command::new", "other"], texts=("text",))) == [("h#s3", "h#s4", 1)]
    tasks = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    deps = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "id long, dep long")
    assert {r.id: r.wave for r in G.waves(tasks, deps).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: None, 6: None, 7: None}


def test_resolve(spark):
    nodes = spark.createDataFrame([("a::X::run",), ("b::run",), ("b::only",), ("main",)], "id string")
    asked = spark.createDataFrame([("run",), ("only",), ("X::run",), ("main",), ("deep::b::only",), ("none",)], "needle string")
    assert {r.needle: r.id for r in G.resolve(nodes, asked).collect()} == {"run": None, "only": "b::only", "X::run": "a::X::run", "main": "main", "deep::b::only": "b::only"}


def test_text_and_scores(spark):
    lit = F.lit
    assert one(spark, X.content_policy(lit("Session 2025-04-01 shipped x"))) == "session_handoff"
    assert one(spark, X.content_policy(lit("abc1234"))) == "commit_sha_only" and one(spark, X.content_policy(lit("12345678"))) is None
    assert one(spark, X.content_policy(lit("src/a.rs"))) == "path_only" and one(spark, X.content_policy(lit("always src/a.rs"))) is None
    assert one(spark, X.jaccard(X.similarity_tokens(lit("When editing the parser")), X.similarity_tokens(lit("editing parser 123")))) == 1.0
    assert one(spark, X.jaccard(X.similarity_tokens(lit("")), X.similarity_tokens(lit("x")))) == 0.0
    assert one(spark, X.without_ansi(lit("\x1b[1mbold\x1b[0m\x1b["))) == "bold\x1b["
    assert one(spark, X.preview(lit(" 1a1 \n\n 2b \n3\n4"))) == "1a1 ⏎ 2b ⏎ 3"
    assert one(spark, X.same_file(lit("./src/a.rs"), lit("/home/x/src/a.rs"))) and not one(spark, X.same_file(lit("a.rs"), lit("x/a.rs")))
    assert [one(spark, S.duration_seconds(lit(x))) for x in ("2d", "3h", "4m", "5s")] == [172800, 10800, 240, None]
    assert one(spark, S.elapsed(lit(67))) == "1m07s" and one(spark, S.elapsed(lit(42))) == "42s"
    assert one(spark, S.osa_at_most(lit("widget"), lit("widgte"), 1)) and not one(spark, S.osa_at_most(lit("widget"), lit("wdigte"), 1))
    assert one(spark, S.cosine_distance(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0)))) == 1.0
    assert one(spark, X.glob_at_ends(lit("x"), "*"))


def test_relational(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, at int")
    changes = spark.createDataFrame([(2, "c", 1, 5), (2, "d", 2, 6), (3, "e", 3, 7)], "id int, v string, at int, seq int")
    assert rows(R.upsert(table, changes, ["id"], "seq")) == [(1, "a", 10), (2, "d", 2), (3, "e", 3)]
    assert rows(R.upsert_keeping(table, changes.filter("seq <> 5").drop("seq"), ["id"], ["at"])) == [(1, "a", 10), (2, "d", 20), (3, "e", 3)]
    spans = spark.createDataFrame([("p", 1, 200), ("p", 300, 301), ("q", 1, 9)], "path string, start_line int, end_line int")
    ranges = spark.createDataFrame([("p", 60, 130), ("p", 200, 300), ("q", 10, 12)], "path string, a int, b int")
    assert rows(R.overlapping(spans, ranges).select("path", "start_line", "a")) == [("p", 1, 200), ("p", 1, 60), ("p", 300, 200)]
    big = spark.range(250_000).withColumnRenamed("id", "k")
    assert R.newest(big, "k", 200_000).agg(F.min("k"), F.count("*")).first() == (50_000, 200_000)
    assert R.newest(big, "k", 7).count() == 7 and R.newest(big, "k", 0).count() == 0
    uses = spark.createDataFrame([("f", "x", 1, True), ("f", "x", 2, False), ("f", "x", 2, True), ("f", "x", 5, False)], "fn string, name string, line int, is_def boolean")
    assert [r.def_line for r in R.last_definition(uses, ["fn", "name"], "line", "is_def").orderBy("line", "is_def").collect()] == [None, 1, 1, 2]


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [])], "id int, embedding array<float>")
    assert [r.id for r in Q.nearest(vectors, [1.0, 0.0], 2).collect()] == [1, 3]
    assert [r.distance for r in Q.nearest(vectors, [], 2).collect()] == [0.0, 0.0]
    docs = spark.createDataFrame([("a", "verify the jwt token"), ("b", "fetch users"), ("c", "token token users")], "id string, text string")
    got = Q.bm25(docs, ["verify", "token"], "id", "text").orderBy(c("score").desc()).collect()
    assert [r.id for r in got] == ["a", "c"]
    low = spark.createDataFrame([("x", 0.0476)], "id string, score double")
    assert Q.above_floor(low).count() == 0
    meta = spark.createDataFrame([(1, "x"), (2, None)], "n int, k string")
    keep = lambda spec: [r.n for r in meta.filter(Q.metadata_filter(spec, c)).orderBy("n").collect()]
    assert keep({}) == [1, 2] and keep({"k": "x"}) == [1] and keep({"k": {"$ne": "x"}}) == [2] and keep({"$or": [{"n": 2}, {"k": {"$in": ["x"]}}]}) == [1, 2]
    assert keep({"n": {"$gt": 1, "$lt": 5}}) == [] and keep({"k": {"$in": []}}) == []


def test_lifecycle(spark):
    lessons = spark.createDataFrame([("keep", 4, 1), ("drop", 0, 5), ("young", 0, 1)], "trigger_text string, success long, failure long")
    assert rows(L.keep_lessons(lessons).select("trigger_text")) == [("keep",), ("young",)] and rows(L.quarantined(lessons).select("trigger_text")) == [("drop",)]
    usage = spark.createDataFrame([(i, "low", 100, int(100 * r)) for i, r in enumerate((1.0, 1.2, 1.4))] + [(9, "high", 100, 9000)], "seq long, complexity string, estimated long, actual long")
    assert rows(L.calibration(usage)) == [("high", 3.0, 1), ("low", 1.2, 3)]
    assert {r.complexity: r.n for r in L.usage_summary(usage).collect()} == {"low": 3, "medium": 0, "high": 1}
    rules = [{"id": "r1", "matcher": "Bash", "conditions": [("cmd", "not_contains", "safe")], "action": "block"}, {"id": "w", "matcher": "Bash|Edit", "conditions": [], "action": "warn"}, {"id": "bad", "matcher": "Edit", "conditions": [("cmd", "regex", "(")], "action": "block"}]
    events = spark.createDataFrame([(1, "Bash", "rm"), (2, "Bash", "safe"), (3, "Bash", None), (4, "Edit", "x"), (5, "Read", "x")], "id int, tool string, cmd string")
    assert rows(L.rule_gate(events, rules, "id", "tool")) == [(1, "block", "r1"), (2, "warn", "w"), (3, "warn", "w"), (4, "warn", "w"), (5, "allow", None)]


def test_lines(spark):
    text = F.lit("a\na\n\nb\nb\nb\nc")
    body = lambda x: one(spark, F.array_join(x, ","))
    lines = N.lines_of(text)
    assert body(N.collapsed(lines)) == "a (x2),,b (x3),c"
    assert body(N.sandwich(lines, 1, 1)) == "a,… (5 lines trimmed) …,c" and body(N.tail(lines, 2)) == "b,c" and body(N.dropping(lines, "^a", "c$")) == ",b,b,b"
    r = N.Registry()
    r.register("git", None, lambda x: N.head(x, 1), priority=99)
    r.register("git", "log", lambda x: N.head(x, 2))
    assert body(r.dispatch(F.lit("git"), F.lit("log"), lines)) == "a,a" and body(r.dispatch(F.lit("git"), F.lit("diff"), lines)) == "a" and body(r.dispatch(F.lit("x"), F.lit("y"), lines)).startswith("a,a,,b")
    assert r.find("git", "log") is r.rows[1][3] and r.find("ls", None) is None


def test_files_and_parsers(spark, tmp_path):
    for name, content in {"a.rs": b"fn x() {}", "sub/b.py": b"x = 1", "sub/c.txt": b"text", "bin.dat": b"a\0b", "empty.txt": b"", ".hidden/d.rs": b"no", "target/e.rs": b"no", "keep/target/f.rs": b"yes"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    patterns = ["# comment", "", "target/", "!keep/target/", "[bad"]
    assert rows(files.source_files(spark, f"file://{tmp_path}", patterns).select("path", "language")) == [("a.rs", "rust"), ("keep/target/f.rs", "rust"), ("sub/b.py", "python")]
    assert rows(files.text_files(spark, f"file://{tmp_path}").select("path")) == [("sub/c.txt",)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2, "b": "x"}\n')
    assert rows(files.json_lines(spark, f"file://{tmp_path}/log", "a long, b string")) == [(1, None), (2, "x")]
    diff = spark.createDataFrame([(1, "--- a/f\n+++ b/f.rs\n@@ -2,1 +2,1 @@\n@@ -9 +8 @@\n@@ -4,2 +4,0 @@\n")], "id int, text string")
    assert rows(parsers.diff_hunks(diff, "id", "text")) == [(1, "f.rs", 2, 2), (1, "f.rs", 8, 8)]
    long = spark.createDataFrame([(1, "\n".join(["x"] * 250) + "\n\n  \nend")], "id int, text string")
    assert rows(parsers.text_chunks(long, ["id"], "text").select("start_line", "end_line")) == [(1, 120), (121, 240), (241, 250), (253, 253)]


def test_debounce_stream_equals_its_batch_form(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    events = [(i, base + dt.timedelta(milliseconds=90 * i), f"p{i % 3}", "deleted" if i % 5 == 0 else "changed") for i in range(60)]
    schema = "seq long, ts timestamp, path string, kind string"
    table = spark.createDataFrame(events, schema)
    for k in range(3):
        table.filter(c("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen: list[tuple] = []

    def sink(deleted, changed):
        seen.append((rows(deleted), rows(changed)))

    gates.apply_batches(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/c1").awaitTermination(120)
    got = sorted(x for d, ch in seen for x in d + ch)
    assert got == rows(gates.last_per_path(table)) and all(k == "deleted" for d, _ in seen for _, k, _ in d)


def test_cool_down_stream_equals_its_batch_form(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    events = [(i, base + dt.timedelta(seconds=25 * i), i % 2) for i in range(40)]
    schema = "seq long, ts timestamp, user_id long"
    table = spark.createDataFrame(events, schema)
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = gates.cooled_down_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user_id", 60.0)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(gates.cooled_down(table, "user_id", 60.0))


def test_json_is_read_leniently(spark):
    props = spark.createDataFrame([(json.dumps({"k": 3}),), ("{",)], "p string")
    assert rows(props.select(F.try_variant_get(F.try_parse_json("p"), "$.k", "bigint"))) == [(3,), (None,)]


def test_handlers(spark):
    from skein.operators import handlers as H

    big = "".join(f"line {i}\n" for i in range(200))
    status = 'On branch main\n  (use "git add <file>..." to update)\n\nmodified:   foo.rs\n'
    ask = lambda cmd, sub, args, text, strict=False, errors=False: (cmd, sub, args, text, strict, errors)
    cases = [
        (ask("git", "log", [], "a\n\n \t\nb"), "a\nb\n"),
        (ask("git", "log", ["-n=3"], "a\n\nb"), "a\n\nb"),
        (ask("git", "log", [], big), "".join(f"line {i}\n" for i in range(40))),
        (ask("git", "log", [], big, True), big),
        (ask("git", "status", [], status, True), status.replace('  (use "git add <file>..." to update)\n', "")),
        (ask("git", "status", ["--porcelain"], status), status),
        (ask("git", "blame", [], big), "".join(f"line {i}\n" for i in range(60))),
        (ask("git", "blame", [], big, True), big),
        (ask("git", "push", [], big), big),
        (ask("git", "show", [], "x"), "x\n"),
        (ask("cargo", "build", [], "   Compiling a\nFinished\n\n"), "Finished\n"),
        (ask("cargo", "build", [], "Documenting a\nwarning: x", errors=True), "warning: x\n"),
        (ask("cargo", "doc", [], "Documenting a\n"), "Documenting a\n"),
        (ask("npm", None, [], "added 3 packages\nnpm notice\nnpm fund\n⠹ x\n[## ] 4%\nProgress: resolved 3\n\nup to date\n"), "added 3 packages\nup to date\n"),
        (ask("pip3", None, [], "Collecting x\n  Using cached y\nERROR: z\n"), "ERROR: z\n"),
        (ask("pip", None, ["-q"], "Collecting x\n"), "Collecting x\n"),
        (ask("rg", None, [], "a\na\nb"), "a (x2)\nb\n"),
        (ask("rg", None, [], "a\na\nb", True), "a\nb\n"),
        (ask("rg", None, [], "a\nb"), "a\nb"),
        (ask("grep", None, [], "a\na", errors=True), "a\na"),
        (ask("ls", None, [], big), big),
        (ask("ls", None, [], big + "z"), "".join(f"line {i}\n" for i in range(80)) + "… (81 lines trimmed) …\n" + "".join(f"line {i}\n" for i in range(161, 200)) + "z\n"),
        (ask("cat", None, [], "x\n" * 501), "x\n" * 500 + "… (1 more lines — use Read tool for full) …\n"),
        (ask("curl", None, [], '{ "a": 1 }'), '{"a":1}'),
        (ask("make", None, [], "\n\n"), "\n\n"),
        (ask("git", "log", [], ""), ""),
        (ask("git", "log", [], None), None),
    ]
    rows = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(cases)], "i int, cmd string, sub string, args array<string>, text string, strict boolean, errors boolean")
    cols = [F.col(x) for x in ("cmd", "sub", "args", "text", "strict")]
    got = {}
    for errors in (False, True):
        got |= {r.i: r.out for r in rows.filter(F.col("errors") == errors).select("i", H.handled(*cols, errors=errors).alias("out")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_running_folds_of_a_hot_key(spark):
    import random

    rnd = random.Random(6)
    data = [("hot" if i % 10 else None, i, rnd.choice([None, 1, 2, 5]), rnd.randint(0, 9)) for i in range(500)] + [("one", 1, 3, 4)]
    got = R.running(spark.createDataFrame(data, "k string, at long, v long, m long").repartition(7), ["k"], [F.col("at")], total=("sum", F.col("v")), top=("max", F.col("m")))
    want, state = set(), {}
    for k, at, v, m in sorted(data, key=lambda r: (str(r[0]), r[1])):
        total, top = state.get(k, (0, -1))
        state[k] = (total + (v or 0), max(top, m))
        want.add((k, at, v, m, *state[k]))
    assert {tuple(r) for r in got.collect()} == want
    assert R.running(spark.createDataFrame([], "k string, at long"), ["k"], [F.col("at")], n=("sum", F.lit(1))).collect() == []
    values = [("a", i % 37) for i in range(200)] + [("b", 5)]
    found = {r.k: (r.p0, r.p50, r.p95, r.p100) for r in R.nearest_rank(spark.createDataFrame(values, "k string, v long"), ["k"], "v", [0, 50, 95, 100]).collect()}
    ordered = sorted(v for k, v in values if k == "a")
    assert found == {"a": tuple(ordered[int((199 * p) / 100 + 0.5)] for p in (0, 50, 95, 100)), "b": (5, 5, 5, 5)}


def test_only_bodies_of_curl_go_to_python(spark):
    """A Python function has its arguments for every row, whatever branch it stands in: all outputs were sent to it."""
    from skein.operators import handlers as H

    rows_ = spark.createDataFrame([("tar", '{ "a": 1 }'), ("curl", '{ "a": 1 }'), ("curl", "x"), (None, "[ ]")], "cmd string, t string")
    got = rows_.select("cmd", "t", H.handled(F.col("cmd"), F.lit(None).cast("string"), F.array(F.lit("x")), F.col("t"), F.lit(False), H.of("pip")).alias("o"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_compacted(t#" not in plan and "_compacted(CASE WHEN" in plan
    assert [r.o for r in got.collect()] == ['{ "a": 1 }', '{"a":1}', "x", "[ ]"]


def test_trim_report_of_empty_and_null_texts(spark, tmp_path):
    """An empty text was divided by its length, which failed the whole query; a null text had no report."""
    from skein.plans.registry import QUERIES

    spark.createDataFrame([(1, ""), (2, None), (3, "abc"), (4, "é" * 400)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.report for r in QUERIES["l10_trim_report"](spark, str(tmp_path)).collect()}
    assert got == {1: "before=0 after=0 saved=0%", 2: "before= after=500 saved=%", 3: "before=3 after=3 saved=0%", 4: "before=800 after=500 saved=37%"}


def test_session_costs_next_to_a_tie_are_rounded_as_in_sql(spark):
    """Costs were rounded by their decimal form, so those next to a tie differed from the SQL by the last place."""
    import duckdb

    near = [(492, 332, 6855, 1370), (371, 222, 6090, 1808), (259, 212, 2810, 6680), (301, 144, 4340, 2396)]  # input, output, cache read and cache write
    turns = spark.createDataFrame([(k, 1, "other", *n) for k, n in enumerate(near)], "session_id long, seq long, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    got = [r.actual_cost for r in L.session_costs(turns).orderBy("session_id").collect()]
    want = "SELECT round(? * (CAST(3.75 AS DOUBLE) / 1e6) + ? * (CAST(0.3 AS DOUBLE) / 1e6) + ? * (CAST(3.0 AS DOUBLE) / 1e6) + ? * (CAST(15.0 AS DOUBLE) / 1e6), 4)"
    assert got == [duckdb.execute(want, [w, r, i, o]).fetchone()[0] for i, o, r, w in near]
