"""Session reports, plan constraints, symbol contexts and statements on small tables, with nulls, repeats and empty ones."""

from skein.operators import code as K
from skein.operators import sessions as N
from skein.operators.constraints import TASK_TYPE, plan_findings
from skein.operators.context import SECTIONS, symbol_context

PLAN = f"plan string, name string, workspace_dir string, budget_tokens bigint, tasks array<{TASK_TYPE}>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reports_of_sessions_with_one_file_or_both(spark):
    phases = spark.createDataFrame([(1, "fix", 10), (1, "fix", None), (1, None, 5), (1, "plan", -7), (2, "plan", 9)], "session_id int, phase string, tokens bigint")
    tasks = spark.createDataFrame([(1, "done", True), (1, "passed", None), (1, "failed", False), (1, None, None), (3, "completed", True)], "session_id int, status string, ui boolean")
    got = {r["session_id"]: r for r in N.session_reports(phases, tasks).collect()}
    assert got[1]["phases"] == {"fix": 10, "?": 5, "plan": 0} and tuple(got[1])[2:] == (15, 7, 2, 4, 2, 1, 1)
    assert tuple(got[2])[2:] == (9, 0, 0, 0, 0, 0, 0) and got[3]["phases"] == {} and tuple(got[3])[2:] == (0, 0, 0, 1, 1, 0, 1)
    assert rows(N.session_reports(phases.limit(0), tasks.limit(0))) == []


def test_logs_with_broken_lines(spark):
    lines = ['{"event": "lesson_saved"}', '{"event": "frustration"}', "broken {", None, '{"event": 7}', "[1]", '{"event": "lesson_surfaced", "triggers": ["a", 3, null, "b"]}', '{"event": "lesson_surfaced", "triggers": "x"}', '{"event": "lesson_surfaced"}']
    log = [("s", i, x) for i, x in enumerate(lines)] + [("t", 0, '{"event": "frustration"}'), ("t", 1, '{"event": "lesson_saved"}'), ("t", 2, "no"), ("u", 0, "no")]
    log += [("v", i, '{"event": "code_search"}') for i in range(4)] + [("w", i, '{"event": "code_search"}') for i in range(4)] + [("x", i, '{"event": "code_search"}') for i in range(3)]
    df = spark.createDataFrame(log, "session_id string, seq int, line string")
    assert [r for r in rows(N.stop_fold(df)) if r[0] < "v"] == [("s", True, False, 2), ("t", True, True, 0), ("u", False, False, 0)]
    assert rows(N.surfaced_triggers(df)) == [("s", 6, 0, "a"), ("s", 6, 1, "b")]
    assert rows(N.search_nudges(df, spark.createDataFrame([("w",)], "session_id string"))) == [("v", 4)]


def task(name, deps=(), **kw):
    base = {"id": name, "name": name, "complexity": "low", "budget_tokens": 10, "files": ["/w/a"], "depends_on": list(deps), "context_pointers": [], "acceptance": "make test", "test_cases": [], "edge_cases": [], "ui": False, "type": "impl"}
    return base | kw


def test_constraints_of_plans(spark):
    case = {"name": "n", "expected": " \t", "verify": None}
    own = [
        ("good", "g", "/w", 20, [task("a"), task("b", ["a"])]),
        ("bad", None, "w", 100, [task("a", ["b", "z", "z"]), task("b", ["a"]), task("c", ["c"]), task("d", ["a"], complexity="huge", budget_tokens=80_001, files=["x", "/y"], context_pointers=["", "p:1-2", "/q:3-4"], acceptance=" Works", test_cases=[case], edge_cases=None, type=None)]),
        ("none", "n", "/w", 0, []),
        ("null", "n", "/w", 5, None),
        ("bare", "n", "/w", None, [dict.fromkeys(task("a"))]),
    ]
    got = {}
    for plan, at, severity, finding in rows(plan_findings(spark.createDataFrame(own, PLAN), "plan")):
        got.setdefault(plan, set()).add((at, severity[0], finding))
    assert "good" not in got and got["none"] == {(None, "e", "tasks_empty")} and got["null"] == {(None, "e", "missing:tasks")}
    assert got["bad"] == {
        (None, "e", "missing:name"), (None, "e", "workspace_not_absolute"), (None, "w", "budget_mismatch:100:80031"), ("a", "e", "dangling:z"), *((x, "e", "cycle") for x in "abc"),
        ("d", "e", "complexity_unknown"), ("d", "w", "budget_too_large:80001"), ("d", "e", "file_not_absolute:x"), ("d", "w", "pointer_not_absolute:p:1-2"), ("d", "w", "acceptance_not_runnable"),
        ("d", "e", "test_cases[0]_missing:expected"), ("d", "e", "test_cases[0]_missing:verify"), ("d", "w", "missing:edge_cases"), ("d", "w", "missing:type"),
    }
    fields = ("id", "name", "complexity", "budget_tokens", "files", "depends_on", "context_pointers", "acceptance")
    assert got["bare"] == {(None, "e", "missing:budget_tokens"), ("?", "e", "files_empty"), *(("?", "e", f"missing:{f}") for f in fields), *(("?", "w", f"missing:{f}") for f in ("test_cases", "edge_cases", "type"))}
    assert rows(plan_findings(spark.createDataFrame([], PLAN), "plan")) == []


def test_context_against_brute_force(spark):
    ids = [f"m{i % 3}::f{i}" for i in range(12)] + ["event::bus::x", "other::f3", "solo"]
    nodes = [(x, "fn", "a.rs" if i % 2 else "b.rs", i) for i, x in enumerate(ids)] + [("lost", "fn", None, 0), (None, "fn", "a.rs", 1)]
    kinds = ("calls", "extends", "references", "emits", "subscribes", "imports", "cfg")
    ends = [*ids, "f2", "f3", "x", "bus::x", "outside::y", "f5"]
    edges = [(ends[i * 7 % len(ends)], ends[i * 5 % len(ends)], kinds[i % 7]) for i in range(120)] + [(None, "solo", "calls"), ("solo", None, "calls")]
    known = {n[0] for n in nodes if n[0]}
    owners = lambda s: {k for k in known if k == s or k.endswith("::" + s) or s.endswith("::" + k)}
    real = {e for e in edges if None not in e}
    want = set()
    for limit in (2, 32):
        want = set()
        for x in known:
            parts = x.split("::")
            short = [(w, "::".join(parts[-n:])) for w, n in ((1, 2), (2, 1)) if len(parts) > n and not owners("::".join(parts[-n:])) - {x}]
            found = {}
            for kind, (out, back) in SECTIONS.items():
                for s, d, k in real:
                    if k == kind and out and s == x and (d in known) != (kind == "imports"):
                        found.setdefault(out, {})[d] = 0
                    for w, name in [(0, x), *short]:
                        if k == kind and back and d == name and s in known and (w == 0 or s != x):
                            at = found.setdefault(back, {})
                            at[s] = min(at.get(s, 9), w)
            path = {n[0]: n[2] for n in nodes}
            found["siblings"] = {y: 0 for y in known if path[x] and path[y] == path[x] and y != x}
            for section, others in found.items():
                cut = None if section == "imports_unresolved" else limit
                want |= {(x, section, o) for o in sorted(others, key=lambda o: (others[o], o))[:cut]}
        n, e = spark.createDataFrame(nodes, "id string, kind string, path string, line int"), spark.createDataFrame(edges, "src string, dst string, kind string")
        assert rows(symbol_context(e, n, limit)) == sorted(want, key=str)
    some = spark.createDataFrame([("solo",), ("m0::f0",), ("nowhere",)], "id string")
    assert rows(symbol_context(e, n, 32, some)) == sorted([r for r in want if r[0] in ("solo", "m0::f0")], key=str)


def test_context_writes_no_table_of_edges(spark, monkeypatch):
    """A symbol that all call, by each of its three names and often; a caller without a node; names without one."""
    from skein.operators import context, graph

    callers = [f"m::c{i:04}" for i in range(400)]
    nodes = spark.createDataFrame([(x, "a.rs") for x in ("a::b::f", *callers)] + [("m::c0000", "a.rs")], "id string, path string")
    pairs = [(x, y, "calls") for x in callers for y in ("f", "b::f", "a::b::f", "nowhere")] + [("gone", "a::b::f", "calls"), ("m::c0001", "std::io", "imports"), ("m::c0001", "a::b::f", "imports")]
    edges = spark.createDataFrame(pairs * 3, "src string, dst string, kind string")
    sizes, write = [], context.written

    def counted(df, label="step"):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(context, "written", counted)
    monkeypatch.setattr(graph, "written", counted)
    for limit in (3, 128):
        got = rows(symbol_context(edges, nodes, limit))
        want = {("a::b::f", "callers", x) for x in callers[:limit]} | {(x, "callees", "a::b::f") for x in callers} | {("m::c0001", "imports_unresolved", "std::io")}
        assert [r for r in got if r[1] != "siblings"] == sorted(want, key=str)
        assert [r[2] for r in got if r[1] == "siblings" and r[0] == "m::c0000"] == ["a::b::f", *callers[1:limit]]
    assert max(sizes) < 10  # names, never rows of 4,809 edges


def test_statements_of_functions(spark):
    rust = "fn a(\n) {\n\n  // note\n  b(1);\n}"
    chunks = [("r::a", "r.rs", 3, rust), ("r::o", "r.rs", 20, "fn o() { b(2) }"), ("p::a", "p.py", 1, 'def a(x: int) -> int:\n    """Doc."""\n    # note\n    return b(x)'), ("n", "n.py", 1, None)]
    df = spark.createDataFrame(chunks, "fn string, path string, start_line int, body string")
    assert [r[:2] for r in rows(K.body_statements(df).filter("text LIKE '%b(%'"))] == [("p::a", 4), ("r::a", 7), ("r::o", 20)]
    calls = spark.createDataFrame([(f, "lib::b") for f in ("p::a", "r::a", "r::o")], "fn string, callee string")
    assert rows(K.call_bridges(K.body_statements(df), calls)) == [("p::a#s4", "lib::b"), ("r::a#s7", "lib::b"), ("r::o#s20", "lib::b")]


def test_only_what_may_loop_is_walked(spark, monkeypatch):
    """All dependencies were walked for cycles; a plan's own row now tells which of them may lie in one, unless its key comes again."""
    import random

    from pyspark.sql import functions as F

    from skein.operators import constraints as C

    draw, walked, cyclic = random.Random(4), [], C.cyclic
    monkeypatch.setattr(C, "cyclic", lambda deps: walked.append(deps.count()) or cyclic(deps))

    def found(plans):
        rows = [(k, "x", "/w", 0, [{"id": t, "depends_on": d} for t, d in tasks]) for k, tasks in plans]
        got = C.plan_findings(spark.createDataFrame(rows, f"k long, name string, workspace_dir string, budget_tokens long, tasks array<{C.TASK_TYPE}>"), "k")
        return {(r.k, r.task) for r in got.filter(F.col("finding") == "cycle").collect()}

    def want(plans):
        out = set()
        for k in {k for k, _ in plans}:
            near = {}
            for t, d in [x for key, tasks in plans if key == k for x in tasks]:
                near.setdefault(t, set()).update(d or [])
            for t in near:
                seen, todo = set(), list(near[t])
                while todo:
                    if (x := todo.pop()) not in seen:
                        seen.add(x)
                        todo += near.get(x, ())
                out |= {(k, t)} if t in seen else set()
        return out

    chains = [(k, [(f"t{i}", [f"t{i - 1}"] if i else None) for i in range(8)]) for k in range(5)]
    assert found(chains) == set() and walked == [0]
    drawn = [(k, [(f"t{i}", [f"t{draw.randrange(n)}" for _ in range(draw.randrange(3))]) for i in range(n)]) for k, n in enumerate((3, 6, 9, 12, 90))]
    assert found(drawn) == want(drawn) != set()
    split = [(1, [("a", ["b"])]), (1, [("b", ["a"])])]
    assert found(split) == {(1, "a"), (1, "b")}
