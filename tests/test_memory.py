import pytest
from pyspark.sql import functions as F

from skein.operators import memory as M

c = F.col


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_best_match_needs_a_margin(spark):
    entries = spark.createDataFrame([(1, "parser edits need tests"), (2, "parser edits need review notes"), (3, "other"), (4, "parser")], "id int, text string")
    pick = lambda q: [r.id for r in M.best_match(entries, "id", "text", q).collect()]
    assert pick("OTHER") == [3] and pick("nothing") == [] and pick("parser") == [4] and pick("parser edits") == []
    assert rows(M.replaced(entries, "id", "text", "other", "new").filter("id = 3")) == [(3, "new")]
    assert M.replaced(entries, "id", "text", "other", None).count() == 3 and M.replaced(entries, "id", "text", "parser edits", None).count() == 4


def test_rejected_appends_take_no_room(spark):
    entries = spark.createDataFrame([("f", i, s) for i, s in enumerate((40, 70, 50, 10, 1))] + [("g", 0, 101)], "file string, at int, size int")
    assert rows(M.accepted_within(entries, "file", "at", c("size"), 100)) == [("f", 0, True), ("f", 1, False), ("f", 2, True), ("f", 3, True), ("f", 4, False), ("g", 0, False)]


def test_pending_and_counters(spark):
    pending = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "at int, text string")
    moved, rest = M.promoted(pending, "at", 1)
    assert rows(moved) == [(20, "b")] and rows(rest) == [(10, "a"), (30, "c")]
    moved, rest = M.promoted(pending, "at", 9)
    assert rows(moved) == [] and rest.count() == 3
    lessons = spark.createDataFrame([(" When X", 1), ("y", 2), (None, 3)], "trigger_text string, success long")
    assert rows(M.bumped(lessons, ["when x"], "success").select("success")) == [(2,), (2,), (3,)]
    gone, kept = M.split_by_triggers(lessons, ["WHEN X", "z"])
    assert gone.count() == 1 and kept.count() == 2


def test_json_patch():
    doc = {"a": [1, 2], "b/c": {"~": 0}}
    ops = [{"op": "add", "path": "/a/1", "value": 9}, {"op": "move", "from": "/b~1c/~0", "path": "/d"}, {"op": "remove", "path": "/a/0"}, {"op": "test", "path": "/d", "value": 0}, {"op": "replace", "path": "/a/-1".replace("-1", "0"), "value": 8}]
    assert M.patched(doc, ops) == {"a": [8, 2], "b/c": {}, "d": 0} and doc == {"a": [1, 2], "b/c": {"~": 0}}
    for bad in ({"op": "remove", "path": "/x"}, {"op": "test", "path": "/a", "value": 1}, {"op": "replace", "path": "/q", "value": 1}, {"op": "add", "path": "/a/7", "value": 1}, {"op": "what", "path": "/a"}):
        with pytest.raises(ValueError):
            M.patched(doc, [bad])


def test_queries_and_statements(spark):
    long = "x" * 300
    q = spark.createDataFrame([("short",), (f"{long}\nWhat now?\nthanks",), (f"{long}. Is it so? yes",), (f"{long}! the last sentence here. no",)], "q string").select(M.sanitised_query(c("q"))).collect()
    assert [r[0] for r in q] == ["short", "What now?", "Is it so?", "the last sentence here"]
    statements = spark.createDataFrame([("f", 1, "let a = env()"), ("f", 2, "let a = g(a)"), ("f", 4, "run(a, b)"), ("g", 1, "run(a)")], "fn string, line int, text string")
    got = {(r.src, r.dst, r.kind) for r in M.statement_edges(statements).collect()}
    assert got == {("f#s1", "f#s2", "cfg"), ("f#s2", "f#s4", "cfg"), ("f#s1", "f#s2", "data_dep"), ("f#s2", "f#s4", "data_dep")}
