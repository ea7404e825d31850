"""Code parsing, transcripts, recall and logs, against what is written out here."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import traces as X
from skein.operators import catalogs as C
from skein.operators import code as K
from skein.operators import retrieval as Q
from skein.operators.relational import ranks_per_key

RUST = '''use std::{io::{self, Read as R}, fmt};
/// Says hello.
pub fn greet(name: &str) -> Greeting { // not_a_call()
    format!("call(me) {name}"); helper::<u8>(name)
}
pub struct User { pub id: u64 }
impl<T: Clone> Show for User where T: Copy {
    fn show(&self) -> u64 { User::make(1).len(); self.log.write("x{") }
}
pub trait Show: Base + Send { fn show(&self) -> u64; }
mod inner { const TOPIC: &str = "t"; }
'''
PYTHON = '''import os, sys as s
from a.b import (c, d as e)
NAME = "top"
@on_event("made")
async def run(x):
    """Runs."""
    def nested(): return e(x)
    return bus.publish(f"dyn{x}")
class Box(Base, metaclass=M):
    KEY = 'box'
    def put(self): emit(Box.KEY, self.put)
'''
SCRIPT = '''import def, { a, b as bb } from 'm';
import * as ns from "n";
import 'side';
const EVENTS = { MADE: "made", GONE: 'gone' };
export class X extends Y implements I1, I2 {
  @OnEvent('order') handle(e: Order): void { if (x) { ns.call(e); } }
}
interface I extends A<B>, C { f(): void }
function setup() { bus.on(EVENTS.MADE, handler); bus.emit(`x${1}`); bus.once("ping", () => go2()); }
'''
GO = 'package m\nimport (\n  "fmt"\n  x "a/b"\n  _ "c"\n)\nfunc (t *T) Run() { fmt.Println(1) }\n'


def rows(path, text, tag):
    return [r[2:5] for r in K.parsed_file(path, text) if r[1] == tag]


def test_rust():
    assert [(a, k) for a, _, k in rows("m.rs", RUST, "symbol")] == [("m::greet", "Function"), ("m::User", "Type"), ("m::User", "Type"), ("m::User::show", "Function"), ("m::Show", "Trait"), ("m::show", "Function"), ("m::inner", "Module"), ("m::TOPIC", "Binding")]
    assert [x[:2] for x in rows("m.rs", RUST, "alias")] == [("io", "std::io"), ("R", "std::io::Read"), ("fmt", "std::fmt")]
    assert [x[:2] for x in rows("m.rs", RUST, "call")] == [("m::greet", "format"), ("m::greet", "helper"), ("m::User::show", "User::make"), ("m::User::show", "len"), ("m::User::show", "log::write")]
    assert [x[:2] for x in rows("m.rs", RUST, "extend")] == [("m::User", "Show"), ("m::Show", "Base"), ("m::Show", "Send")]
    assert ("m::greet", "Greeting", None) in rows("m.rs", RUST, "reference")
    assert rows("m.rs", RUST, "const") == [("TOPIC", "t", None)]


def test_python():
    assert [(a, k) for a, _, k in rows("m.py", PYTHON, "symbol")] == [("m::run", "Function"), ("m::Box", "Type"), ("m::Box::put", "Function")]  # nested ones aren't chunks
    assert [x[:2] for x in rows("m.py", PYTHON, "alias")] == [("os", "os"), ("s", "sys"), ("c", "a.b::c"), ("e", "a.b::d")]
    assert ("m::nested", "e", None) in rows("m.py", PYTHON, "call")
    assert rows("m.py", PYTHON, "event") == [("m::run", "made", "subscribe"), ("m::Box::put", "Box.KEY", "emit?")]
    assert rows("m.py", PYTHON, "const") == [("NAME", "top", None), ("Box.KEY", "box", None)]
    assert [x[1] for x in rows("m.py", PYTHON, "extend")] == ["Base"]
    assert [r[1:] for r in K.parsed_file("m.py", "def broken(")] == [("chunk", "", None, None, 1, 1, "def broken(")]


def test_scripts_and_go():
    assert [(a, k) for a, _, k in rows("m.ts", SCRIPT, "symbol")] == [("m::X", "Type"), ("m::X::handle", "Function"), ("m::I", "Trait"), ("m::setup", "Function")]
    assert [x[:2] for x in rows("m.ts", SCRIPT, "alias")] == [("def", "m::default"), ("a", "m::a"), ("bb", "m::b"), ("ns", "n")]
    assert [x[1] for x in rows("m.ts", SCRIPT, "extend")] == ["Y", "I1", "I2", "A", "C"]
    assert rows("m.ts", SCRIPT, "event") == [("m::X::handle", "order", "subscribe"), ("m::setup", "EVENTS.MADE", "subscribe?"), ("m::setup", "ping", "subscribe")]
    assert [x[:2] for x in rows("m.go", GO, "alias")] == [("fmt", "fmt"), ("x", "a/b")] and rows("m.go", GO, "call") == [("m::Run", "fmt::Println", None)]
    assert K.parsed_file("notes.txt", "x") == []


def test_edges_and_odd_files(spark):
    files = spark.createDataFrame([("m.ts", SCRIPT), ("m.py", PYTHON), ("e.rs", None), (None, "x"), ("z.rs", "")], "path string, content string")
    found = K.parse_code(files)
    edges = {tuple(r) for r in K.code_edges(found).collect()}
    assert {("event::bus::made", "handler", "subscribes"), ("m::Box::put", "event::*::box", "emits"), ("m::setup", "bus::on", "calls"), ("m::X::handle", "ns::call", "calls"), ("m", "m::b", "imports"), ("m::X", "Y", "extends")} <= edges
    assert found.filter("path IN ('e.rs', 'z.rs')").count() == 2
    assert K.parse_code(files.filter("false")).collect() == []


def test_docstrings():
    assert K.docstring("a.rs", "#[x]\n/// One.\n///  Two\nfn f() {}") == "One.\nTwo"
    assert K.docstring("a.py", '@d\ndef f():\n    """\n    One\n    Two"""\n    x') == "    One\n    Two"
    assert K.docstring("a.py", "def f():\n    '''One.'''") == "One." and K.docstring("a.py", "def f():\n    x") is None
    assert K.docstring("a.ts", "/** One\n * Two\n */\nf()") == "One\nTwo" or K.docstring("a.ts", "/** One\n * Two\n */\nf()").split() == ["One", "Two"]
    assert K.docstring("a.go", "\n// One\n// Two\nfunc f() {}") == "One\nTwo" and K.docstring("a.txt", "// x") is None


def test_transcripts_of_both_formats(spark):
    say = lambda role, text: json.dumps({"type": role, "message": {"content": text}})
    use = json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "I look."}, {"type": "tool_use", "id": "t1", "name": "Grep", "input": {"pattern": "x", "path": "src"}}]}})
    result = json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "\n".join(f"hit {i}" for i in range(25))}]}})
    first = ["{broken", say("user", "Hi <system-reminder>no</system-reminder>there"), use, result, say("assistant", "Done."), say("system", "x"), say("user", "CURRENT TIME: 5"), result]
    item = lambda p: json.dumps({"type": "response_item", "payload": p})
    message = lambda role, text: item({"type": "message", "role": role, "content": [{"type": "input_text" if role == "user" else "output_text", "text": text}]})
    second = [item({"type": "function_call", "name": "early", "arguments": ""}), message("user", "<environment_context>x"), message("user", "Go"), message("assistant", "Yes"), item({"type": "function_call", "name": "ls", "arguments": "a" * 200}), item({"type": "function_call_output", "output": "o" * 300}), message("developer", "no")]
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(first)] + [("b", i, x) for i, x in enumerate(second)], "session_id string, line_no long, line string").repartition(3)
    got = {(r.session_id, r.turn): (r.role, r.text) for r in X.transcript_turns(lines).collect()}
    hits = "\n".join(f"→ hit {i}" for i in range(20)) + "\n→ ... [5 more matches]"
    assert got[("a", 1)] == ("user", "Hi there")
    assert got[("a", 2)] == ("assistant", f"I look.\n[Grep] x in src\n{hits}\nDone.\n{hits}")
    assert got[("b", 1)] == ("user", "Go") and got[("b", 2)] == ("assistant", f"Yes\n🔧 ls({'a' * 160})\n  → {'o' * 200}") and len(got) == 4


def test_recall_finds_the_gold_answers(spark):
    """Ten questions over facts, lessons and code: four of five have their answer among the first five."""
    facts = ["Tokens are rotated every night by the cron job", "The billing service talks to the ledger over gRPC", "Feature flags live in the config table", "Backups are kept for thirty days", "The search index is rebuilt weekly", "Uploads are scanned for viruses", "Sessions expire after an hour", "Logs are shipped to the archive bucket"]
    lessons = ["when migrating the schema / take a backup first", "before releasing / run the smoke tests", "when the queue stalls / restart the consumer", "after a rollback / clear the cache", "when adding an index / do it concurrently"]
    code = {"auth.py": ("auth::verify_token", "def verify_token(jwt): check the signature of the jwt"), "users.py": ("users::fetch_users", "def fetch_users(limit): page through the users table"), "mail.py": ("mail::send_mail", "def send_mail(to): queue a message for delivery")}
    gold = [("how often are tokens rotated", "rotated"), ("billing ledger protocol", "gRPC"), ("where do feature flags live", "config table"), ("how long are backups kept", "thirty"), ("when is the search index rebuilt", "weekly"), ("migrating the schema", "backup first"), ("queue stalls", "restart"), ("rollback cache", "clear"), ("verify jwt signature", "verify_token"), ("fetch users page", "fetch_users")]
    nodes = spark.createDataFrame([(s, p) for p, (s, _) in code.items()], "id string, path string")
    edges = spark.createDataFrame([("auth::verify_token", "users::fetch_users")], "src string, dst string")
    chunks = spark.createDataFrame([(f"{p}:1-1", p, s, x) for p, (s, x) in code.items()], "id string, path string, symbol string, text string")
    table = lambda xs: spark.createDataFrame([(i, x, x, "") for i, x in enumerate(xs)], "n long, key string, text string, tags string")
    f, le = table(facts), table(lessons)
    said = {r.id: x for d, p, xs in ((f, "memory.md", facts), (le, "lessons.md", lessons)) for r, x in zip(Q.grep_stage(d, [""], ["text"], "x", p).orderBy("at").collect(), xs)} | {f"{p}:1-1": x for p, (_, x) in code.items()} | {s: s for s, _ in code.values()}
    found = 0
    for question, answer in gold:
        hits = Q.recall(question, nodes, edges, chunks, f, le, f.limit(0), k=5).collect()
        found += any(answer in said[h.id] for h in hits)
    assert found >= 8
    assert Q.recall("zzz qqq", nodes, edges, chunks, f, le, f.limit(0)).collect() == []


def test_ranks_without_one_task(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", 5), ("b", 1), ("a", 7), ("a", 5), ("b", 0)] * 40)]
    got = ranks_per_key(spark.createDataFrame(rows, "k string, v int, i int"), "k", [C.c("v").desc(), C.c("i")]).collect()
    for key in "ab":
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [r.i for r in sorted((r for r in got if r.k == key), key=lambda r: r.rank)] == [r[2] for r in want]


def test_a_log_is_emptied_when_it_is_full(spark, tmp_path):
    rows = spark.createDataFrame([("x" * 100,)], "line string")
    where = f"file://{tmp_path}/log"
    assert [C.rotating_append(where, rows, 250) for _ in range(4)] == [False, False, False, True] and spark.read.json(where).count() == 1


def test_files_of_one_split_are_parsed_by_many_tasks_in_batches(spark):
    """Each file once took a core's time in the table's own split, went back as a batch of its own, and was parsed anew for each join."""
    files = spark.range(0, 600, 1, 1).select(F.concat(F.lit("p"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("def f"), "id", F.lit("():\n    g()\n")).alias("content"))
    found = K.parse_code(files)
    used = found.filter("tag = 'chunk'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 4 and found.filter("tag = 'chunk'").count() == 600
    assert K.code_edges(found)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0


@pytest.mark.parametrize("text, name", [("impl Ab for Abc {", "Abc"), ("x$a b(a)", "a"), ("fn ab(a: ab) ab<", "ab"), ("$f f", "$f"), ("é1 1", "1"), ("none", "x")])
def test_words_without_a_pattern_for_each(text, name):
    import re

    m = re.search(rf"\b{re.escape(name)}\b", text)
    assert K._word(text, name) == (m.start() if m else None)
    m = re.search(rf"(?<![\w$]){re.escape(name)}\s*[<(]", text)
    assert K._headed(text, K.Definition(0, len(text), "", name, "")) == (m.start() if m else None)
