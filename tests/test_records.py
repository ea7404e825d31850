"""Markdown records, folders of files and specifications on small literal texts."""

from pyspark.sql import functions as F

from skein.operators import lines as L
from skein.operators import specs as V
from skein.sources import files, parsers


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


LESSONS = """# Lessons
### Before a push
Run all tests.

<!-- enforcement: RequireRecall( turns=3 ) -->
<!-- enforcement: Nonsense -->
<!-- suggested_enforcement: Block -->
<!-- block_message:  stop --&gt; read  -->
<!-- block_message: -->
<!-- success: 4 / failure: 1 -->
<!-- success: x / failure: 1 -->
### Bare
## End
### After
<!-- failure: 2 / success: 7 -->
line
"""


def test_lessons_read_their_hidden_lines(spark):
    got = rows(parsers.lessons(docs(spark, LESSONS, "", None, "no record"), "id", "text"))
    assert got == [
        (0, 1, "Before a push", "Run all tests.\n\n<!-- success: x / failure: 1 -->", 4, 1, "RequireRecall(turns=3)", "Block", "stop --> read"),
        (0, 2, "Bare", "", 0, 0, "Advise", None, None),
        (0, 3, "After", "line", 7, 2, "Advise", None, None),
    ]


def test_preferences(spark):
    text = "### Tabs\n\nuse tabs\n\nalways\n\ntags: a\ntags: b, ,c\n### Short\n\n### \n"
    assert rows(parsers.preferences(docs(spark, text, None, ""), "id", "text")) == [
        (0, 1, "Tabs\nuse tabs\n\nalways", "b,c"), (0, 2, "Short", ""), (0, 3, "", ""),
    ]


def test_front_matter_takes_the_last_of_one_key(spark):
    got = docs(spark, "---\na: 1\nb: 2\na: 3\n---\n", "none", None).select("id", parsers.front_value(F.col("text"), "a"))
    assert rows(got) == [(0, "3"), (1, None), (2, None)]


def test_folders_are_catalogs(spark, tmp_path):
    for path, text in (
        ("skills/one/SKILL.md", "---\nname: One\ndescription: does\n---\nbody"), ("skills/two/SKILL.md", "plain"), ("skills/two/deep/SKILL.md", "x"), ("skills/three/other.md", "x"),
        ("addons/a.md", '---\nname: react\nframeworks: ["react"]\npriority: 7\npre_invoke_gate: null\n---\n\nUse it.\n'), ("addons/b.md", "---\npriority: 1\n---\n"), ("addons/c.txt", "---\nname: x\n---\n"),
        ("sessions/feat/login/plan.json", "{}"), ("sessions/feat/login/notes/a.md", "x"), ("sessions/odd/x/plan.json", "{}"), ("sessions/fix/file.md", "x"),
        ("codex/2026/01/02/rollout-1-a.jsonl", '{"type":"session_meta","payload":{"cwd":"/home/me/my-app"}}\n{}\n'), ("codex/2026/01/02/rollout-2-b.jsonl", "{}\n"), ("codex/a/b/c/d/e/rollout-3-c.jsonl", '{"type":"session_meta","payload":{"cwd":"/x"}}'),
        ("claude/-home-me/s1.jsonl", "{}"), ("claude/-home-me/sessions/s2/conversation.jsonl", "{}"), ("claude/-home-me/sessions/s3/other.jsonl", "{}"),
        ("ws/src/a.rs", "x"), ("ws/target/b.rs", "x"), ("ws/src/build/c.rs", "x"), ("ws/builder/d.rs", "x"),
    ):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    at = lambda name: files.scan(spark, str(tmp_path / name))
    text = lambda name: at(name).withColumn("content", F.col("content").cast("string"))
    assert rows(parsers.skills(text("skills"))) == [("one", "One", "does"), ("two", "two", "")]
    assert rows(parsers.addons(text("addons")).select("name", "frameworks", "allowed_tools", "priority", "inject_position", "pre_invoke_gate", "body")) == [("react", ["react"], [], 7, "after_base", None, "Use it.")]
    assert rows(files.session_catalog(at("sessions")).select("id", "files")) == [("feat/login", ["notes", "plan.json"])]
    assert rows(files.transcript_files(at("codex"), rollouts=True).select("project", "session_id")) == [("/home/me/my/app", "rollout-1-a")]
    assert rows(files.transcript_files(at("claude")).select("project", "session_id")) == [("/home/me", "s1"), ("/home/me", "s2")]
    assert rows(files.file_index(at("ws"))) == [("builder/d.rs",), ("src/a.rs",)]


def test_specifications(spark):
    whole = "---\nspec_version: 1\nproject: p\ncomponent: x\nlanguage: rust\nstatus: draft\n---\n## Types\n```\n```\n## Interfaces\n```\n```\n## Implementations\n## Acceptance\n"
    got = rows(V.spec_findings(docs(spark, whole, None), "id", "text"))
    assert [g for g in got if g[0] == 0] == [] and (1, "error", "front_matter_missing") in got and len([g for g in got if g[0] == 1]) == 6
    front = "---\ntests_version: 1\nspec_ref: s\ncomponent: x\ncategory: %s\nsurface: %s\n---\n"
    cases = "## EDGE CASES\n| case | r |\n|---|---|\n| none | - |\n"
    got = rows(V.test_spec_findings(docs(spark, front % ("code", "internal") + "## Unit Tests\n" + cases, front % ("ops", "ui"), front % ("content", "ui"), front % ("code", "ui") + "## Integration Tests\n" + cases + "## E2E Tests\n### Test: a\n"), "id", "text"))
    assert got == [(1, "error", "section_missing:Smoke Tests"), (1, "warning", "section_empty:Edge Cases"), (2, "error", "section_missing:Deliverable Checklist"), (3, "error", "section_empty:Visual Verification")]


def test_plan_coverage(spark):
    spec = "---\nsurface: ui\n---\n## Edge Cases\n| case |\n|---|\n| Empty input |\n| None for R2 |\n## E2E Tests\n### Test: logs in\n"
    schema = "id long, spec string, tasks array<struct<id: string, name: string, type: string, edge_cases: array<string>, test_cases: array<string>, ui: boolean>>"
    plans = [
        (0, spec, [("T1", "build", "code", ["empty   INPUT given"], None, True), ("T2", "try", "e2e", ["Empty input"], ["Logs  in"], None)]),
        (1, spec, [("T1", "e2e run", None, ["Empty input"], None, False)]),
        (2, spec, None),
        (3, None, []),
        (4, "", [(None, None, None, [None], [None], None)]),
    ]
    got = rows(V.coverage_findings(spark.createDataFrame(plans, schema), "id", "spec", "tasks"))
    assert got == [
        (1, "error", "task_missing:ui"), (1, "error", "test_missing:E2E Tests:logs in"), (1, "warning", "edge_case_in_one_task:Empty input"),
        (2, "error", "edge_case_missing:Empty input"), (2, "error", "task_missing:e2e"), (2, "error", "task_missing:ui"), (2, "error", "test_missing:E2E Tests:logs in"),
    ]


def test_json_bodies(spark):
    bodies = docs(spark, '{ "b": 1, "a": [1, 2] }\n', ' [1, NaN]', " 12 ", '{"a":1}', None)
    assert [r[0] for r in bodies.orderBy("id").select(L.json_body(F.col("text"), F.array(F.lit("-s")))).collect()] == ['{"b":1,"a":[1,2]}\n', " [1, NaN]", " 12 ", '{"a":1}', None]
    assert bodies.filter("id = 0").select(L.json_body(F.col("text"), F.array(F.lit("-o")))).first()[0].startswith("{ ")


def test_specs_of_one_split_are_checked_by_many_tasks(spark):
    """Front matter was found anew for each check of each row, all in the table's own split."""
    one = spark.range(0, 400, 1, 1).select("id", F.lit("---\nspec_ref: a\nsurface: api\nsurface: ui\ncategory: code\n---\n## Unit Tests\n").alias("text"))
    got = V.test_spec_findings(one, "id", "text").withColumn("p", F.spark_partition_id())
    assert got.select("p").distinct().count() >= 4
    assert got.filter("finding = 'section_empty:Visual Verification'").count() == 400  # the last of one key counts
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1
