"""Queries over markdown records, folders of files, and specifications, whose texts are written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import lines as L
from skein.operators import specs as V
from skein.plans.registry import query
from skein.sources import files, parsers

c = F.col


@query(
    "s11_markdown_lessons",
    """SELECT p_partkey AS key, CAST(1 AS INTEGER) AS number, p_name AS trigger, concat('Use ', p_type, '.', chr(10), '<!-- other: x -->') AS advice, CAST(p_size AS BIGINT) AS success, CAST(p_partkey AS BIGINT) AS failure,
    CASE p_size % 3 WHEN 0 THEN 'Block' WHEN 1 THEN concat('RequireRecall(turns=', p_size, ')') ELSE 'Advise' END AS enforcement, CASE WHEN p_size % 2 = 0 THEN 'Require' END AS suggested, CASE WHEN p_size > 25 THEN concat('no --> ', p_brand) END AS block_message FROM {part}""",
)
def _(t):
    kind = F.expr("CASE p_size % 3 WHEN 0 THEN 'Block' WHEN 1 THEN concat('RequireRecall(turns=', p_size, ')') ELSE 'Odd' END")
    text = F.concat(
        F.lit("# Lessons\n\n### "), "p_name", F.lit("\nUse "), "p_type", F.lit(".\n<!-- other: x -->\n<!-- enforcement: "), kind, F.lit(" -->\n<!-- suggested_enforcement: "), F.when(c("p_size") % 2 == 0, "Require").otherwise("Never"),
        F.lit(" -->\n<!-- block_message: "), F.when(c("p_size") > 25, F.concat(F.lit("no --&gt; "), "p_brand")).otherwise(""), F.lit(" -->\n<!-- success: "), "p_size", F.lit(" / failure: "), "p_partkey", F.lit(" -->\n\n## Other\n"),
    )
    return parsers.lessons(t.part.select(c("p_partkey").alias("key"), text.alias("text")), "key", "text")


@query("s12_markdown_preferences", "SELECT p_partkey AS key, CAST(1 AS INTEGER) AS number, CASE WHEN p_size > 25 THEN p_name ELSE concat(p_name, chr(10), p_type, chr(10), chr(10), p_brand) END AS text, concat(p_brand, ',x') AS tags FROM {part}")
def _(t):
    body = F.when(c("p_size") > 25, F.lit("\n")).otherwise(F.concat("p_type", F.lit("\n\n"), "p_brand"))
    text = F.concat(F.lit("### "), "p_name", F.lit("\n\n"), body, F.lit("\ntags: "), "p_brand", F.lit(",, x\n\n"))
    return parsers.preferences(t.part.select(c("p_partkey").alias("key"), text.alias("text")), "key", "text")


@query("s14_skills", "SELECT concat('skill', p_partkey) AS slug, CASE WHEN p_size > 25 THEN p_name ELSE concat('skill', p_partkey) END AS name, CASE WHEN p_size > 25 THEN concat('\"', p_type, '\"') ELSE '' END AS description FROM {part}")
def _(t):
    text = F.when(c("p_size") > 25, F.concat(F.lit("---\nname: "), "p_name", F.lit('\ndescription: "'), "p_type", F.lit('"\n---\nbody'))).otherwise("no front matter")
    own = t.part.select(F.concat(F.lit("skill"), "p_partkey", F.lit("/SKILL.md")).alias("path"), text.alias("content"))
    return parsers.skills(own.unionByName(own.select(F.replace("path", F.lit("SKILL"), F.lit("notes")).alias("path"), "content")))


@query("s36_addons", "SELECT concat('a', p_partkey, '.md') AS path, p_name AS name, CASE WHEN p_size > 25 THEN CAST(p_size AS INTEGER) ELSE 50 END AS priority, 'after_base' AS inject_position, CASE WHEN p_size > 25 THEN concat('react,', p_brand) ELSE '' END AS frameworks, 'The body.' AS body FROM {part} WHERE p_partkey % 3 <> 0")
def _(t):
    name = F.when(c("p_partkey") % 3 != 0, F.concat(F.lit("name: "), "p_name", F.lit("\n"))).otherwise("")
    rest = F.when(c("p_size") > 25, F.concat(F.lit("priority: "), "p_size", F.lit('\nframeworks: ["react", "'), "p_brand", F.lit('"]\n'))).otherwise("priority: high\nframeworks: react\n")
    own = t.part.select(F.concat(F.lit("a"), "p_partkey", F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), name, rest, F.lit("---\n\nThe body.\n")).alias("content"))
    return parsers.addons(own).select("path", "name", "priority", "inject_position", F.array_join("frameworks", ",").alias("frameworks"), "body")


_AT = "CASE event_type WHEN 'click' THEN 'feat' WHEN 'view' THEN 'fix' WHEN 'error' THEN 'docs' ELSE event_type END"


@query(
    "s30_session_catalog",
    f"""WITH f AS (SELECT {_AT} AS type, concat('u', user_id) AS name, concat('f', event_id % 4, '.md') AS file, ts FROM {{events}})
    SELECT concat(type, '/', name) AS id, type, name, string_agg(DISTINCT file, ',' ORDER BY file) AS files, max(ts) AS modified FROM f WHERE type IN ('feat', 'fix', 'docs') GROUP BY type, name""",
)
def _(t):
    own = t.events.select(F.concat(F.expr(_AT), F.lit("/u"), "user_id", F.lit("/f"), c("event_id") % 4, F.lit(".md")).alias("path"), c("ts").alias("modificationTime"))
    return files.session_catalog(own).withColumn("files", F.array_join("files", ","))


_DIR = "CASE event_id % 5 WHEN 0 THEN 'target' WHEN 1 THEN '.git' WHEN 2 THEN 'src/dist' WHEN 3 THEN 'src' ELSE 'src/targets' END"


@query("s38_file_index", f"SELECT concat({_DIR}, '/f', event_id, '.rs') AS path FROM {{events}} WHERE event_id % 5 IN (3, 4)")
def _(t):
    return files.file_index(t.events.select(F.concat(F.expr(_DIR), F.lit("/f"), "event_id", F.lit(".rs")).alias("path")))


@query("s09_transcript_files", "SELECT DISTINCT concat('/home/u', user_id) AS project, concat('s', event_id) AS session_id, ts AS modified FROM {events} WHERE event_id % 3 < 2")
def _(t):
    id_ = F.concat(F.lit("s"), "event_id")
    tail = F.when(c("event_id") % 3 == 0, F.concat(id_, F.lit(".jsonl"))).when(c("event_id") % 3 == 1, F.concat(F.lit("sessions/"), id_, F.lit("/conversation.jsonl"))).otherwise(F.concat(id_, F.lit("/notes.jsonl")))
    own = t.events.select(F.concat(F.lit("-home-u"), "user_id", F.lit("/"), tail).alias("path"), c("ts").alias("modificationTime"))
    return files.transcript_files(own).drop("path").distinct()


@query(
    "v02_spec_findings",
    """SELECT p_partkey AS id, 'error' AS severity, 'key_missing:status' AS finding FROM {part} UNION ALL SELECT p_partkey, 'warning', 'few_code_blocks' FROM {part} UNION ALL SELECT p_partkey, 'error', 'section_missing:Acceptance' FROM {part} WHERE p_size > 25""",
)
def _(t):
    text = F.concat(F.lit('---\nspec_version: "1"\nproject: '), "p_name", F.lit("\ncomponent: x\nlanguage: y\n---\n## Types\n```\nx\n```\n## Interfaces\n## Implementations\n"), F.when(c("p_size") > 25, "").otherwise("## Acceptance Criteria\n"))
    return V.spec_findings(t.part.select(c("p_partkey").alias("id"), text.alias("text")), "id", "text")


@query(
    "v02_test_spec_findings",
    """SELECT p_partkey AS id, 'error' AS severity, 'section_empty:E2E Tests' AS finding FROM {part} WHERE p_size > 25 UNION ALL SELECT p_partkey, 'error', 'section_empty:Visual Verification' FROM {part} WHERE p_size > 25
    UNION ALL SELECT p_partkey, 'error', 'section_empty:Edge Cases' FROM {part} WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'warning', concat('surface_unknown:', lower(p_brand)) FROM {part} WHERE p_size <= 25""",
)
def _(t):
    surface = F.when(c("p_size") > 25, "ui").otherwise(F.lower("p_brand"))
    rows = F.when(c("p_partkey") % 2 == 0, "").otherwise("| none | - |\n")
    text = F.concat(F.lit("---\ntests_version: 1\nspec_ref: s\ncomponent: x\ncategory: code\nsurface: "), surface, F.lit("\n---\n## Unit Tests\n### Test: a\n## Edge Cases\n| case | req |\n|---|:-:|\n"), rows, F.lit("## E2E Tests\n"))
    return V.test_spec_findings(t.part.select(c("p_partkey").alias("id"), text.alias("text")), "id", "text")


@query(
    "j15_plan_coverage",
    """WITH k AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 4 AS m FROM {part})
    SELECT id, 'error' AS severity, concat('edge_case_missing:', name) AS finding FROM k WHERE m = 0 UNION ALL SELECT id, 'error', concat('edge_case_without_test:', name) FROM k WHERE m = 1
    UNION ALL SELECT id, 'error', concat('edge_case_without_implementation:', name) FROM k WHERE m = 2 UNION ALL SELECT id, 'error', 'test_missing:Unit Tests:adds two' FROM k WHERE m IN (0, 1)""",
)
def _(t):
    spec = F.concat(F.lit("## unit tests\n### Test: adds two\n## Edge Cases\n| case | req |\n|---|---|\n| "), "p_name", F.lit(" | R1 |\n| None for R2 | - |\n"))
    task = """named_struct('id', 'T%d', 'name', 'n', 'type', '%s', 'edge_cases', IF(p_partkey %% 4 IN (%s), array(concat('When  ', upper(p_name), ' comes')), CAST(array() AS array<string>)), 'test_cases', IF(p_partkey %% 4 IN (%s), array('Adds  two'), NULL), 'ui', false)"""
    tasks = F.expr(f"array({task % (1, 'code', '1, 3', '-1')}, {task % (2, 'test', '2, 3', '2, 3')})")
    return V.coverage_findings(t.part.select(c("p_partkey").alias("id"), spec.alias("spec"), tasks.alias("tasks")), "id", "spec", "tasks")


@query("l06_json_body", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('{\"k\":', json_extract(props, '$.k'), ',\"a\":[1,2]}', chr(10)) WHEN 1 THEN concat('{ \"k\" : ', json_extract(props, '$.k'), ', \"a\": [1, 2]}', chr(10)) WHEN 2 THEN '{ \"k\" : ' ELSE ' 12 ' END AS body FROM {events}")
def _(t):
    text = F.when(c("event_id") % 4 < 2, F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, 2]}\n'))).when(c("event_id") % 4 == 2, '{ "k" : ').otherwise(" 12 ")
    args = F.when(c("event_id") % 4 == 1, F.array(F.lit("--output=x"))).otherwise(F.array(F.lit("-s")))
    return t.events.select("event_id", L.json_body(text, args).alias("body"))
