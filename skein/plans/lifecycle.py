"""Queries over lifecycle policies and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import lifecycle as L
from skein.operators import relational as R
from skein.operators.constraints import TASK_TYPE, plan_findings
from skein.plans.registry import query

c = F.col
_SCORE = "salience * exp(-0.02 * greatest(0, 900000 - coalesce(accessed_s, at_s)) / 86400.0) * ln(exp(1.0) + access_count)"


@query("p01_forget_pass", f"WITH f AS (SELECT * FROM {{episodes}} WHERE at_s >= 300000), h AS (SELECT * FROM f ORDER BY id DESC LIMIT 3000) SELECT id FROM h WHERE NOT {_SCORE} < 0.5")
def _(t):
    return L.forget(t.episodes, 900_000, 600_000, 3000, floor=0.5)["decay"].select("id")


@query("p02_decay_eviction", f"SELECT id FROM {{episodes}} WHERE {_SCORE} < 0.6")
def _(t):
    kept = L.forget(t.episodes, 900_000, 10**9, 10**9, floor=0.6)["decay"].select("id")
    return t.episodes.join(kept, "id", "left_anti").select("id")


@query("p03_low_confidence", "SELECT trigger_text FROM {lessons} WHERE success + failure >= 3 AND success / (success + failure + 1) < 0.6")
def _(t):
    return t.lessons.join(L.keep_lessons(t.lessons, 0.6).select("trigger_text"), "trigger_text", "left_anti").select("trigger_text")


@query("p04_quarantine", "SELECT trigger_text FROM {lessons} WHERE success + failure >= 5 AND failure / (success + failure) >= 0.2")
def _(t):
    return L.quarantined(t.lessons, 0.2).select("trigger_text")


@query("p05_retention_cap", "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY first DESC) AS rn FROM (SELECT user_id, min(event_id) AS first FROM {events} GROUP BY user_id)) WHERE rn <= 50")
def _(t):
    return R.newest(t.events.groupBy("user_id").agg(F.min("event_id").alias("first")), "first", 50).select("user_id")


@query("v01_plan_violations", "SELECT id, 'budget_too_large' AS violation FROM {tasks} WHERE budget_tokens > 40000 UNION ALL SELECT id, concat('dangling_dependency:', dep) FROM {task_deps} WHERE dep NOT IN (SELECT id FROM {tasks})")
def _(t):
    return L.plan_violations(t.tasks, t.task_deps, 40_000)


# a plan of each order with its lines as tasks; what is wrong with them follows their numbers, and so does its SQL
_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(floor(l_quantity * 2000) AS BIGINT) AS budget FROM {lineitem}"


@query(
    "v01_plan_findings",
    f"""WITH RECURSIVE l AS ({_LINES}), g AS (SELECT k, CAST(sum(budget) AS BIGINT) AS total FROM l GROUP BY k), d AS (SELECT k, n, CASE WHEN p % 13 = 0 THEN n + 1 WHEN p % 7 = 0 THEN n + 100 WHEN n > 1 THEN n - 1 END AS dep FROM l WHERE n > 0),
    w AS (SELECT k, n AS root, dep AS here FROM d WHERE dep IS NOT NULL UNION SELECT w.k, w.root, d.dep FROM w JOIN d ON d.k = w.k AND d.n = w.here WHERE d.dep IS NOT NULL)
    SELECT k AS plan, NULL AS task, 'error' AS severity, 'workspace_not_absolute' AS finding FROM g WHERE k % 4 = 0 UNION ALL SELECT k, NULL, 'error', 'missing:name' FROM g WHERE k % 6 = 0
    UNION ALL SELECT k, NULL, 'warning', concat('budget_mismatch:', k % 200 * 1000, ':', total) FROM g WHERE k % 200 > 0 AND abs((total - k % 200 * 1000) / (k % 200 * 1000)) > 0.1
    UNION ALL SELECT k, concat('t', n), 'error', 'complexity_unknown' FROM l WHERE p % 4 = 3 UNION ALL SELECT k, concat('t', n), 'error', 'missing:complexity' FROM l WHERE p % 4 = 2
    UNION ALL SELECT k, concat('t', n), 'warning', concat('budget_too_large:', budget) FROM l WHERE budget > 80000 UNION ALL SELECT k, concat('t', n), 'error', 'files_empty' FROM l WHERE p % 5 = 0
    UNION ALL SELECT k, concat('t', n), 'error', concat('file_not_absolute:src/p', p) FROM l WHERE p % 5 = 1 UNION ALL SELECT k, concat('t', n), 'warning', concat('pointer_not_absolute:src/p', p, ':1-2') FROM l WHERE p % 5 = 2
    UNION ALL SELECT k, concat('t', n), 'warning', 'acceptance_not_runnable' FROM l WHERE p % 3 = 1 UNION ALL SELECT k, concat('t', n), 'error', 'test_cases[1]_missing:verify' FROM l WHERE p % 2 = 0
    UNION ALL SELECT k, concat('t', n), 'warning', 'missing:edge_cases' FROM l WHERE p % 9 = 0 UNION ALL SELECT k, concat('t', n), 'warning', 'missing:type' FROM l
    UNION ALL SELECT DISTINCT k, concat('t', n), 'error', concat('dangling:t', dep) FROM d WHERE dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = d.k AND l.n = d.dep)
    UNION ALL SELECT DISTINCT k, concat('t', root), 'error', 'cycle' FROM w WHERE root = here""",
)
def _(t):
    lines = t.spark.sql(_LINES, lineitem=t.lineitem)
    dep = "CASE WHEN x.p % 13 = 0 THEN x.n + 1 WHEN x.p % 7 = 0 THEN x.n + 100 WHEN x.n > 1 THEN x.n - 1 END"
    task = f"""named_struct('id', concat('t', x.n), 'name', concat('part ', x.p), 'complexity', CASE x.p % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 3 THEN 'huge' END, 'budget_tokens', x.budget,
      'files', CASE x.p % 5 WHEN 0 THEN array() WHEN 1 THEN array('/w/a', concat('src/p', x.p)) ELSE array('/w/a') END, 'depends_on', filter(array(concat('t', {dep})), d -> d IS NOT NULL),
      'context_pointers', CASE x.p % 5 WHEN 2 THEN array('', concat('src/p', x.p, ':1-2')) ELSE array('/w/a:1-2') END, 'acceptance', CASE x.p % 3 WHEN 1 THEN 'Works well' WHEN 2 THEN ' make test' ELSE '' END,
      'test_cases', array(named_struct('name', 'a', 'expected', 'b', 'verify', 'c'), named_struct('name', 'a', 'expected', 'b', 'verify', CASE x.p % 2 WHEN 0 THEN ' ' ELSE 'c' END)),
      'edge_cases', CASE WHEN x.p % 9 <> 0 THEN array() END, 'ui', false, 'type', NULL)"""
    # lines are gathered as they are, and become tasks where they lie
    plans = lines.groupBy(c("k").alias("plan")).agg(F.collect_list(F.struct("n", "p", "budget")).alias("lines"))
    plans = plans.select("plan", F.expr(f"transform(lines, x -> CAST({task} AS {TASK_TYPE}))").alias("tasks"))
    plans = plans.withColumns({"name": F.when(c("plan") % 6 != 0, "plan"), "workspace_dir": F.when(c("plan") % 4 == 0, "w").otherwise("/w"), "budget_tokens": (c("plan") % 200 * 1000).cast("long")})
    return plan_findings(plans, "plan")


@query("v04_task_ids", "SELECT id, CAST(count(dep) AS BIGINT) AS n_deps FROM {tasks} LEFT JOIN {task_deps} USING (id) GROUP BY id")
def _(t):
    return t.tasks.join(t.task_deps, "id", "left").groupBy("id").agg(F.count("dep").alias("n_deps"))


RULES = [
    {"id": "no-errors-5", "matcher": "error|click", "conditions": [("props", "contains", '"k": 5')], "action": "block"},
    {"id": "warn-9", "matcher": "click|view", "conditions": [("props", "regex", '"k": 9[0-9]')], "action": "warn"},
    {"id": "bad-pattern", "matcher": "view", "conditions": [("props", "regex", "(")], "action": "block"},
    {"id": "off", "matcher": "view", "conditions": [], "action": "block", "enabled": False},
    {"id": "glob", "matcher": "signup", "conditions": [("props", "glob", '*7}'), ("props", "not_contains", "77")], "action": "block"},
]


@query(
    "f08_rule_gate",
    """WITH r AS (SELECT event_id, CASE WHEN event_type IN ('error', 'click') AND contains(props, '"k": 5') THEN 'no-errors-5' WHEN event_type = 'signup' AND ends_with(props, '7}') AND NOT contains(props, '77') THEN 'glob' END AS b,
      CASE WHEN event_type IN ('click', 'view') AND regexp_matches(props, '"k": 9[0-9]') THEN 'warn-9' END AS w FROM {events})
    SELECT event_id, CASE WHEN b IS NOT NULL THEN 'block' WHEN w IS NOT NULL THEN 'warn' ELSE 'allow' END AS decision, coalesce(b, w) AS rule FROM r""",
)
def _(t):
    return L.rule_gate(t.events, RULES, "event_id", "event_type")
