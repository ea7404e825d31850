"""Queries over usage, costs, reports and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import lifecycle as L
from skein.operators import relational as R
from skein.operators import sessions as N
from skein.plans.registry import query

c = F.col


@query("a01_archive_status", "SELECT count(*) AS sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS turns FROM (SELECT session_id, count(*) AS n FROM {turns} GROUP BY session_id)")
def _(t):
    return t.turns.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns"))


@query("a02_topics", "SELECT event_type AS topic, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY event_type")
def _(t):
    return t.events.groupBy(c("event_type").alias("topic")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("a04_next_numbers", "SELECT session_id, max(turn_number) + 1 AS next FROM {turns} GROUP BY session_id")
def _(t):
    return t.turns.groupBy("session_id").agg((F.max("turn_number") + 1).alias("next"))


@query(
    "a05_usage_summary",
    """WITH u AS (SELECT * FROM {usage} ORDER BY seq DESC LIMIT 2000), l AS (SELECT unnest(['low', 'medium', 'high']) AS complexity), s AS (SELECT complexity, count(*) AS n, CAST(floor(sum(estimated) / count(*)) AS BIGINT) AS e, CAST(floor(sum(actual) / count(*)) AS BIGINT) AS a FROM u GROUP BY complexity)
    SELECT l.complexity, coalesce(n, 0) AS n, coalesce(e, 0) AS avg_estimated, coalesce(a, 0) AS avg_actual, round(CASE WHEN coalesce(e, 0) > 0 THEN a / e ELSE 0.0 END, 6) AS ratio FROM l LEFT JOIN s USING (complexity)""",
)
def _(t):
    return L.usage_summary(t.usage, 2000)


@query("a06_calibration", "SELECT complexity, round(greatest(0.0, least(3.0, avg(actual / estimated))), 6) AS factor, count(*) AS samples FROM {usage} WHERE estimated > 0 GROUP BY complexity")
def _(t):
    return L.calibration(t.usage)


@query("a08_report_with_totals", "SELECT session_id, CAST(sum(actual) AS BIGINT) AS tokens, count(*) AS tasks FROM {usage} GROUP BY GROUPING SETS ((session_id), ())")
def _(t):
    return t.usage.rollup("session_id").agg(F.sum("actual").alias("tokens"), F.count("*").alias("tasks"))


# input, cache write, cache read and output of each model of the sample, written out here so that the SQL checks the operator's table
_PRICES = {"claude-opus-4-1": (15.0, 18.75, 1.5, 75.0), "claude-sonnet-4": (3.0, 3.75, 0.3, 15.0), "Claude_Haiku_4_5": (1.0, 1.25, 0.1, 5.0), "other": (3.0, 3.75, 0.3, 15.0)}


def _price(i: int) -> str:
    return "(CASE model " + " ".join(f"WHEN '{k}' THEN CAST({v[i]} AS DOUBLE) / 1e6" for k, v in _PRICES.items()) + " END)"


_ACTUAL = f"(cache_write_tokens * {_price(1)} + cache_read_tokens * {_price(2)} + input_tokens * {_price(0)} + output_tokens * {_price(3)})"
_PLAIN = f"((cache_write_tokens + cache_read_tokens + input_tokens) * {_price(0)} + output_tokens * {_price(3)})"
_SESSIONS = f"""s AS (SELECT session_id, count(*) AS n_turns, max(seq) AS last, split_part(max(printf('%09d|%s', seq, model)), '|', 2) AS model, sum(input_tokens) AS i, sum(cache_read_tokens) AS r, sum(cache_write_tokens) AS w, sum({_ACTUAL}) AS actual, sum({_PLAIN}) AS plain,
      sum(cache_write_tokens * ({_price(1)} - {_price(0)})) AS o FROM {{turn_usage}} GROUP BY session_id),
    h AS (SELECT *, CASE WHEN r + w > 0 THEN r / (r + w) ELSE 0.0 END AS hit, CASE WHEN r + w > 0 THEN r / (r + w) ELSE 0.0 END * (r + w) / (i + 2 * (r + w)) AS score FROM s)"""


@query(
    "a09_session_costs",
    f"""WITH {_SESSIONS}
    SELECT session_id, n_turns, model, round(hit, 3) AS hit_rate, round(actual, 4) AS actual_cost, round(plain - actual, 4) AS savings, round(plain - actual - o, 4) AS net_savings, round((plain - actual) / plain * 100, 1) AS savings_pct, round(score, 3) AS efficiency,
      CASE WHEN score >= 0.7 THEN 'A' WHEN score >= 0.5 THEN 'B' WHEN score >= 0.3 THEN 'C' WHEN score >= 0.1 THEN 'D' ELSE 'F' END AS grade FROM h""",
)
def _(t):
    # one row of a key and number may be there twice in the sample; the later model by name then counts as last
    return L.session_costs(t.turn_usage)


@query(
    "a10_portfolio_costs",
    f"""WITH {_SESSIONS}, k AS (SELECT * FROM h ORDER BY last DESC, session_id LIMIT 10)
    SELECT count(*) AS sessions, round(sum(actual), 4) AS actual_cost, round(sum(plain), 4) AS cost_no_cache, round(sum(plain) - sum(actual), 4) AS savings, round(sum(plain) - sum(actual) - sum(o), 4) AS net_savings,
      round((sum(plain) - sum(actual)) / sum(plain) * 100, 1) AS savings_pct, round(avg(hit), 3) AS hit_rate FROM k""",
)
def _(t):
    return L.portfolio_costs(t.turn_usage)


@query("a12_enforcement_report", "SELECT count(*) AS total_events, count(*) FILTER (event = 'enforcement_block') AS blocks, count(*) FILTER (event = 'enforcement_override') AS overrides, round(count(*) FILTER (event = 'enforcement_override') / count(*) FILTER (event = 'enforcement_block'), 2) AS fp_risk FROM {enforcement}")
def _(t):
    return L.enforcement_report(t.enforcement)


@query(
    "a07_session_report",
    """WITH p AS (SELECT session_id, coalesce(phase, '?') AS phase, CAST(sum(greatest(coalesce(tokens, 0), 0)) AS BIGINT) AS tokens, count(*) AS n FROM {phase_stats} GROUP BY 1, 2),
    s AS (SELECT session_id, string_agg(concat(phase, '=', tokens), ',' ORDER BY phase) AS phases, CAST(sum(tokens) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (phase = 'fix'), 0) AS BIGINT) AS fixes FROM p GROUP BY session_id),
    k AS (SELECT session_id, count(*) AS n, count(*) FILTER (status IN ('completed', 'done', 'passed')) AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (ui) AS ui FROM {session_tasks} GROUP BY session_id)
    SELECT coalesce(s.session_id, k.session_id) AS session_id, coalesce(phases, '') AS phases, coalesce(total, 0) AS total_tokens, CASE WHEN done > 0 THEN coalesce(total, 0) // done ELSE 0 END AS tokens_per_completed_task, coalesce(fixes, 0) AS fix_rounds,
      coalesce(n, 0) AS tasks_total, coalesce(done, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(ui, 0) AS ui_tasks FROM s FULL JOIN k ON k.session_id = s.session_id""",
)
def _(t):
    found = N.session_reports(t.phase_stats, t.session_tasks)
    return found.withColumn("phases", F.array_join(F.transform(F.map_entries("phases"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))


_LOG = """(SELECT CAST(user_id AS BIGINT) AS session_id, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event FROM {events})"""


@query(
    "a13_stop_fold",
    f"""SELECT session_id, count(*) FILTER (event = 'error') > 0 AS has_frustration, coalesce(max(seq) FILTER (event = 'signup') > max(seq) FILTER (event = 'error'), false) AS lesson_saved_after, 2 * count(*) FILTER (event = 'view') AS n_triggers
    FROM {_LOG} GROUP BY session_id""",
)
def _(t):
    return N.stop_fold(t.session_log)


@query("a13_surfaced_triggers", f"SELECT session_id, seq, CAST(k AS INTEGER) AS position, CASE k WHEN 0 THEN concat('t', seq % 5) ELSE 'all' END AS trigger FROM {_LOG}, (VALUES (0), (1)) v(k) WHERE event = 'view'")
def _(t):
    return N.surfaced_triggers(t.session_log)


@query("a14_search_threshold", f"SELECT session_id, count(*) AS searches FROM {_LOG} WHERE event = 'click' AND session_id NOT IN (SELECT o_custkey FROM {{orders}} WHERE o_orderkey % 7 = 0) GROUP BY session_id HAVING count(*) >= 4")
def _(t):
    return N.search_nudges(t.session_log, t.orders.filter("o_orderkey % 7 = 0").select(c("o_custkey").cast("long").alias("session_id")))


@query("a18_budget_by_wave", "WITH d AS (SELECT DISTINCT id FROM {task_deps}) SELECT CAST(CASE WHEN d.id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS wave, CAST(sum(budget_tokens) AS BIGINT) AS budget, count(*) AS tasks FROM {tasks} t LEFT JOIN d ON d.id = t.id GROUP BY 1")
def _(t):
    deps = t.task_deps.select("id").distinct().withColumn("waits", F.lit(True))
    return t.tasks.join(deps, "id", "left").groupBy(F.when(c("waits"), 2).otherwise(1).alias("wave")).agg(F.sum("budget_tokens").alias("budget"), F.count("*").alias("tasks"))


@query("a19_budget_mismatch", "SELECT o_orderkey FROM {orders} JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM {lineitem} GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE abs((s - o_totalprice) / o_totalprice) > 0.1")
def _(t):
    sums = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    return t.orders.join(sums, "o_orderkey").filter(F.abs((c("s") - c("o_totalprice")) / c("o_totalprice")) > 0.1).select("o_orderkey")


@query("a22_hits_per_session", "SELECT event_id FROM (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM {events}) WHERE rn <= 3 ORDER BY value, event_id LIMIT 40")
def _(t):
    return R.capped_per_key(t.events, ["user_id"], [c("value"), c("event_id")], 3).orderBy("value", "event_id").limit(40).select("event_id")


@query("a24_first_seen", "SELECT event_type, min(event_id) AS event_id FROM {events} GROUP BY event_type")
def _(t):
    return R.first_of_each(t.events.select("event_type", "event_id"), ["event_type"], "event_id")
