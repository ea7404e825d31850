"""Reports over the files that a session leaves: its log of events, its tokens by phase, and the outcomes of its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Searches of a session after which it is told of better ones.
NUDGE_SEARCHES = 4
#: States of a task that is done.
DONE = ("completed", "done", "passed")


def session_reports(phases: DataFrame, tasks: DataFrame) -> DataFrame:
    """(session_id, phases, total_tokens, tokens_per_completed_task, fix_rounds, tasks_total, completed, failed, ui_tasks) of each session of
    phases (session_id, phase, tokens) or tasks (session_id, status, ui).

    `phases` maps names to tokens; rows without a phase count as `?`, and tokens that are null or negative as none. Sums are made by session
    and phase before they meet, so a session with very many rows is one row a phase and task.
    """
    named = phases.groupBy("session_id", F.coalesce("phase", F.lit("?")).alias("phase")).agg(F.sum(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))).cast("long").alias("tokens"), F.count("*").alias("rows"))
    spent = named.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "tokens")))).alias("phases"),
        F.sum("tokens").alias("total_tokens"),
        F.sum(F.when(c("phase") == "fix", c("rows")).otherwise(0)).alias("fix_rounds"),
    )
    done = tasks.groupBy("session_id").agg(F.count("*").alias("tasks_total"), F.count_if(c("status").isin(*DONE)).alias("completed"), F.count_if(c("status") == "failed").alias("failed"), F.count_if(c("ui")).alias("ui_tasks"))
    both = spent.join(done, "session_id", "full")
    zero = lambda *names: [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names]
    each = F.when(c("completed") > 0, F.floor(F.coalesce("total_tokens", F.lit(0)) / c("completed"))).otherwise(0).cast("long")
    return both.select("session_id", F.coalesce("phases", F.expr("CAST(map() AS map<string, bigint>)")).alias("phases"), *zero("total_tokens"), each.alias("tokens_per_completed_task"), *zero("fix_rounds", "tasks_total", "completed", "failed", "ui_tasks"))


def parsed_log(log: DataFrame) -> DataFrame:
    """(session_id, seq, event, triggers) of lines (session_id, seq, line) of JSON that name an event; other lines and triggers that are no texts are skipped."""
    v = log.select("session_id", "seq", F.try_parse_json("line").alias("v"))
    text = lambda x: f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN CAST({x} AS STRING) END"
    event = F.expr(text("try_variant_get(v, '$.event', 'variant')"))
    triggers = F.expr(f"transform(try_variant_get(v, '$.triggers', 'array<variant>'), x -> {text('x')})")
    return v.select("session_id", "seq", event.alias("event"), F.array_compact(triggers).alias("triggers")).filter("event IS NOT NULL")


def stop_fold(log: DataFrame) -> DataFrame:
    """(session_id, has_frustration, lesson_saved_after, n_triggers) of each session of the log: whether a lesson was saved after the last
    frustration, and how many triggers were surfaced. A session without a readable line has none of it."""
    last = lambda e: F.max(F.when(c("event") == e, c("seq")))
    n = F.sum(F.when(c("event") == "lesson_surfaced", F.coalesce(F.size("triggers"), F.lit(0))).otherwise(0))
    found = parsed_log(log).groupBy("session_id").agg(last("frustration").alias("f"), last("lesson_saved").alias("s"), n.cast("long").alias("n"))
    out = log.select("session_id").distinct().join(found, "session_id", "left")
    return out.select("session_id", c("f").isNotNull().alias("has_frustration"), F.coalesce(c("s") > c("f"), F.lit(False)).alias("lesson_saved_after"), F.coalesce("n", F.lit(0).cast("long")).alias("n_triggers"))


def surfaced_triggers(log: DataFrame) -> DataFrame:
    """(session_id, seq, position from 0, trigger) of the lessons that a session was shown, in the order of its log by seq and position."""
    return parsed_log(log).filter("event = 'lesson_surfaced'").select("session_id", "seq", F.posexplode("triggers").alias("position", "trigger"))


def search_nudges(log: DataFrame, shown: DataFrame, least: int = NUDGE_SEARCHES) -> DataFrame:
    """(session_id, searches) of the sessions with `least` code searches or more that haven't been told yet (`shown`: session_id)."""
    n = parsed_log(log).filter("event = 'code_search'").groupBy("session_id").agg(F.count("*").alias("searches")).filter(c("searches") >= least)
    return n.join(shown.select("session_id"), "session_id", "left_anti")
