"""Lifecycle policies over logs and lessons, usage and cost analytics, budgets and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.operators.relational import newest

c = F.col


def forget(episodes: DataFrame, now_s: int, ttl_s: int = 30 * 86400, capacity: int = 50_000, decay: float = 0.02, floor: float = 0.05) -> dict[str, DataFrame]:
    """Survivors of each stage, in order: TTL, capacity (newest ids), decay (score below the floor goes; a floor of 0 or less keeps all)."""
    fresh = episodes.filter(c("at_s") >= now_s - ttl_s)
    held = newest(fresh, "id", capacity)
    score = S.retention(c("salience").cast("double"), F.lit(now_s) - F.coalesce("accessed_s", "at_s"), F.greatest("access_count", F.lit(0)), decay)
    return {"ttl": fresh, "capacity": held, "decay": held if floor <= 0 else held.filter(~(score < floor))}


def keep_lessons(lessons: DataFrame, least: float = 0.2, attempts: int = 3) -> DataFrame:
    """Lessons but for those tried often enough with success / (attempts + 1) below the least."""
    n = c("success") + c("failure")
    return lessons.filter(~((n >= attempts) & (c("success") / (n + 1) < least)))


def quarantined(lessons: DataFrame, ratio: float = 0.66, attempts: int = 5) -> DataFrame:
    """Lessons tried often enough whose share of failures reaches the ratio."""
    n = c("success") + c("failure")
    return lessons.filter((n >= attempts) & (c("failure") / F.greatest(n, F.lit(1)) >= ratio))


def usage_summary(usage: DataFrame, last: int | None = None) -> DataFrame:
    """(complexity, n, avg_estimated, avg_actual, ratio) of the last records: averages cut to whole numbers, the ratio of those; each complexity has a row."""
    rows = newest(usage, "seq", last) if last else usage
    levels = rows.sparkSession.createDataFrame([("low",), ("medium",), ("high",)], "complexity string")
    sums = rows.groupBy("complexity").agg(F.count("*").alias("n"), F.floor(F.sum("estimated") / F.count("*")).alias("e"), F.floor(F.sum("actual") / F.count("*")).alias("a"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return levels.join(sums, "complexity", "left").select("complexity", zero("n").alias("n"), zero("e").alias("avg_estimated"), zero("a").alias("avg_actual"), F.round(F.when(zero("e") > 0, zero("a") / zero("e")).otherwise(0.0), 6).alias("ratio"))


def calibration(usage: DataFrame) -> DataFrame:
    """(complexity, factor, samples): mean actual / estimated where estimated is positive, held to 0..3."""
    own = usage.filter("estimated > 0")
    return own.groupBy("complexity").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.avg(c("actual") / c("estimated")))), 6).alias("factor"), F.count("*").alias("samples"))


def turn_costs(turns: DataFrame) -> DataFrame:
    """`turns` with actual_cost, cost_no_cache and write_overhead in dollars."""
    p = lambda i: S.price(c("model"), i)
    actual = c("cache_write_tokens") * p(S.CACHE_WRITE) + c("cache_read_tokens") * p(S.CACHE_READ) + c("input_tokens") * p(S.INPUT) + c("output_tokens") * p(S.OUTPUT)
    plain = (c("cache_write_tokens") + c("cache_read_tokens") + c("input_tokens")) * p(S.INPUT) + c("output_tokens") * p(S.OUTPUT)
    return turns.withColumns({"actual_cost": actual, "cost_no_cache": plain, "write_overhead": c("cache_write_tokens") * (p(S.CACHE_WRITE) - p(S.INPUT))})


def session_costs(turns: DataFrame) -> DataFrame:
    """Per session: turns, the last turn's model, hit rate, costs, savings, efficiency (the hit rate weighted by how much of what is
    read and cached is cached) and its grade."""
    s = turn_costs(turns).groupBy("session_id").agg(
        F.count("*").alias("n_turns"), F.max_by("model", F.struct("seq", "model")).alias("model"), F.sum("cache_read_tokens").alias("read"), F.sum("cache_write_tokens").alias("write"), F.sum("input_tokens").alias("input"),
        F.sum("actual_cost").alias("actual"), F.sum("cost_no_cache").alias("plain"), F.sum("write_overhead").alias("overhead"),
    )
    hit = F.when(c("read") + c("write") > 0, c("read") / (c("read") + c("write"))).otherwise(0.0)
    saved, cached = c("plain") - c("actual"), c("read") + c("write")
    score = F.when(c("input") + 2 * cached > 0, hit * cached / (c("input") + 2 * cached)).otherwise(0.0)
    return s.select(
        "session_id", "n_turns", "model", S.rounded(hit, 3).alias("hit_rate"), S.rounded(c("actual"), 4).alias("actual_cost"), S.rounded(saved, 4).alias("savings"), S.rounded(saved - c("overhead"), 4).alias("net_savings"),
        S.rounded(F.when(c("plain") > 0, saved / c("plain") * 100).otherwise(0.0), 1).alias("savings_pct"), S.rounded(score, 3).alias("efficiency"), S.grade(score).alias("grade"),
    )


def portfolio_costs(turns: DataFrame, top: int = 10) -> DataFrame:
    """One row for the `top` sessions (turns have session_id, seq) of the latest turns: how many, what they cost in all, what the cache saved, and the mean hit rate."""
    latest = turns.groupBy("session_id").agg(F.max("seq").alias("last")).orderBy(F.desc("last"), "session_id").limit(top).select("session_id")
    own = turn_costs(turns.join(F.broadcast(latest), "session_id"))  # `top` rows
    each = own.groupBy("session_id").agg(F.sum("cache_read_tokens").alias("read"), F.sum("cache_write_tokens").alias("write"), F.sum("actual_cost").alias("actual"), F.sum("cost_no_cache").alias("plain"), F.sum("write_overhead").alias("overhead"))
    hit = F.when(c("read") + c("write") > 0, c("read") / (c("read") + c("write"))).otherwise(0.0)
    all_ = each.agg(F.count("*").alias("sessions"), F.sum("actual").alias("a"), F.sum("plain").alias("p"), F.sum("overhead").alias("o"), F.avg(hit).alias("h"))
    pct = F.when(c("p") > 0, (c("p") - c("a")) / c("p") * 100).otherwise(0.0)
    return all_.select("sessions", F.round("a", 4).alias("actual_cost"), F.round("p", 4).alias("cost_no_cache"), F.round(c("p") - c("a"), 4).alias("savings"), F.round(c("p") - c("a") - c("o"), 4).alias("net_savings"), F.round(pct, 1).alias("savings_pct"), F.round("h", 3).alias("hit_rate"))


def enforcement_report(events: DataFrame) -> DataFrame:
    """One row: events in all, blocks, overrides, and overrides / blocks to two decimals."""
    n = lambda e: F.count_if(c("event") == e)
    blocks, overrides = n("enforcement_block"), n("enforcement_override")
    return events.agg(F.count("*").alias("total_events"), blocks.alias("blocks"), overrides.alias("overrides"), F.round(F.when(blocks > 0, overrides / blocks).otherwise(0.0), 2).alias("fp_risk"))


def glob_regex(glob: str) -> str | None:
    """The pattern of a shell glob over the whole value: `*`, `**`, `?` and classes; null if a class isn't closed or stars are three."""
    import re

    out, i = "", 0
    while i < len(glob):
        x = glob[i]
        if x == "*":
            n = len(glob) - i - len(glob[i:].lstrip("*"))
            if n > 2:
                return None
            out, i = out + "(?s:.*)", i + n
        elif x == "?":
            out, i = out + "(?s:.)", i + 1
        elif x == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] == "!" else i + 2)
            if end < 0:
                return None
            inside = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^")
            out, i = out + ("[^" + inside[1:] if inside.startswith("!") else "[" + inside) + "]", end + 1
        else:
            out, i = out + re.escape(x), i + 1
    return f"^(?:{out})$"


def rule_holds(field: Column, op: str, value: str) -> Column:
    """One condition; a missing field or a pattern that isn't one fails, even for not_contains."""
    import re

    if op == "regex":
        try:
            re.compile(value)
        except re.error:
            return F.lit(False)
        out = field.rlike(value)
    elif op == "glob":
        out = field.rlike(glob_regex(value)) if glob_regex(value) else F.lit(False)
    elif op == "contains":
        out = field.contains(value)
    elif op == "not_contains":
        out = ~field.contains(value)
    elif op == "starts_with":
        out = field.startswith(value)
    else:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(out, F.lit(False))


def rule_gate(events: DataFrame, rules: list[dict], key: str, tool: str) -> DataFrame:
    """(key, decision, rule): the first blocking rule that holds, else warn with the first warning one, else allow.

    A rule is {id, matcher: "A|B", conditions: [(column, op, value)], action: block or warn, enabled, stateful?}.
    """
    hits = []
    for r in rules:
        if not r.get("enabled", True) or r.get("stateful"):
            continue
        hit = c(tool).isin(*r["matcher"].split("|"))
        for name, op, value in r["conditions"]:
            hit = hit & rule_holds(c(name), op, value)
        hits.append((r["id"], r["action"], hit))
    pick = lambda action: F.coalesce(*[F.when(h, F.lit(i)) for i, a, h in hits if a == action], F.lit(None).cast("string"))
    block, warn = pick("block"), pick("warn")
    return events.select(key, F.when(block.isNotNull(), "block").when(warn.isNotNull(), "warn").otherwise("allow").alias("decision"), F.coalesce(block, warn).alias("rule"))


# The rules that a project starts with: id, enforcement, matcher, conditions (field, operator, value), action, stateful.
DEFAULT_RULES = (
    ("no-edit-claude", "prompt", "Edit|Write", (("file_path", "contains", ".claude/"),), "block", None),
    ("no-bare-unwrap", "prompt", "Edit|Write", (("new_string", "regex", r"\bunwrap\(\)"),), "warn", None),
    ("no-todo-unimplemented", "prompt", "Edit|Write", (("new_string", "regex", r"\b(todo!|unimplemented!)"),), "warn", None),
    ("no-git-add-force", "prompt", "Bash", (("command", "regex", r"git\s+add\s+(-f|--force)"),), "block", None),
    ("warn-git-add-all", "prompt", "Bash", (("command", "regex", r"git\s+add\s+(-A|\.)"),), "warn", None),
    ("no-git-stash", "hook", "Bash", (("command", "regex", r"git\s+stash"),), "block", None),
    ("no-force-push-main", "hook", "Bash", (("command", "regex", r"git\s+push.*--force.*(main|master)"),), "block", None),
    ("no-skip-hooks", "hook", "Bash", (("command", "regex", r"--no-verify"),), "block", None),
    ("require-memory-impact", "hook", "Edit|Write", (), "block", "require-memory-impact"),
    ("require-detect-changes", "hook", "Bash", (), "block", "require-detect-changes"),
    ("no-git-add-ignored", "hook", "Bash", (), "block", "no-git-add-ignored"),
)


def default_rules() -> list[dict]:
    """DEFAULT_RULES as rule_gate() takes them, all enabled."""
    return [{"id": i, "enforcement": e, "matcher": m, "conditions": list(conditions), "action": a, "stateful": s, "enabled": True} for i, e, m, conditions, a, s in DEFAULT_RULES]


def rules_table(spark, rules: list[dict]) -> DataFrame:
    """Rules as rows (ord, id, enforcement, matcher, action, stateful, enabled)."""
    names = ("id", "enforcement", "matcher", "action", "stateful", "enabled")
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rules)], "ord long, id string, enforcement string, matcher string, action string, stateful string, enabled boolean")


def rule_layers(base: DataFrame, over: DataFrame) -> DataFrame:
    """The rules of `over` in the places of those of `base` with their ids, its others after them; of repeated ids of a layer the last of
    `over` and the first of `base` counts where `over` has it."""
    from skein.operators.relational import overlay

    first = base.groupBy("id").agg(F.min_by(F.struct(*[c(x) for x in base.columns if x != "id"]), "ord").alias("r")).select("r.*", "id").select(*base.columns)
    last = over.groupBy("id").agg(F.max_by(F.struct(*[c(x) for x in over.columns if x != "id"]), "ord").alias("r")).select("r.*", "id").select(*base.columns)
    return overlay(first, last, "id", "ord")


def rule_counters(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, enabled, disabled, hooks) of rules (keys, enabled, enforcement)."""
    count = lambda x, name: F.count_if(x).alias(name)
    return rules.groupBy(*keys).agg(F.count("*").alias("n"), count(c("enabled"), "enabled"), count(~c("enabled"), "disabled"), count(c("enforcement") == "hook", "hooks"))


def stateful_enabled(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(stateful, enabled) of each asked one: whether the first rule of that state is there and enabled."""
    first = rules.filter("stateful IS NOT NULL").groupBy("stateful").agg(F.min_by("enabled", "ord").alias("on"))
    return asked.join(first, "stateful", "left").select("stateful", F.coalesce("on", F.lit(False)).alias("enabled"))


def review_route(requested: Column, review: Column, conflict: Column, reason: Column, strict: Column, size: Column, room: Column) -> Column:
    """Where a new memory goes: staged if that is asked for, in review mode or against a trigger that is there; else rejected if the
    content policy has a reason against it and is strict, or the file has no room; else appended, with a warning or without."""
    return F.when(requested | review | conflict, "staged").when(reason.isNotNull() & strict, "rejected").when(size > room, "over_capacity").when(reason.isNotNull(), "appended_with_warning").otherwise("appended")


def addon_skip(addon: dict[str, Column], stack: Column, task: Column, role: Column) -> Column:
    """Why an addon (stacks, task_types, exclude_task_types, roles, exclude_roles: arrays, empty for any; gate: boolean) isn't used; null if it is."""
    none = lambda a: F.size(a) == 0
    return (
        F.when(~none(addon["stacks"]) & ~F.arrays_overlap(addon["stacks"], stack), "stack")
        .when(F.array_contains(addon["exclude_task_types"], task), "excluded_task_type")
        .when(~none(addon["task_types"]) & ~F.array_contains(addon["task_types"], task), "task_type")
        .when(F.array_contains(addon["exclude_roles"], role), "excluded_role")
        .when(~none(addon["roles"]) & ~F.array_contains(addon["roles"], role), "role")
        .when(~addon["gate"], "gate")
    )


def plan_violations(tasks: DataFrame, deps: DataFrame, most_tokens: int = 80_000) -> DataFrame:
    """(id, violation): one row for each constraint that a task breaks."""
    checks = F.array_compact(F.array(F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name_missing"), F.when(c("budget_tokens") > most_tokens, "budget_too_large"), F.when(c("budget_tokens") <= 0, "budget_not_positive"), F.when(~c("status").isin("pending", "running", "completed", "failed", "skipped"), "status_unknown")))
    own = tasks.select("id", F.explode(checks).alias("violation"))
    missing = deps.join(tasks.select(c("id").alias("dep")), "dep", "left_anti").select("id", F.concat(F.lit("dangling_dependency:"), "dep").alias("violation"))
    return own.unionByName(missing)
