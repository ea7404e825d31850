"""What a plan must hold: fields, values, absolute paths, a budget that its tasks add up to, and dependencies that exist and end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import cyclic
from skein.operators.lines import bound
from skein.sources.storage import written

c = F.col
# Fields of plans and tasks, the grades of complexity, the largest budget of a task, and the fields of its cases.
PLAN_FIELDS = ("name", "workspace_dir", "budget_tokens", "tasks")
TASK_FIELDS = ("id", "name", "complexity", "budget_tokens", "files", "depends_on", "context_pointers", "acceptance")
COMPLEXITIES = ("low", "medium", "high")
TASK_BUDGET = 80_000
CASE_FIELDS = {"test_cases": ("name", "expected", "verify"), "edge_cases": ("case", "input", "expected")}
#: Share of the declared budget by which the tasks' sum may miss it.
BUDGET_SLACK = 0.1
TASK_TYPE = """struct<id: string, name: string, complexity: string, budget_tokens: bigint, files: array<string>, depends_on: array<string>,
 context_pointers: array<string>, acceptance: string, test_cases: array<struct<name: string, expected: string, verify: string>>,
 edge_cases: array<struct<case: string, input: string, expected: string>>, ui: boolean, type: string>"""


def _when(cond: Column, severity: str, finding: Column | str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), (F.lit(finding) if isinstance(finding, str) else finding).alias("finding")))


def _absolute(path: Column) -> Column:
    return path.startswith("/")


def _of_each(items: Column, keep, finding) -> Column:
    """Findings of the items of an array that `keep` picks; none of a null array."""
    return F.coalesce(F.transform(F.filter(items, keep), finding), F.expr("CAST(array() AS array<struct<severity: string, finding: string>>)"))


def _note(severity: str, *parts: Column | str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("finding"))


def _case_checks(name: str, keys: tuple[str, ...]) -> Column:
    """A finding for each field of each case that is null or blank, with the case's number from 0."""
    empty = lambda x: F.coalesce(~F.rlike(x, F.lit(r"\S")), F.lit(True))
    each = F.transform(c(f"t.{name}"), lambda x, i: F.array_compact(F.array(*[F.when(empty(x[k]), _note("error", f"{name}[", i.cast("string"), f"]_missing:{k}")) for k in keys])))
    return F.coalesce(F.flatten(each), F.expr("CAST(array() AS array<struct<severity: string, finding: string>>)"))


#: A plan of up to so many dependencies is trimmed where it lies, in so many rounds.
SMALL, ROUNDS = 64, 4


def _may_loop(tasks: Column) -> Column:
    """Dependencies (task, dep) of a plan's tasks, without those of which an end has nothing before it or nothing behind it: they lie in no cycle."""
    each = F.flatten(F.transform(tasks, lambda t: F.transform(F.filter(F.coalesce(t["depends_on"], F.array().cast("array<string>")), lambda d: d.isNotNull()), lambda d: F.struct(F.coalesce(t["id"], F.lit("?")).alias("task"), d.alias("dep")))))
    inner = lambda es: bound(F.array_intersect(es["task"], es["dep"]), lambda core: F.filter(es, lambda e: F.array_contains(core, e["task"]) & F.array_contains(core, e["dep"])))
    return bound(each, lambda es: F.when(F.size(es) <= SMALL, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), es, lambda left, _: inner(left))).otherwise(es))


def plan_findings(plans: DataFrame, key: str) -> DataFrame:
    """(key, task, severity, finding) of what plans (key, name, workspace_dir, budget_tokens, tasks array of TASK_TYPE) break.

    A null is a field that is missing; `task` is null for what concerns the plan as a whole and `?` for a task without an id. Errors make a
    plan invalid, warnings don't. Tasks are exploded and checked row by row, so a plan with very many of them is many rows; only their
    dependencies meet, by plan and id: an id's missing dependencies are given once each, and so is its cycle. Plans without a key aren't told apart.
    """
    none = F.lit(None).cast("string")
    own = [_when(c(f).isNull(), "error", f"missing:{f}") for f in PLAN_FIELDS]
    own += [_when(F.size("tasks") == 0, "error", "tasks_empty"), _when(~_absolute(c("workspace_dir")), "error", "workspace_not_absolute")]
    total = F.aggregate("tasks", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["budget_tokens"], F.lit(0)))
    off = (c("budget_tokens") > 0) & (F.abs((total - c("budget_tokens")) / c("budget_tokens")) > BUDGET_SLACK)
    own.append(_when(off & c("tasks").isNotNull(), "warning", F.concat(F.lit("budget_mismatch:"), c("budget_tokens").cast("string"), F.lit(":"), total.cast("string"))))
    whole = plans.select(key, none.alias("task"), F.inline(F.array_compact(F.array(*own))))

    tasks = plans.select(key, F.explode("tasks").alias("t"))
    single = [_when(c(f"t.{f}").isNull(), "error", f"missing:{f}") for f in TASK_FIELDS]
    single += [
        _when(~c("t.complexity").isin(*COMPLEXITIES), "error", "complexity_unknown"),
        _when(c("t.budget_tokens") > TASK_BUDGET, "warning", F.concat(F.lit("budget_too_large:"), c("t.budget_tokens").cast("string"))),
        _when(c("t.files").isNull() | (F.size("t.files") == 0), "error", "files_empty"),
        # runnable commands begin with a small letter
        _when(F.rlike("t.acceptance", F.lit(r"\S")) & ~F.rlike("t.acceptance", F.lit(r"^\s*[a-z]")), "warning", "acceptance_not_runnable"),
        *[_when(c(f"t.{f}").isNull(), "warning", f"missing:{f}") for f in (*CASE_FIELDS, "type")],
    ]
    lists = [
        _of_each(c("t.files"), lambda f: ~_absolute(f), lambda f: _note("error", "file_not_absolute:", f)),
        _of_each(c("t.context_pointers"), lambda p: (p != "") & ~_absolute(F.substring_index(p, ":", 1)), lambda p: _note("warning", "pointer_not_absolute:", p)),
        *[_case_checks(f, keys) for f, keys in CASE_FIELDS.items()],
    ]
    by_task = tasks.select(key, F.coalesce("t.id", F.lit("?")).alias("task"), F.inline(F.concat(F.array_compact(F.array(*single)), *lists)))

    ids = written(tasks.select(key, F.coalesce("t.id", F.lit("?")).alias("task"), c("t.depends_on").alias("deps")), "plan_tasks")
    deps = ids.select(key, "task", F.explode("deps").alias("dep")).filter("dep IS NOT NULL").distinct()
    dangling = deps.join(ids.select(key, c("task").alias("dep")), [key, "dep"], "left_anti").select(key, "task", F.lit("error").alias("severity"), F.concat(F.lit("dangling:"), "dep").alias("finding"))
    at = lambda name: F.to_json(F.struct(c(key).cast("string").alias("k"), c(name).alias("t")))
    # a cycle lies within a plan, which is one row unless its key comes again
    again = plans.groupBy(key).agg(F.count("*").alias("n")).filter((c("n") > 1) | c(key).isNull())
    inside = deps if not again.isEmpty() else plans.select(key, F.inline(_may_loop(c("tasks")))).distinct()
    inside = written(inside.select(key, "task", "dep"), "plan_loops")
    looped = cyclic(inside.select(at("task").alias("id"), at("dep").alias("dep")))
    named = inside.select(key, "task").distinct().withColumn("id", at("task")).join(looped, "id", "left_semi")
    return whole.unionByName(by_task).unionByName(dangling).unionByName(named.select(key, "task", F.lit("error").alias("severity"), F.lit("cycle").alias("finding")))
