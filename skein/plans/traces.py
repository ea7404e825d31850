"""Queries over traces of work: transcripts, tool calls, commands, budgets, rules, catalogs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import traces as X
from skein.operators import catalogs as C
from skein.operators import lifecycle as L
from skein.plans.registry import query

c = F.col


def picked(t, values: list[str], name: str = "text"):
    """Parts with the value that their key names."""
    return t.part.select("p_partkey", F.get(F.array(*[F.lit(v) for v in values]), (c("p_partkey") % len(values)).cast("int")).alias(name))


def _case(values: list, key: str = "p_partkey") -> str:
    quoted = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


@query("f18_noise", "SELECT p_partkey, concat(p_name, chr(10), chr(10), 'end') AS text FROM {part}")
def _(t):
    noisy = F.concat(F.lit("<system-reminder>a\nb</system-reminder>\n"), "p_name", F.lit("\nCURRENT TIME: 1\n\n \n> Ran 2 Stop hooks\n… +3 lines\n\nend [12 tokens] (ctrl+o to expand)\n<command-args>open\n"))
    return t.part.select("p_partkey", X.without_noise(noisy).alias("text"))


@query("c04_cut_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 60 THEN text ELSE substring(text, 1, list_max(list_filter(range(15, 61), lambda i: strlen(substring(text, 1, i)) <= 60))) END AS head FROM {documents}")
def _(t):
    return t.documents.select("doc_id", X.cut_bytes(c("text"), 60).alias("head"))


@query(
    "c12_fingerprints",
    """WITH s AS (SELECT p_partkey, concat(p_brand, '|', p_type, ',-v|', 'A', p_size, ',Z') AS x FROM {part})
    SELECT p_partkey, lower(lpad(hex(CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(x, ''), lambda b: CAST(ord(b) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT)), 16, '0')) AS fingerprint FROM s""",
)
def _(t):
    env = F.array(F.lit("Z"), F.concat(F.lit("A"), c("p_size").cast("string")))
    return t.part.select("p_partkey", X.fingerprint(c("p_brand"), F.array("p_type", F.lit("-v")), env).alias("fingerprint"))


@query(
    "c20_budgets",
    """WITH b AS (SELECT task_id, complexity, CASE complexity WHEN 'low' THEN 11500 WHEN 'medium' THEN 22500 ELSE 37500 END AS work, CASE complexity WHEN 'low' THEN 7 WHEN 'medium' THEN 20 ELSE 40 END * 800 AS calls, estimated % 5000 AS context, seq % 2 = 0 AS warm, seq % 7 AS samples FROM {usage}),
    s AS (SELECT *, work + calls + context + CASE WHEN warm THEN 450 ELSE 4500 END AS subtotal FROM b), m AS (SELECT *, subtotal + CAST(floor(subtotal * 0.15::DOUBLE) AS BIGINT) AS total FROM s)
    SELECT task_id, CAST(work AS BIGINT) AS work, CAST(calls AS BIGINT) AS calls, CAST(CASE WHEN samples >= 5 THEN floor(total * 1.25::DOUBLE) ELSE total END AS BIGINT) AS total FROM m""",
)
def _(t):
    parts = X.budget(c("complexity"), c("estimated") % 5000, c("seq") % 2 == 0, F.lit(1.25), c("seq") % 7)
    return t.usage.select("task_id", *[parts[k].alias(k) for k in ("work", "calls", "total")])


_SAID = ["wtf is this", "OK!!", "please fix this!!!", "WHY IS THIS STILL BROKEN NOW", "```\nwtf\n```\nfine", "calm words", "Bao nhiêu lần nữa", "wtfx", "a??!?", "enough now, BETA"]
_MOOD = ["wtf", None, "exclamation_run", "caps_ratio", None, None, "bao nhiêu lần", None, None, "config_pattern"]


@query("c21_frustration", f"SELECT p_partkey, {_case(_MOOD)} AS signal FROM {{part}}")
def _(t):
    return picked(t, _SAID).select("p_partkey", X.frustration(c("text"), ("beta",)).alias("signal"))


_COMMANDS = ["git log | head", "echo 'a | b; c'", "ls -la", 'echo "x; y > z" done', "a && b", "echo \\| x", "echo $(date)", "FOO=bar 'git' status", "echo \"open | quote", "cat < in", 'printf "%s\\" | x"']


@query("c27_commands", f"SELECT p_partkey, {_case([True, False, False, False, True, False, True, False, False, True, False])} AS composed, {_case(['git', 'echo', 'ls', 'echo', 'a', 'echo', 'echo', 'git', 'echo', 'cat', 'printf'])} AS name FROM {{part}}")
def _(t):
    return picked(t, _COMMANDS, "cmd").select("p_partkey", X.composed_command(c("cmd")).alias("composed"), X.command_name(c("cmd")).alias("name"))


_EVENTS = [
    ("file_changed", '{"path":"a/b.rs"}', "a/b.rs"), ("file_deleted", '{"path":"a/c.rs"}', "deleted a/c.rs"), ("query_issued", '{"text":"' + "q" * 90 + '"}', "query: " + "q" * 80),
    ("answer_returned", '{"chunk_ids":["a","b"],"synthesized":true}', "2 chunks, synth=true"), ("outcome_observed", '{"outcome":"test","suite":"unit","passed":false}', "test unit: FAIL"),
    ("outcome_observed", '{"outcome":"commit","sha":"0123456789","files":["x"]}', "commit 0123456 (1 files)"), ("outcome_observed", '{"outcome":"revert","sha":"abc"}', "revert abc"),
    ("outcome_observed", '{"outcome":"user_feedback","signal":"edit","note":"n"}', "feedback: edit — n"), ("outcome_observed", '{"outcome":"user_feedback","signal":"accept"}', "feedback: accept"),
    ("outcome_observed", '{"outcome":"error","summary":"broke"}', "error: broke"), ("nudge_invoked", '{"intent":"rest"}', "nudge: rest"),
]


@query("c29_event_summaries", f"SELECT p_partkey, {_case([e[2] for e in _EVENTS])} AS line FROM {{part}}")
def _(t):
    both = picked(t, [e[0] for e in _EVENTS], "kind").join(picked(t, [e[1] for e in _EVENTS], "payload"), "p_partkey")
    return both.select("p_partkey", X.event_line(c("kind"), c("payload")).alias("line"))


_GLOBS = ["src/*.rs", "*", "a?c", "[ab]x*", "[!ab]x", "**/x.rs", "[open", "a.b"]


@query(
    "c30_globs",
    f"""WITH v AS (SELECT p_partkey, {_case(['src/a/b.rs', 'abc', 'ax9', 'cx', 'x/y/x.rs', 'a.b', 'axb'])} AS value FROM {{part}})
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'src/*.rs,*' WHEN 1 THEN '*,a?c' WHEN 2 THEN '*,[ab]x*' WHEN 3 THEN '*,[!ab]x' WHEN 4 THEN '*,**/x.rs' WHEN 5 THEN '*,a.b' ELSE '*,[ab]x*' END AS matched FROM v""",
)
def _(t):
    values = picked(t, ["src/a/b.rs", "abc", "ax9", "cx", "x/y/x.rs", "a.b", "axb"], "value")
    return values.select("p_partkey", F.concat_ws(",", *[F.when(L.rule_holds(c("value"), "glob", g), F.lit(g)) for g in _GLOBS]).alias("matched"))


@query("c32_models", f"SELECT p_partkey, {_case(['opus-4-7', 'sonnet-4.5', 'gpt-5', 'haiku'])} AS short, {_case(['opus', 'haiku', 'opus', 'sonnet', 'sonnet'])} AS routed FROM {{part}}")
def _(t):
    named = picked(t, ["claude-opus-4-7", "Claude Sonnet 4.5", "GPT 5", "haiku"], "name")
    roles = picked(t, ["worker", "tester", "designer", "planner", "nobody"], "role").join(picked(t, ["quality", "budget", "unknown", "balanced", "minimal"], "profile"), "p_partkey")
    return named.join(roles, "p_partkey").select("p_partkey", X.short_model(c("name")).alias("short"), X.routed_model(c("profile"), c("role")).alias("routed"))


@query(
    "c36_frames",
    """WITH s AS (SELECT p_partkey, p_size / 1.5::DOUBLE AS d FROM {part}), i AS (SELECT *, CASE WHEN d <= 5 THEN 0.25 WHEN d <= 30 THEN 0.5 ELSE 1.0 END::DOUBLE AS interval FROM s), f AS (SELECT *, CAST(least(floor(d / interval), CASE WHEN d <= 5 THEN 20 ELSE 40 END) AS BIGINT) AS frames FROM i)
    SELECT p_partkey, interval, frames, CAST(CASE WHEN frames <= 12 THEN 4 ELSE 5 END AS BIGINT) AS columns, CAST(ceil(frames / CASE WHEN frames <= 12 THEN 4 ELSE 5 END) AS BIGINT) AS rows, CASE WHEN p_size > 10 THEN floor(p_size * 0.6::DOUBLE + 102) ELSE floor(p_size * 0.7::DOUBLE) END::INTEGER AS red FROM f JOIN {part} USING (p_partkey)""",
)
def _(t):
    pixel = lambda r, g, b: F.array(F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b")))
    size = c("p_size")
    overlay = X.pixel_overlay(pixel(size, size, size), pixel(size * 2, size * 2, size * 2))  # they differ by three times the size
    return t.part.select("p_partkey", *[v.alias(k) for k, v in X.frame_interval(size / F.lit(1.5)).items()], F.get(overlay, F.lit(0))["r"].alias("red"))


def transcript_lines(t):
    """Conversations as lines of both wire formats, with what is no conversation between."""
    turn = t.conversations.select(c("conv_id").cast("string").alias("session_id"), (c("turn") * 4).cast("long").alias("line_no"), "role", c("text").alias("said"), (c("conv_id") % 2 == 0).alias("plain"))
    block = F.array(F.struct(F.lit("text").alias("type"), c("said").alias("text")), F.struct(F.lit("tool_use").alias("type"), c("said").alias("text")))
    plain = F.to_json(F.struct(c("role").alias("type"), F.struct(block.alias("content")).alias("message")))
    rollout = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.when(c("role") == "user", "input_text").otherwise("output_text").alias("type"), c("said").alias("text"))).alias("content")).alias("payload")))
    lines = turn.select("session_id", "line_no", F.when(c("plain"), plain).otherwise(rollout).alias("line"))
    call = turn.filter("role = 'assistant'").select("session_id", (c("line_no") + 1).alias("line_no"), F.when(c("plain"), F.lit('{"type":"assistant","message":{"content":[{"type":"tool_use","id":"t","name":"Bash","input":{"command":"ls"}}]}}')).otherwise(F.lit('{"type":"response_item","payload":{"type":"function_call","name":"ls","arguments":"{}"}}')).alias("line"))
    result = turn.filter("role = 'assistant'").select("session_id", (c("line_no") + 2).alias("line_no"), F.when(c("plain"), F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t","content":"out"}]}}')).otherwise(F.lit('{"type":"response_item","payload":{"type":"function_call_output","output":"out"}}')).alias("line"))
    noise = turn.select("session_id", (c("line_no") + 3).alias("line_no"), F.lit('{"type":"summary","broken').alias("line"))
    return lines.unionByName(call).unionByName(result).unionByName(noise)


@query(
    "s08_transcript_lines",
    """WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn, role, text, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'assistant' THEN 0 ELSE 1 END AS new FROM {conversations} WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM m)
    SELECT session_id, CAST(n AS BIGINT) AS turn, role, CAST(sum(CASE WHEN role = 'assistant' THEN 3 ELSE 1 END) AS INTEGER) AS n_lines, CAST(sum(length(regexp_replace(text, '\\s', '', 'g')) + CASE WHEN role = 'user' THEN 0 WHEN conv_id % 2 = 0 THEN 12 ELSE 11 END) AS BIGINT) AS chars FROM i GROUP BY session_id, n, role""",
)
def _(t):
    turns = X.transcript_turns(transcript_lines(t))
    return turns.select("session_id", "turn", "role", "n_lines", F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("chars"))


@query("s28_usage_lines", "SELECT session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS output_tokens, count(*) AS n FROM {turn_usage} GROUP BY session_id")
def _(t):
    usage = F.struct(c("input_tokens"), c("cache_read_tokens").alias("cache_read_input_tokens"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct("model", usage.alias("usage")).alias("message")))
    bad = t.turn_usage.select("session_id", "seq", F.lit('{"type":"assistant","message":{"usage":7}}').alias("line")).unionByName(t.turn_usage.select("session_id", "seq", F.lit("{nothing").alias("line")))
    lines = t.turn_usage.select("session_id", "seq", line.alias("line")).unionByName(bad).withColumnRenamed("seq", "line_no")
    total = lambda x: F.sum(x).alias(x)
    return X.usage_lines(lines).groupBy("session_id").agg(total("input_tokens"), total("cache_read_tokens"), total("output_tokens"), F.count("*").alias("n"))


# rules


_CALLS = ["git stash pop", "git add -f x", "git push origin --force main", "git commit --no-verify", "git add .", "ls"]
_DECIDED = ["no-git-stash", "no-git-add-force", "no-force-push-main", "no-skip-hooks", "warn-git-add-all", None]


@query("e04_default_rules", f"SELECT p_partkey, {_case(['block', 'block', 'block', 'block', 'warn', 'allow'])} AS decision, {_case(_DECIDED)} AS rule FROM {{part}}")
def _(t):
    calls = picked(t, _CALLS, "command").withColumns({"tool": F.lit("Bash"), "file_path": F.lit(None).cast("string"), "new_string": F.lit(None).cast("string")})
    return L.rule_gate(calls, L.default_rules(), "p_partkey", "tool")


_RULES = """SELECT p_brand AS project, p_partkey AS ord, concat('rule-', p_size) AS id, CASE WHEN p_size % 3 = 0 THEN 'prompt' ELSE 'hook' END AS enforcement, p_partkey % 4 <> 0 AS enabled,
    CASE WHEN p_size % 7 > 0 THEN concat(p_brand, '/', p_size % 7) END AS stateful FROM {part}"""


@query("a23_rule_counters", f"WITH r AS ({_RULES}) SELECT project, count(*) AS n, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled, count(*) FILTER (enforcement = 'hook') AS hooks FROM r GROUP BY project")
def _(t):
    """Counters of the rules of each project; parts stand for rules."""
    return L.rule_counters(t.spark.sql(_RULES, part=t.part), ["project"])


@query(
    "f09_stateful_rules",
    f"""WITH r AS ({_RULES}), q AS (SELECT DISTINCT concat(p_brand, '/', p_size % 8) AS stateful FROM {{part}}), s AS (SELECT stateful, arg_min(enabled, ord) AS enabled FROM r WHERE stateful IS NOT NULL GROUP BY stateful)
    SELECT q.stateful, coalesce(enabled, false) AS enabled FROM q LEFT JOIN s USING (stateful)""",
)
def _(t):
    asked = t.part.select(F.concat("p_brand", F.lit("/"), c("p_size") % 8).alias("stateful")).distinct()
    return L.stateful_enabled(t.spark.sql(_RULES, part=t.part), asked)


@query(
    "u07_rule_layers",
    """WITH g AS (SELECT concat('r', n_nationkey) AS id, n_name AS action, n_nationkey AS ord FROM {nation} WHERE n_nationkey < 15), p AS (SELECT concat('r', n_nationkey) AS id, concat('own ', n_name) AS action, n_nationkey AS ord FROM {nation} WHERE n_nationkey % 2 = 0)
    SELECT coalesce(p.id, g.id) AS id, coalesce(p.action, g.action) AS action, CAST(CASE WHEN g.ord IS NULL THEN p.ord + 1099511627776 ELSE g.ord END AS BIGINT) AS ord FROM g FULL JOIN p ON p.id = g.id""",
)
def _(t):
    layer = lambda d, text: d.select(F.concat(F.lit("r"), "n_nationkey").alias("id"), text.alias("action"), c("n_nationkey").cast("long").alias("ord"))
    own = layer(t.nation.filter("n_nationkey % 2 = 0"), F.concat(F.lit("own "), "n_name"))
    stale = own.withColumns({"action": F.lit("stale"), "ord": c("ord") - 100})  # an id repeated in a layer: its last rule counts
    return L.rule_layers(layer(t.nation.filter("n_nationkey < 15"), c("n_name")), own.unionByName(stale))


@query(
    "p06_review_routes",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_type = 'error' OR user_id % 9 = 0 THEN 'staged' WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'rejected' WHEN value > 90 THEN 'over_capacity' WHEN event_id % 7 = 0 THEN 'appended_with_warning' ELSE 'appended' END AS route FROM {events}""",
)
def _(t):
    reason = F.when(c("event_id") % 7 == 0, "path_only")
    return t.events.select("event_id", L.review_route(c("event_id") % 11 == 0, c("event_type") == "error", c("user_id") % 9 == 0, reason, c("event_id") % 2 == 0, c("value"), F.lit(90)).alias("route"))


@query(
    "f19_addons",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'stack' WHEN p_size % 5 = 0 THEN 'excluded_task_type' WHEN p_size % 5 = 1 THEN 'task_type' WHEN p_size % 7 = 0 THEN 'role' WHEN p_partkey % 4 = 0 THEN 'gate' END AS skipped FROM {part}""",
)
def _(t):
    text = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    addon = {
        "stacks": F.when(c("p_partkey") % 3 == 0, text("go")).otherwise(F.when(c("p_partkey") % 3 == 1, text("rust", "go")).otherwise(text())), "exclude_task_types": F.when(c("p_size") % 5 == 0, text("fix")).otherwise(text()),
        "task_types": F.when(c("p_size") % 5 == 1, text("build")).otherwise(text()), "exclude_roles": text(), "roles": F.when(c("p_size") % 7 == 0, text("tester")).otherwise(text("worker")), "gate": c("p_partkey") % 4 != 0,
    }
    return t.part.select("p_partkey", L.addon_skip(addon, text("rust"), F.lit("fix"), F.lit("worker")).alias("skipped"))


# catalogs, logs and state


@query(
    "k30_registry",
    """WITH o AS (SELECT concat('p', c_custkey) AS slug, c_name AS name, CAST(c_custkey AS BIGINT) AS last_used FROM {customer} WHERE c_custkey % 2 = 0), n AS (SELECT concat('p', o_custkey) AS slug, max(CAST(o_orderkey AS BIGINT)) + 1000000 AS last_used FROM {orders} GROUP BY 1)
    SELECT coalesce(o.slug, n.slug) AS slug, coalesce(o.name, concat('name of ', n.slug)) AS name, coalesce(n.last_used, o.last_used) AS last_used FROM o FULL JOIN n ON n.slug = o.slug WHERE coalesce(o.slug, n.slug) <> 'p4'""",
)
def _(t):
    have = t.customer.filter("c_custkey % 2 = 0").select(F.concat(F.lit("p"), "c_custkey").alias("slug"), c("c_name").alias("name"), c("c_custkey").cast("long").alias("last_used"))
    seen = t.orders.select(F.concat(F.lit("p"), "o_custkey").alias("slug"), F.concat(F.lit("name of p"), "o_custkey").alias("name"), (c("o_orderkey").cast("long") + 1_000_000).alias("last_used"))
    return C.removed(C.registered(have, seen), ["p4"])


@query("t09_recent_first", "SELECT slug, CAST(row_number() OVER (ORDER BY last_used DESC, slug) AS BIGINT) AS place FROM (SELECT concat('p', o_custkey) AS slug, max(o_orderkey) AS last_used FROM {orders} GROUP BY 1) ORDER BY last_used DESC, slug LIMIT 20")
def _(t):
    seen = t.orders.groupBy(F.concat(F.lit("p"), "o_custkey").alias("slug")).agg(F.max("o_orderkey").alias("last_used"))
    return C.recent_first(seen, "last_used", "slug", 20)


@query("t04_capped_then_named", "SELECT CAST(row_number() OVER (ORDER BY project, session) AS BIGINT) AS place, project, session FROM (SELECT o_custkey % 7 AS project, o_orderkey AS session FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)")
def _(t):
    files = t.orders.select((c("o_custkey") % 7).alias("project"), c("o_orderkey").alias("session"), c("o_orderdate").alias("mtime"))
    return C.newest_then_named(files, "mtime", "session", ["project", "session"], 50)


@query(
    "x04_ingest_state",
    """WITH k AS (SELECT doc_id, md5(text) AS hash FROM {documents} WHERE doc_id % 3 = 0), s AS (SELECT doc_id, md5(CASE WHEN doc_id % 6 = 0 THEN concat(text, 'x') ELSE text END) AS hash FROM {documents})
    SELECT s.doc_id, CASE WHEN k.doc_id IS NULL THEN 'new' WHEN k.hash = s.hash THEN 'same' ELSE 'changed' END AS action FROM s LEFT JOIN k ON k.doc_id = s.doc_id""",
)
def _(t):
    known = t.documents.filter("doc_id % 3 = 0").select("doc_id", F.md5(c("text").cast("binary")).alias("hash"))
    seen = t.documents.select("doc_id", F.md5(F.when(c("doc_id") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(c("text")).cast("binary")).alias("hash"))
    return C.ingest_actions(known, seen, "doc_id", "hash")


@query(
    "k17_purge_modes",
    """WITH s AS (SELECT c_custkey AS id, c_acctbal AS ts, c_nationkey % 2 AS curated FROM {customer})
    SELECT 'age' AS mode, id, 'removed' AS state FROM s WHERE ts < 1000 UNION ALL SELECT 'age', id, 'kept' FROM s WHERE ts >= 1000 UNION ALL SELECT 'all', id, 'removed' FROM s UNION ALL SELECT 'one', id, CASE WHEN id = 7 THEN 'removed' ELSE 'kept' END FROM s
    UNION ALL SELECT 'curate', id, CASE WHEN id = 7 OR curated = 1 THEN 'curated' ELSE 'kept' END FROM s""",
)
def _(t):
    sessions = t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("at"), (c("c_nationkey") % 2).alias("curated"))
    out = None
    for mode, argument in (("age", 1000), ("all", None), ("one", 7), ("curate", 7)):
        one = C.purged(sessions, mode, argument).select(F.lit(mode).alias("mode"), "id", "state")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s26_lookups",
    """WITH s AS (SELECT c_custkey AS id, c_acctbal AS ts, c_nationkey % 2 AS curated FROM {customer}) SELECT 'older' AS lookup, id FROM s WHERE ts < 500 UNION ALL SELECT 'uncurated', id FROM s WHERE curated = 0 UNION ALL (SELECT 'oldest', id FROM s ORDER BY ts, id LIMIT 9)""",
)
def _(t):
    sessions = t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("at"), (c("c_nationkey") % 2).alias("curated"))
    name = lambda d, n: d.select(F.lit(n).alias("lookup"), "id")
    return name(C.older_than(sessions, 500), "older").unionByName(name(C.uncurated(sessions), "uncurated")).unionByName(name(C.oldest(sessions, 9), "oldest"))


@query("a20_ingest_stats", "SELECT source, count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, count(*) FILTER (text IS NULL OR text = '') AS empty FROM {documents} GROUP BY source")
def _(t):
    return C.ingest_stats(t.documents, "source", "text")


@query("u03_jaccard", "SELECT a.o_custkey AS customer, CAST(len(list_intersect(a.p, b.p)) AS DOUBLE) / len(list_distinct(list_concat(a.p, b.p))) AS similarity FROM (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p FROM {orders} GROUP BY 1) a, (SELECT list_distinct(list(o_orderpriority)) AS p FROM {orders} WHERE o_orderpriority < '3') b")
def _(t):
    from skein.functions.text import jaccard

    asked = F.array(*[F.lit(r.o_orderpriority) for r in t.orders.filter("o_orderpriority < '3'").select("o_orderpriority").distinct().collect()])  # five priorities at most
    return t.orders.groupBy(c("o_custkey").alias("customer")).agg(F.collect_set("o_orderpriority").alias("p")).select("customer", jaccard(c("p"), asked).alias("similarity"))


@query(
    "u05_registry_diff",
    """WITH b AS (SELECT c_custkey AS k FROM {customer}), a AS (SELECT DISTINCT o_custkey + 7 AS k FROM {orders})
    SELECT k AS slug, 'removed' AS change FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'added' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def _(t):
    return C.two_way_diff(t.customer.select(c("c_custkey").alias("slug")), t.orders.select((c("o_custkey") + 7).alias("slug")), "slug")


@query("t06_sorted", "SELECT CAST(row_number() OVER (ORDER BY n DESC, path) AS BIGINT) AS place, path, n FROM (SELECT path, count(*) AS n FROM {nodes} GROUP BY path)")
def _(t):
    return C.placed(t.nodes.groupBy("path").agg(F.count("*").alias("n")), [c("n").desc(), c("path")])


@query("f21_record_projection", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END AS n_files FROM {events} WHERE event_type <> 'error'")
def _(t):
    files = F.when(c("event_id") % 4 == 0, F.lit('["open')).otherwise(F.lit('["a.rs","b.rs"]'))
    rows = t.events.select("event_id", c("event_type").alias("kind"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), files.alias("files"))).alias("payload"))
    kinds = [r.kind for r in rows.select("kind").distinct().collect() if r.kind != "error"]  # kinds are a handful
    return C.projected(rows, kinds).select("event_id", "k", F.size("files").alias("n_files"))


@query("j09_uncovered_symbols", "WITH e AS (SELECT DISTINCT concat('sym', p_partkey) AS s FROM {part}), i AS (SELECT DISTINCT concat('mod::sym', s_suppkey) AS s FROM {supplier}) SELECT s AS symbol FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE split_part(i.s, '::', -1) = e.s)")
def _(t):
    edited = t.part.select(F.concat(F.lit("sym"), "p_partkey").alias("symbol"))
    return C.uncovered_symbols(edited, t.supplier.select(F.concat(F.lit("mod::sym"), "s_suppkey").alias("symbol")))


@query("k25_guarded_append", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'rejected' WHEN p_size > 40 THEN 'over_capacity' ELSE 'appended' END AS outcome FROM {part}")
def _(t):
    from skein.functions.text import content_policy

    text = F.when(c("p_partkey") % 3 == 0, "0123abcdef").otherwise(F.concat(F.lit("use "), "p_name", F.lit(" because it works")))
    rows, no = t.part.select("p_partkey", "p_size", text.alias("text")), F.lit(False)
    return rows.select("p_partkey", L.review_route(no, no, no, content_policy(c("text")), F.lit(True), c("p_size"), F.lit(40)).alias("outcome"))


@query("k31_migration", "SELECT event_id, 1.0::DOUBLE AS salience, CAST(0 AS BIGINT) AS access_count FROM {events}")
def _(t):
    old = t.events.select("event_id")
    return C.migrated(old, {"salience": ("double", 1.0), "access_count": ("long", 0)}, version=1, newest=2)


@query("k10_event_append", "SELECT CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) + 100 AS id, event_type AS kind FROM {events}")
def _(t):
    return C.appended(t.events.select("event_id", c("event_type").alias("kind")), "event_id", 100).select("id", "kind")
