"""Expressions over traces of work: noise, tool calls, moods, commands, budgets, events."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.storage import written

c = F.col
# Elements that a client wraps round what isn't conversation.
NOISE_TAGS = ("system-reminder", "command-message", "command-name", "task-notification", "user-prompt-submit-hook", "hook_output", "local-command-caveat", "local-command-stdout", "command-args")
# How lines of noise begin.
NOISE_PREFIXES = (
    "CURRENT TIME:", "VERIFIED FACTS (do not contradict)", "AGENT SPECIALIZATION:", "Checking verified facts...", "Injecting timestamp...",
    "Starting background pipeline...", "Checking emotional weights...", "Auto-save reminder...", "Checking pipeline...",
)
# How messages begin that a client puts in by itself.
INJECTED = ("<user_instructions>", "<environment_context>", "<permissions", "<turn_context", "<AGENTS.md")
# Words of frustration, Vietnamese and English.
FRUSTRATION = (
    "đm", "vcl", "vãi", "ngu thế", "óc", "đã bảo", "bao nhiêu lần", "lại nữa", "sao mày", "mày bị", "bực", "phẫn nộ",
    "wtf", "ffs", "fucking", "stupid", "i told you", "how many times", "stop doing", "again?!",
)
# The parts of a budget, in tokens; work and calls of a task by complexity (least, most).
OVERHEAD = {"base_rules": 2500, "addon": 300, "tool": 150, "envelope": 500, "call": 800}
WARM, MARGIN, SAMPLES = 0.1, 0.15, 5
COMPLEXITY = {"low": ((8000, 15000), (5, 10)), "medium": ((15000, 30000), (15, 25)), "high": ((30000, 45000), (30, 50))}
# The model of each role, by profile.
ROLES = ("researcher", "designer", "planner", "orchestrator", "worker", "reviewer", "tester", "committer")
PROFILES = {
    "quality": ("opus", "opus", "opus", "opus", "opus", "opus", "sonnet", "sonnet"),
    "balanced": ("sonnet", "opus", "sonnet", "opus", "sonnet", "sonnet", "haiku", "haiku"),
    "budget": ("haiku", "sonnet", "haiku", "haiku", "haiku", "haiku", "haiku", "haiku"),
    "minimal": ("haiku", "sonnet", "haiku", "sonnet", "haiku", "haiku", "haiku", "haiku"),
}


def without_noise(text: Column) -> Column:
    """A message without wrapped elements, hook reports, known noise lines and folded output; runs of blank lines become one."""
    out = text
    for tag in NOISE_TAGS:  # an element that isn't closed goes to the end of its line
        out = F.regexp_replace(out, rf"(?s)<{tag}.*?</{tag}>\n?|<{tag}[^\n]*\n?", "")
    bare = lambda x: F.regexp_replace(F.trim(x), "^(?:> )+", "")
    hook = lambda x: F.rlike(bare(x), F.lit(r"^Ran .* hooks?$"))
    known = lambda x: F.exists(F.array(*[F.lit(p) for p in NOISE_PREFIXES]), lambda p: F.startswith(bare(x), p))
    folded = lambda x: F.startswith(F.trim(x), F.lit("…")) & F.contains(x, F.lit("lines"))
    lines = F.filter(F.split(out, "\n"), lambda x: ~(hook(x) | known(x) | folded(x)))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"\[[^\[\]\n]*tokens[^\[\]\n]*\] ?\(ctrl\+o to expand\)", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n(?:[ \t]*\n){2,}", "\n\n"), r"^\s+|\s+$", "")


def cut_bytes(text: Column, most: int) -> Column:
    """The longest head of `most` bytes at most that splits no character."""
    # a character has four bytes at most, so the head has most / 4 characters or more: the rest is tried one by one
    sizes = F.sequence(F.lit(most // 4), F.lit(most))
    fits = F.array_max(F.filter(sizes, lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most))
    return F.when(F.octet_length(text) <= most, text).when(F.octet_length(text) == F.length(text), F.substring(text, 1, most)).otherwise(F.substring(text, F.lit(1), fits))


def cut(text: str, most: int) -> str:
    return text.encode()[:most].decode(errors="ignore")


def frustration(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Why a prompt sounds frustrated, outside fenced code: a word of the lexicon, a pattern of one's own, a run of three ! or ?, capitals; null if it doesn't."""
    spoken = F.regexp_replace(text, r"(?sm)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)", "")
    low = F.lower(spoken)
    out = None
    for word in FRUSTRATION:
        bare = " " not in word and word.isalpha()
        hit = low.rlike(rf"(?<![a-z0-9]){word}(?![a-z0-9])") if bare else low.contains(word)
        out = F.when(hit, word) if out is None else out.when(hit, word)
    for pattern in filter(None, extra):
        out = out.when(low.contains(pattern.lower()), "config_pattern")
    letters = F.length(F.regexp_replace(spoken, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(spoken, r"[^\p{Lu}]", ""))
    out = out.when((letters >= 5) & spoken.rlike(r"!!!|\?\?\?"), "exclamation_run")
    return out.when((letters >= 20) & (capitals > 0.6 * letters), "caps_ratio")


def composed_command(command: Column) -> Column:
    """Whether a shell command is more than one: a pipe, redirection, list or substitution outside quotes."""
    # quotes hide what they hold; a backslash hides the next sign outside single quotes
    seen = F.regexp_replace(command, r"""(?s)'[^']*(?:'|\z)|"(?:\\.|[^"\\])*(?:"|\\?\z)|\\.""", "")
    return seen.rlike(r"[|><;`&]|\$\(")


def command_name(command: Column) -> Column:
    """The first word that is no assignment, without quotes."""
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda w: (w != "") & ~F.rlike(w, F.lit("^[A-Z_][^=]*=")))
    return F.regexp_replace(F.get(words, F.lit(0)), "^[\"']+|[\"']+$", "")


def short_model(name: Column) -> Column:
    """A model's name in lower case, without its maker, with dashes for spaces."""
    return F.replace(F.trim(F.regexp_replace(F.lower(name), "^claude[- ]", "")), F.lit(" "), F.lit("-"))


def routed_model(profile: Column, role: Column) -> Column:
    """The model that a profile gives a role; an unknown profile is as `balanced`, an unknown role gets the default."""
    table = F.from_json(F.lit(json.dumps({f"{p} {r}": m for p, ms in PROFILES.items() for r, m in zip(ROLES, ms)})), "map<string,string>")
    of = lambda p: F.try_element_at(table, F.concat_ws(" ", p, role))
    return F.coalesce(of(profile), of(F.lit("balanced")), F.lit("sonnet"))


def budget(complexity: Column, context: Column, warm: Column, factor: Column, samples: Column, addons: Column | None = None, tools: Column | None = None) -> dict[str, Column]:
    """Tokens of a task: work, system prompt (a tenth of it counts where the cache is warm), calls, margin and total, calibrated
    where there are five samples or more."""
    of = lambda i: F.when(complexity == "low", sum(COMPLEXITY["low"][i]) // 2).when(complexity == "medium", sum(COMPLEXITY["medium"][i]) // 2).otherwise(sum(COMPLEXITY["high"][i]) // 2).cast("long")
    prompt = F.lit(OVERHEAD["base_rules"] + OVERHEAD["envelope"]) + (addons if addons is not None else F.lit(0)) * OVERHEAD["addon"] + (tools if tools is not None else F.lit(10)) * OVERHEAD["tool"]
    effective = F.when(warm, F.floor(prompt * WARM)).otherwise(prompt).cast("long")
    work, calls = of(0), of(1) * OVERHEAD["call"]
    subtotal = work + effective + context + calls
    margin = F.floor(subtotal * MARGIN).cast("long")
    total = F.when(samples >= SAMPLES, F.floor((subtotal + margin) * factor)).otherwise(subtotal + margin).cast("long")
    return {"work": work, "prompt": effective, "calls": calls, "margin": margin, "total": total}


def event_line(kind: Column, payload: Column) -> Column:
    """One line of what an event (kind, JSON payload) says."""
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    size = lambda k: F.coalesce(F.json_array_length(get(k)), F.lit(0))
    outcome = (
        F.when(get("outcome") == "test", F.concat(F.lit("test "), get("suite"), F.lit(": "), F.when(get("passed") == "true", "pass").otherwise("FAIL")))
        .when(get("outcome") == "commit", F.concat(F.lit("commit "), F.substring(get("sha"), 1, 7), F.lit(" ("), size("files"), F.lit(" files)")))
        .when(get("outcome") == "revert", F.concat(F.lit("revert "), F.substring(get("sha"), 1, 7)))
        .when(get("outcome") == "user_feedback", F.concat(F.lit("feedback: "), get("signal"), F.coalesce(F.concat(F.lit(" — "), get("note")), F.lit(""))))
        .when(get("outcome") == "error", F.concat(F.lit("error: "), get("summary")))
    )
    return (
        F.when(kind == "file_changed", get("path"))
        .when(kind == "file_deleted", F.concat(F.lit("deleted "), get("path")))
        .when(kind == "query_issued", F.concat(F.lit("query: "), F.substring(get("text"), 1, 80)))
        .when(kind == "answer_returned", F.concat(size("chunk_ids").cast("string"), F.lit(" chunks, synth="), F.coalesce(get("synthesized"), F.lit("false"))))
        .when(kind == "outcome_observed", outcome)
        .when(kind == "nudge_invoked", F.concat(F.lit("nudge: "), get("intent")))
    )


def frame_interval(seconds: Column) -> dict[str, Column]:
    """Seconds between frames of a clip, how many frames, and the columns and rows of their grid."""
    interval = F.when(seconds <= 5, 0.25).when(seconds <= 30, 0.5).otherwise(1.0)
    frames = F.least(F.floor(seconds / interval), F.when(seconds <= 5, 20).otherwise(40)).cast("long")
    columns = F.when(frames <= 12, 4).otherwise(5).cast("long")
    return {"interval": interval, "frames": frames, "columns": columns, "rows": F.ceil(frames / columns)}


def pixel_overlay(a: Column, b: Column) -> Column:
    """The pixels (r, g, b) of an image, dimmed, and red where they differ from those of another by more than 30 in all."""

    def one(x: Column, y: Column) -> Column:
        far = F.abs(x["r"] - y["r"]) + F.abs(x["g"] - y["g"]) + F.abs(x["b"] - y["b"]) > 30
        tint = lambda v, red: F.when(far, F.floor(v * 0.6 + (255 * 0.4 if red else 0.0))).otherwise(F.floor(v * 0.7)).cast("int")
        return F.struct(tint(x["r"], True).alias("r"), tint(x["g"], False).alias("g"), tint(x["b"], False).alias("b"))

    return F.zip_with(a, b, one)


FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: str) -> str:
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fingerprint(command: Column, args: Column, env: Column) -> Column:
    """FNV-1a of a server's command, its arguments and the sorted names of its environment, as 16 hex digits."""
    whole = F.concat_ws("|", F.coalesce(command, F.lit("")), F.array_join(F.coalesce(args, F.array().cast("array<string>")), ","), F.array_join(F.array_sort(F.coalesce(env, F.array().cast("array<string>"))), ","))
    return F.pandas_udf(lambda s: s.map(fnv1a), "string")(whole)


# transcripts


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind, by the beginning of its schema."""
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _string(v: Column, path: str) -> Column:
    """A field that is a string; null for others."""
    return F.when(_is(_variant(v, path), "STRING"), F.try_variant_get(v, path, "string"))


def _count(v: Column, path: str) -> Column:
    n = F.try_variant_get(v, path, "long")
    return F.when(_is(_variant(v, path), "BIGINT") & (n >= 0), n)


def tool_use(name: Column, given: Column) -> Column:
    """One line for a call of a tool with an input (variant); null without a name."""
    text = lambda k, other="": F.coalesce(_string(given, f"$.{k}"), F.lit(other))
    first, lines = _count(given, "$.offset"), _count(given, "$.limit")
    target = F.when(_variant(given, "$.path").isNotNull(), text("path")).otherwise(text("glob"))
    body = F.coalesce(F.to_json(given), F.lit("null"))
    return (
        F.when(name == "Bash", F.concat(F.lit("[Bash] "), cut_bytes(text("command"), 200)))
        .when(name == "Read", F.concat(F.lit("[Read "), text("file_path", "?"), F.coalesce(F.concat(F.lit(":"), first, F.lit("-"), first + lines), F.lit("")), F.lit("]")))
        .when(name == "Grep", F.concat(F.lit("[Grep] "), text("pattern"), F.lit(" in "), target))
        .when(name == "Glob", F.concat(F.lit("[Glob] "), text("pattern")))
        .when(name.isin("Edit", "Write"), F.concat(F.lit("["), name, F.lit(" "), text("file_path", "?"), F.lit("]")))
        .when(name.isNotNull(), F.concat(F.lit("["), name, F.lit("] "), cut_bytes(body, 200), F.when(F.octet_length(body) > 200, "...").otherwise("")))
    )


def result_text(content: Column) -> Column:
    """What a tool gave (variant): a string, or the texts of an array's blocks; without white space at its ends, null if nothing is left."""
    blocks = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: (_string(b, "$.type") == "text") & _string(b, "$.text").isNotNull())
    joined = F.array_join(F.transform(blocks, lambda b: _string(b, "$.text")), "\n")
    whole = F.when(_is(content, "STRING"), F.try_variant_get(content, "$", "string")).when(_is(content, "ARRAY"), joined)
    bare = F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def tool_result(text: Column, name: Column) -> Column:
    """A result's text, shortened; null for tools whose results are in the files."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.concat(F.lit("→ "), x))
    n, size, join = F.size(lines), F.octet_length(text), lambda x: F.array_join(x, "\n")
    both_ends = F.concat(F.slice(lines, 1, 20), F.array(F.format_string("→ ... [%d lines omitted] ...", n - 40)), F.slice(lines, -20, 20))
    head = F.concat(F.slice(lines, 1, 20), F.array(F.format_string("→ ... [%d more matches]", n - 20)))
    return (
        F.when(name.isin("Read", "Edit", "Write"), F.lit(None))
        .when(name == "Bash", join(F.when(n <= 40, lines).otherwise(both_ends)))
        .when(name.isin("Grep", "Glob"), join(F.when(n <= 20, lines).otherwise(head)))
        .when(size <= 2048, F.concat(F.lit("→ "), text))
        .otherwise(F.concat(F.lit("→ "), cut_bytes(text, 2048), F.lit("... [truncated, "), size, F.lit(" chars]")))
    )


def _part(kind: str, text: Column, id_: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None).cast("string") if id_ is None else id_).alias("id"))


def _block(b: Column) -> Column:
    """What a block of a message says, or null."""
    kind, none = _string(b, "$.type"), F.lit(None)
    called = tool_use(_string(b, "$.name"), _variant(b, "$.input"))
    given = _part("result", result_text(_variant(b, "$.content")), F.coalesce(_string(b, "$.tool_use_id"), F.lit("")))
    return F.when((kind == "text") & _string(b, "$.text").isNotNull(), _part("text", _string(b, "$.text"))).when((kind == "tool_use") & called.isNotNull(), _part("text", called)).when(kind == "tool_result", given).otherwise(none)


def transcript_entries(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, role, joins, lead, most, parts, tools) of the lines (session_id, line_no, line) of transcripts, in either wire format.

    Each line is parsed once. Parts are texts, or a tool's id and what it gave; tools are the calls of an assistant, by id. Malformed
    lines, and those that say nothing of the conversation, are left out.
    """
    v, none = c("v"), F.lit(None).cast("string")
    read = lines.select(c("session_id").cast("string"), c("line_no").cast("long"), F.try_parse_json("line").alias("v")).filter(_is(v, "OBJECT"))
    kind, empty = F.coalesce(_string(v, "$.type"), F.lit("")), F.array().cast("array<struct<kind:string,text:string,id:string>>")
    no_tools = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    # messages
    role = F.when(kind.isin("user", "assistant"), kind).when(kind == "", F.coalesce(_string(v, "$.role"), F.lit("unknown")))
    messages = read.filter((kind != "response_item") & role.isNotNull() & ~role.isin("system", "tool")).select("session_id", "line_no", role.alias("role"), F.coalesce(_variant(v, "$.message.content"), _variant(v, "$.content")).alias("content"))
    messages = messages.withColumn("blocks", F.when(_is(c("content"), "ARRAY"), F.try_variant_get("content", "$", "array<variant>")))
    told = F.filter(F.transform("blocks", _block), lambda p: p.isNotNull())
    whole = F.when(_is(c("content"), "STRING"), F.try_variant_get("content", "$", "string")).when(_is(c("content"), "OBJECT"), _string(c("content"), "$.text"))
    calls = F.filter("blocks", lambda b: (_string(b, "$.type") == "tool_use") & _string(b, "$.id").isNotNull())
    called = F.map_from_entries(F.array_distinct(F.transform(calls, lambda b: F.struct(_string(b, "$.id"), F.coalesce(_string(b, "$.name"), F.lit("Unknown"))))))
    only = c("blocks").isNotNull() & F.forall("blocks", lambda b: F.coalesce(_string(b, "$.type") == "tool_result", F.lit(False)))
    spoken = messages.select(
        "session_id", "line_no", "role", F.when(only, "tool").otherwise("turn").alias("joins"), F.lit("\n").alias("lead"), F.lit(0).alias("most"),
        F.coalesce(told, F.when(whole.isNotNull(), F.array(_part("text", whole))), empty).alias("parts"), F.when((c("role") == "assistant") & c("blocks").isNotNull(), called).otherwise(no_tools).alias("tools"),
    )
    # rollouts
    p = c("p")
    rolled = read.filter(kind == "response_item").select("session_id", "line_no", _variant(v, "$.payload").alias("p")).filter(_is(p, "OBJECT"))
    item, who, name = _string(p, "$.type"), _string(p, "$.role"), _string(p, "$.name")
    said = F.filter(F.try_variant_get(_variant(p, "$.content"), "$", "array<variant>"), lambda b: _string(b, "$.type").isin("input_text", "output_text") & _string(b, "$.text").isNotNull())
    text = F.coalesce(F.array_join(F.transform(said, lambda b: _string(b, "$.text")), "\n"), F.lit(""))
    message = (item == "message") & who.isin("user", "assistant")
    injected = (who == "user") & F.regexp_replace(text, r"(?U)^\s+", "").rlike("^(?:" + "|".join(re.escape(x) for x in INJECTED) + ")")
    call = item.isin("function_call", "custom_tool_call") & name.isNotNull()
    given = cut_bytes(F.coalesce(_string(p, "$.arguments"), _string(p, "$.input"), F.lit("")), 160)
    output = _string(p, "$.output")
    gave = item.isin("function_call_output", "custom_tool_call_output") & output.isNotNull()
    body = F.when(message & ~injected, text).when(call, F.concat(F.lit("🔧 "), name, F.lit("("), given, F.lit(")"))).when(gave, output).otherwise(none)
    rows = rolled.select(
        "session_id", "line_no", F.when(message, who).otherwise("assistant").alias("role"), F.when(message, "turn").otherwise("trace").alias("joins"),
        F.when(F.coalesce(gave, F.lit(False)), "\n  → ").otherwise("\n").alias("lead"), F.when(F.coalesce(gave, F.lit(False)), 200).otherwise(0).alias("most"), F.when(body.isNotNull(), F.array(_part("text", body))).alias("parts"), no_tools.alias("tools"),
    ).filter("parts IS NOT NULL")
    return spoken.unionByName(rows)


def transcript_turns(lines: DataFrame) -> DataFrame:
    """(session_id, turn, role, text, n_lines) of transcript lines (session_id, line_no, line), in either wire format.

    Results of tools, and what an assistant says after it spoke, join the assistant's turn before; traces of tools without one are
    left out. Noise goes; a turn that says nothing isn't one.
    """
    entries = written(transcript_entries(lines), "transcript_entries")  # lines are parsed once, and read three times
    named = entries.select("session_id", F.explode("tools").alias("id", "name")).groupBy("session_id", "id").agg(F.max("name").alias("name"))
    parts = entries.select("session_id", "line_no", F.posexplode("parts").alias("at", "part"))
    texts = parts.filter("part.kind = 'text'").select("session_id", "line_no", "at", c("part.text").alias("text"))
    results = parts.filter("part.kind = 'result'").select("session_id", "line_no", "at", c("part.id").alias("id"), c("part.text").alias("content")).filter("content IS NOT NULL").join(named, ["session_id", "id"], "left")
    results = results.select("session_id", "line_no", "at", tool_result(c("content"), F.coalesce("name", F.lit("Unknown"))).alias("text")).filter("text IS NOT NULL")
    said = texts.unionByName(results).groupBy("session_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("raw"))
    kept = entries.drop("parts", "tools").join(said, ["session_id", "line_no"]).withColumn("text", without_noise(c("raw"))).filter("text <> ''")
    kept = kept.withColumn("text", F.when(c("most") > 0, cut_bytes(c("text"), 200)).otherwise(c("text")))
    before = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    spoke = F.last(F.when(c("joins") == "turn", c("role")), ignorenulls=True).over(before)  # whose turn the last one is
    kept = kept.withColumn("added", F.coalesce(spoke == "assistant", F.lit(False)) & (c("joins").isin("tool", "trace") | (c("role") == "assistant")))
    kept = kept.filter(c("added") | (c("joins") != "trace"))
    so_far = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("turn", F.sum((~c("added")).cast("long")).over(so_far))
    own = F.array_sort(F.collect_list(F.struct("line_no", "role", "lead", "text")))
    turns = kept.groupBy("session_id", "turn").agg(own.alias("own"))
    joined = F.aggregate(F.slice(c("own"), 2, 1 << 30), F.get("own", F.lit(0))["text"], lambda s, x: F.concat(s, x["lead"], x["text"]))
    return turns.select("session_id", "turn", F.get("own", F.lit(0))["role"].alias("role"), joined.alias("text"), F.size("own").alias("n_lines"))


def usage_lines(lines: DataFrame) -> DataFrame:
    """(session_id, line_no, model, timestamp, four counters) of the lines of a transcript that report usage; absent counters are 0."""
    v = F.try_parse_json("line")
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_write_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}
    counters = [F.coalesce(of(f"$.message.usage.{wire}", "long"), F.lit(0)).alias(name) for name, wire in names.items()]
    reported = F.startswith(F.coalesce(F.schema_of_variant(of("$.message.usage", "variant")), F.lit("")), F.lit("OBJECT"))
    return lines.filter((of("$.type", "string") == "assistant") & reported).select("session_id", "line_no", F.coalesce(of("$.message.model", "string"), F.lit("unknown")).alias("model"), of("$.timestamp", "string").alias("timestamp"), *counters)
