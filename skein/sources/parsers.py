"""Parsers of texts into rows: markdown records, diffs, patch envelopes, front matter, text chunks, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
CHUNK_LINES, CHUNK_BYTES = 120, 64 << 10


def exploded_lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line from 1, body) of each line, split at \\n; the empty end after a last \\n isn't a line."""
    rows = docs.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("line", "body"))
    return rows.withColumn("line", c("line") + 1)


def text_chunks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, start_line, end_line, chars): paragraphs between blank lines, in pieces of CHUNK_LINES lines at most."""
    lines = exploded_lines(docs, keys, text)
    blank = ~F.rlike("body", F.lit(r"\S"))
    w = Window.partitionBy(*keys).orderBy("line")
    marked = lines.withColumn("blank", blank).withColumn("paragraph", F.sum(F.when(blank, 1).otherwise(0)).over(w)).filter(~c("blank"))
    piece = F.floor((F.row_number().over(Window.partitionBy(*keys, "paragraph").orderBy("line")) - 1) / CHUNK_LINES)
    return marked.withColumn("piece", piece).groupBy(*keys, "paragraph", "piece").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum(F.length("body")).alias("chars")).drop("paragraph", "piece")


def _sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, rows of (line, body, level)) of each `### ` record, up to the next heading of three levels or fewer."""
    lines = exploded_lines(docs, [key], text)
    level = F.length(F.regexp_extract("body", "^(#{1,3}) ", 1))
    w = Window.partitionBy(key).orderBy("line")
    inside = lines.withColumn("level", level).withColumn("section", F.sum(F.when(c("level") > 0, 1).otherwise(0)).over(w))
    return inside.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("line", "body", "level"))).alias("rows")).filter((F.size("rows") > 0) & (c("rows")[0]["level"] == 3))


def _records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number from 1, heading, rest: array of the lines below it) of each `### ` record."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("section"))
    rest = F.transform(F.slice(c("rows"), 2, 1 << 20), lambda r: r["body"])
    return _sections(docs, key, text).select(key, number.alias("number"), F.trim(F.substring(c("rows")[0]["body"], 5, 1 << 20)).alias("heading"), rest.alias("rest"))


def _last(lines: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last line that matches, else null."""
    return F.regexp_extract(F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(-1)), pattern, group)


def preferences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, text, tags) of each `### ` record: the heading, and the body on the lines below it if it isn't blank; the last `tags:` line counts."""
    body = F.array_join(F.filter("rest", lambda x: ~x.startswith("tags:")), "\n")
    body = F.rtrim(F.regexp_replace(F.regexp_replace(body, r"^(?:[ \t\r]*\n)+", ""), r"\s+$", ""))
    tags = F.filter(F.transform(F.split(F.coalesce(_last(c("rest"), "^tags:(.*)$"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return _records(docs, key, text).select(key, "number", F.when(F.trim(body) == "", c("heading")).otherwise(F.concat("heading", F.lit("\n"), body)).alias("text"), F.array_join(tags, ",").alias("tags"))


# What enforces a lesson; the first is the default.
ENFORCEMENT = ("Advise", "Require", "Block", "WorkflowGate")
_ENFORCED = rf"({'|'.join(ENFORCEMENT)}|RequireRecall\s*\(\s*turns=\s*\d+\s*\))"
_COUNTED = (r"^\s*<!--\s*success:\s*(\d+)\s*/\s*failure:\s*(\d+)\s*-->\s*$", r"^\s*<!--\s*failure:\s*(\d+)\s*/\s*success:\s*(\d+)\s*-->\s*$")


def lessons(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, trigger, advice, success, failure, enforcement, suggested, block_message) of each `### ` record.

    Hidden comment lines aren't advice: the last counters count, the last known enforcement holds (Advise if there is none), an unknown
    suggestion takes back an earlier one, an empty message says nothing.
    """
    rest = c("rest")
    comment = lambda name: rf"^\s*<!--\s*{name}\s*:(.*)-->\s*$"
    enforced = lambda x: F.regexp_replace(F.nullif(F.regexp_extract(F.trim(x), f"^{_ENFORCED}$", 1), F.lit("")), r"\s+", "")
    hidden = "|".join([*_COUNTED, comment("(?:enforcement|suggested_enforcement|block_message)")])
    counters = F.try_element_at(F.filter(rest, lambda x: x.rlike(_COUNTED[0]) | x.rlike(_COUNTED[1])), F.lit(-1))
    count = lambda name: F.coalesce(F.regexp_extract(counters, rf"{name}:\s*(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    message = F.filter(F.transform(rest, lambda x: F.trim(F.replace(F.regexp_extract(x, comment("block_message"), 1), F.lit("--&gt;"), F.lit("-->")))), lambda x: x != "")
    advice = F.regexp_replace(F.array_join(F.filter(rest, lambda x: ~x.rlike(hidden)), "\n"), r"\s+$", "")
    return _records(docs, key, text).select(
        key, "number", c("heading").alias("trigger"), advice.alias("advice"), count("success").alias("success"), count("failure").alias("failure"),
        F.coalesce(enforced(_last(rest, rf"^\s*<!--\s*enforcement\s*:\s*{_ENFORCED}\s*-->\s*$")), F.lit(ENFORCEMENT[0])).alias("enforcement"),
        enforced(_last(rest, comment("suggested_enforcement"))).alias("suggested"), F.try_element_at(message, F.lit(-1)).alias("block_message"),
    )


def markdown_records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, heading, body, tags, scope) of each `### ` record; its body ends at the next heading of three levels or fewer."""
    rest = c("rest")
    tagged = lambda name: F.element_at(F.concat(F.transform(F.filter(rest, lambda x: F.startswith(x, F.lit(f"{name}:"))), lambda x: F.trim(F.substring(x, len(name) + 2, 1 << 20))), F.array(F.lit(""))), 1)
    body = F.array_join(F.filter(rest, lambda x: ~x.rlike("^(tags|scope):")), "\n")
    return _records(docs, key, text).select(
        key, "number", "heading", F.regexp_replace(body, "^\n+|\n+$", "").alias("body"),
        F.array_join(F.filter(F.transform(F.split(tagged("tags"), ","), lambda x: F.trim(x)), lambda x: x != ""), ",").alias("tags"), F.when(tagged("scope") == "on-demand", "on-demand").otherwise("always").alias("scope"),
    )


def diff_hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, a, b): post-image line ranges of unified diffs; a length left out is 1, hunks that only delete give none."""
    lines = exploded_lines(diffs, [key], text)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(c("body").startswith("+++ "), F.regexp_replace(F.substring("body", 5, 1 << 20), "^b/", ""))
    at = lambda i: F.regexp_extract("body", r"^@@ -\d+(?:,\d+)? \+(\d+)(,(\d+))? @@", i)
    rows = lines.withColumn("path", F.last(named, ignorenulls=True).over(w)).filter((at(1) != "") & (c("path") != "/dev/null"))
    length = F.when(at(2) == "", 1).otherwise(F.try_to_number(F.coalesce(F.nullif(at(3), F.lit("")), F.lit("0")), F.lit("999999999")).cast("int"))
    return rows.select(key, "path", at(1).cast("int").alias("a"), length.alias("n")).filter("n > 0").select(key, "path", "a", (c("a") + c("n") - 1).alias("b"))


def patch_paths(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, path) of the files that patch envelopes name, in order, repeats kept."""
    path = F.regexp_extract("body", r"^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+)$", 1)
    return exploded_lines(patches, [key], text).select(key, "line", F.trim(path).alias("path")).filter("path <> ''")


def front_matter(text: Column) -> Column:
    """Map of the `key: value` lines between a leading `---` and the next; quotes around values go, odd keys are skipped, the last of one key counts."""
    block = F.regexp_extract(text, r"^---\n((?s:.*?))\n---(?:\n|$)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_-]*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)), "^[\"'](.*)[\"']$", "$1").alias("value"))
    # the entries are bound once, so that looking for a later one of the same key doesn't find all of them anew
    later = lambda es, x, i: F.exists(F.slice(es, i + 2, F.size(es)), lambda y: y["key"] == x["key"])
    return F.get(F.transform(F.array(F.transform(pairs, entry)), lambda es: F.map_from_entries(F.filter(es, lambda x, i: ~later(es, x, i)))), F.lit(0))


def front_value(text: Column, key: str) -> Column:
    """One value of the front matter; null if it lacks."""
    return F.try_element_at(front_matter(text), F.lit(key))


def skills(files: DataFrame) -> DataFrame:
    """(slug, name, description) of each folder of files (path, content) that holds a SKILL.md; the name is the folder's and the description
    empty where its front matter has none."""
    own = files.filter(c("path").rlike(r"^[^/]+/SKILL\.md$")).withColumn("slug", F.regexp_extract("path", "^([^/]+)/", 1))
    block = F.split(F.regexp_extract("content", r"^---\n((?s:.*?))\n---", 1), "\n")
    value = lambda name: F.trim(_last(block, f"^{name}:(.*)$"))  # quotes stay
    return own.select("slug", F.coalesce(value("name"), "slug").alias("name"), F.coalesce(value("description"), F.lit("")).alias("description"))


def _listed(text: Column, key: str) -> Column:
    return F.coalesce(F.from_json(front_value(text, key), "array<string>"), F.array().cast("array<string>"))


#: Lists that an addon's front matter may hold; each is empty where it lacks or doesn't parse.
ADDON_LISTS = ("frameworks", "test_frameworks", "allowed_tools", "exclude_task_types", "include_task_types", "exclude_worker_roles", "include_worker_roles")


def addons(files: DataFrame) -> DataFrame:
    """(path, name, lists of ADDON_LISTS, priority, inject_position, pre_invoke_gate, body) of the markdown files (path, content) of one folder whose
    front matter has a name; others are no addons."""
    text = c("content")
    own = files.filter(c("path").rlike(r"^[^/]+\.md$") & front_value(text, "name").isNotNull())
    gate = front_value(text, "pre_invoke_gate")
    return own.select(
        "path", front_value(text, "name").alias("name"), *[_listed(text, k).alias(k) for k in ADDON_LISTS], F.coalesce(front_value(text, "priority").try_cast("int"), F.lit(50)).alias("priority"),
        F.coalesce(front_value(text, "inject_position"), F.lit("after_base")).alias("inject_position"), F.when(gate != "null", gate).alias("pre_invoke_gate"), F.regexp_replace(F.regexp_replace(text, r"^---\n(?s:.*?)\n---(?:\n|$)", ""), r"^\s+|\s+$", "").alias("body"),
    )


def merged_turns(turns: DataFrame) -> DataFrame:
    """(session_id, number, role, content): neither system nor tool turns; runs of assistant turns as one, a blank line between."""
    own = turns.filter(c("role").isin("user", "assistant"))
    w = Window.partitionBy("session_id").orderBy("turn_number")
    new = (c("role") == "user") | ~c("role").eqNullSafe(F.lag("role").over(w))
    runs = own.withColumn("number", F.sum(F.when(new, 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "content"))), lambda x: x["content"]), "\n\n")
    return runs.groupBy("session_id", "number", "role").agg(text.alias("content"))
