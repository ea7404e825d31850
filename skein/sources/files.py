"""File scans: source trees, text files, JSON lines, and the ignore patterns that guard them."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import language_of

MAX_FILE_BYTES = 2 << 20


@lru_cache(1024)
def _ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(whether it takes back, regex) of one ignore pattern; None for blank lines and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    only_dirs = line.endswith("/")
    line = line.strip("/") if not line.startswith("/") else "/" + line.strip("/")
    rooted = "/" in line
    body, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            body, i = body + ".*", i + 2
        elif line[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif line[i] == "?":
            body, i = body + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            end = line.index("]", i + 1)
            inside = line[i + 1 : end]
            body, i = body + "[" + ("^" + inside[1:] if inside[:1] == "!" else inside) + "]", end + 1
        else:
            body, i = body + re.escape(line[i]), i + 1
    return back, ("^" if rooted else "^(?:.*/)?") + body + ("/.*$" if only_dirs else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a relative path ignores it; malformed patterns are skipped."""
    out = F.lit(False)
    for p in patterns:
        if rule := _ignore_regex(p):
            try:
                re.compile(rule[1])
            except re.error:
                continue
            out = F.when(path.rlike(rule[1]), F.lit(not rule[0])).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] = (), hidden: bool = False) -> DataFrame:
    """(path relative to root, length, modificationTime, content) of the files under root, but for ignored and hidden ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = found.withColumn("path", relative)
    if not hidden:
        rows = rows.filter(~F.col("path").rlike(r"(^|/)\.[^/]"))
    return rows.filter(~ignored(F.col("path"), list(patterns))) if patterns else rows


def source_files(spark: SparkSession, root: str, patterns: list[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files whose extension has a language, up to max_bytes."""
    return scan(spark, root, patterns).filter(language_of(F.col("path")).isNotNull() & (F.col("length") <= max_bytes)).withColumn("language", language_of(F.col("path")))


def text_files(spark: SparkSession, root: str, patterns: list[str] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The other files that aren't empty, up to max_bytes, without a NUL in their first 8 KiB."""
    head = F.hex(F.substring("content", 1, 8192))
    no_nul = ~head.rlike("^(?:..)*?00")
    return scan(spark, root, patterns).filter(language_of(F.col("path")).isNull() & (F.col("length") > 0) & (F.col("length") <= max_bytes) & no_nul)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of an append-only JSON log; lines that don't parse are skipped, fields that lack are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# Kinds of sessions, and folders of built files that no index enters.
SESSION_TYPES = ("feat", "fix", "refactor", "perf", "test", "docs", "chore", "brainstorm")
BUILD_DIRS = ("node_modules", "target", "__pycache__", "dist", "build")


def file_index(files: DataFrame) -> DataFrame:
    """(path) of files (path, ...) but for hidden ones and what build folders hold, at any depth."""
    return files.filter(~F.col("path").rlike(rf"(^|/)(\..*|{'|'.join(BUILD_DIRS)})(/|$)")).select("path")


def session_catalog(files: DataFrame) -> DataFrame:
    """(id, type, name, files, modified) of the sessions `<type>/<name>` that files (path, modificationTime) lie in; types that aren't known are left
    out. A session was modified when its newest file was; order by `modified` for a listing, ties by id."""
    own = files.select(F.split("path", "/").alias("at"), "modificationTime").filter((F.size("at") > 2) & F.col("at")[0].isin(*SESSION_TYPES))
    named = own.select(F.col("at")[0].alias("type"), F.col("at")[1].alias("name"), F.col("at")[2].alias("file"), "modificationTime")
    held = named.groupBy("type", "name").agg(F.array_sort(F.collect_set("file")).alias("files"), F.max("modificationTime").alias("modified"))
    return held.select(F.concat_ws("/", "type", "name").alias("id"), "type", "name", "files", "modified")


def transcript_files(files: DataFrame, rollouts: bool = False) -> DataFrame:
    """(project, session_id, path, modified) of the transcripts among files (path, modificationTime, and content for rollouts).

    Projects hold `<project>/<session>.jsonl` or `<project>/sessions/<session>/conversation.jsonl`. Rollouts are `rollout-*.jsonl` under four
    folders at most; their project is the working folder that their first line, of type session_meta, names, and without one they are
    left out. Hyphens and slashes of a project's name are one.
    """
    path = F.col("path")
    if rollouts:
        head = F.substring_index(F.col("content").cast("string"), "\n", 1)
        project = F.when(F.get_json_object(head, "$.type") == "session_meta", F.get_json_object(head, "$.payload.cwd"))
        session = F.regexp_extract(path, r"^(?:[^/]+/){0,4}(rollout-[^/]*)\.jsonl$", 1)
    else:
        project = F.regexp_extract(path, "^([^/]+)/", 1)
        nested = F.regexp_extract(path, r"^[^/]+/sessions/([^/]+)/conversation\.jsonl$", 1)
        session = F.when(nested != "", nested).otherwise(F.regexp_extract(path, r"^[^/]+/([^/]+)\.jsonl$", 1))
    found = files.select(project.alias("project"), session.alias("session_id"), "path", F.col("modificationTime").alias("modified"))
    return found.filter((F.col("session_id") != "") & F.col("project").isNotNull()).withColumn("project", F.translate("project", "-", "/"))
