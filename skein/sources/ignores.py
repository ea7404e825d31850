"""Ignore files of a tree: rules as rows, matched with every path and all folders above it.

A rule comes from a line of an ignore file and holds below that file's folder. The last rule that matches a path or folder decides about it: a
file of a later kind over one of an earlier kind, a deeper file over a higher one, a later line over an earlier one. What is below an
ignored folder is ignored, whatever the rules say of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Ignore files, each kind over those before it.
IGNORE_FILES = (".gitignore", ".ignore", ".memoryignore")
#: Parts into which the paths below one folder are dealt.
SALTS = 64


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """The folders above a path, from the nearest to the root, which is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def regex_of(pattern: Column) -> Column:
    """A pattern, without `!` and the last `/`, as a regular expression of paths relative to its folder; null if it can match nothing.

    `*` and `?` stay within a name, `**` between slashes stands for any folders, a pattern with a slash that isn't its last begins at the
    folder, `[!...]` is the opposite of a class, and a backslash takes a letter as it is.
    """
    whole = F.regexp_replace(pattern, "^/", "")
    rooted = pattern.contains("/")
    # letters that a backslash protects, and the forms of **, stand in as control characters while the rest is escaped
    out = F.regexp_replace(whole, r"\\([*?\[\]!#\\ ])", "\u0001$1\u0002")
    out = F.regexp_replace(out, r"(^|/)\*\*/", "$1\u0003")
    out = F.regexp_replace(out, r"/\*\*$", "/\u0004")
    out = F.regexp_replace(out, r"\*+", "\u0005")
    out = F.regexp_replace(out, r"\[!", "\u0006")
    out = F.regexp_replace(out, r"([.+^$(){}|\\])", r"\\$1")
    out = F.regexp_replace(out, "\\?", "[^/]")
    out = F.regexp_replace(out, "\u0001(.)\u0002", r"\\$1")
    out = F.regexp_replace(out, r"\u0001\[\^/\]\u0002", r"\\?")
    out = F.regexp_replace(out, r"\u0001\u0005\u0002", r"\\*")
    for mark, text in (("\u0003", "(?:.*/)?"), ("\u0004", ".+"), ("\u0005", "[^/]*"), ("\u0006", "[^")):
        out = F.replace(out, F.lit(mark), F.lit(text))
    open_class = F.regexp_replace(out, r"\\\\|\\.", "").rlike(r"\[[^\]]*$")  # a class that isn't closed
    return F.when((whole != "") & ~open_class, F.concat(F.when(rooted, "^").otherwise("^(?:.*/)?"), out, F.lit("$")))


def rules(files: DataFrame) -> DataFrame:
    """(folder, kind, depth, line, negated, folders, regex) of the ignore files among files (path, text), kinds as in IGNORE_FILES.

    Blank lines, comments and patterns that can match nothing give no rule; white space at a line's end counts only after a backslash.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    named = files.filter(name.isin(*IGNORE_FILES)).withColumn("kind", F.array_position(F.array(*map(F.lit, IGNORE_FILES)), name).cast("int"))
    lines = named.select(folder_of(c("path")).alias("folder"), "kind", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    trimmed = F.regexp_replace("raw", r"(?<!\\)[ \t]+$", "")
    shown = lines.withColumn("raw", trimmed).filter((c("raw") != "") & ~c("raw").startswith("#"))
    bare = F.regexp_replace("raw", "^!", "")
    some = shown.select("folder", "kind", "line", c("raw").startswith("!").alias("negated"), bare.endswith("/").alias("folders"), regex_of(F.regexp_replace(bare, "/$", "")).alias("regex"))
    depth = F.when(c("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return some.filter("regex IS NOT NULL").withColumn("depth", depth)


def ignored_paths(paths: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """(path) of the files (path) that the rules ignore, each once.

    Files and the folders above them are decided once each, so a folder's rules meet each folder below it a single time; the paths below
    one folder are dealt into parts, for all are below the root.
    """
    files = paths.select("path").distinct()
    folders = files.select(F.explode(ancestors(c("path"))).alias("path")).filter("path <> ''").distinct()
    every = files.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))
    below = every.select("path", "is_folder", F.explode(ancestors(c("path"))).alias("folder")).withColumn("salt", F.pmod(F.hash("path"), F.lit(SALTS)))
    sent = below.select("folder", "salt").distinct().join(rule_rows, "folder")
    met = below.join(sent, ["folder", "salt"]).filter(c("is_folder") | ~c("folders"))
    relative = F.when(c("folder") == "", c("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    last = met.filter(F.rlike(relative, c("regex"))).groupBy("path").agg(F.max_by("negated", F.struct("kind", "depth", "line")).alias("negated"))
    gone = last.filter("not negated").select(c("path").alias("gone"))
    up = files.select("path", F.explode(F.array_append(ancestors(c("path")), c("path"))).alias("gone")).filter("gone <> ''")
    return up.join(gone, "gone", "left_semi").select("path").distinct()


def kept_files(files: DataFrame) -> DataFrame:
    """The files (path, text, ...) of a tree that its own ignore files leave, without those files themselves."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.filter(~name.isin(*IGNORE_FILES)).join(ignored_paths(files, rules(files)), "path", "left_anti")
