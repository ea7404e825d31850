"""Repair of the paths in plans by an index of the workspace's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.storage import written

c = F.col


def _leaf(name: str):
    return F.regexp_extract(name, "([^/]*)$", 1)


def sole_matches(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(query, match): the only file of `index` (path) that ends with each query, else the only one of its name; none where the query is a path
    of the index, or where several files fit.

    Ends of paths are counted as strings of the queries' lengths, so a query meets one count, not every file.
    """
    asked = wanted.select("query").filter("query <> ''").distinct().join(index.select(c("path").alias("query")), "query", "left_anti")
    sizes = asked.select(F.length("query").alias("n")).distinct().groupBy().agg(F.collect_set("n").alias("ns"))  # as many as paths have lengths
    ends = index.select("path").distinct().crossJoin(F.broadcast(sizes)).select("path", F.explode(F.filter("ns", lambda n: n <= F.length("path"))).alias("n")).select("path", F.expr("right(path, n)").alias("query"))
    by_end = ends.join(asked, "query", "left_semi").groupBy("query").agg(F.count("*").alias("n"), F.min("path").alias("match"))
    by_name = index.select("path").distinct().groupBy(_leaf("path").alias("leaf")).agg(F.count("*").alias("n"), F.min("path").alias("match"))
    sole = lambda df, key, name: df.filter("n = 1").select(key, c("match").alias(name))
    both = asked.withColumn("leaf", _leaf("query")).join(sole(by_end, "query", "a"), "query", "left").join(sole(by_name, "leaf", "b"), "leaf", "left")
    return both.select("query", F.coalesce("a", "b").alias("match")).filter("match IS NOT NULL")


def repaired(paths: DataFrame, index: DataFrame, workspace: str) -> DataFrame:
    """(columns of `paths`, new, reason) of the paths (path, ...) that change; `index` (path) holds the workspace's files.

    Relative paths become absolute, after a match where they are no files; absolute ones that are no files of the workspace give way to a
    match of what is below the workspace, else of their name. A pointer's lines, `:a-b` at its end, stay. What can't be matched without
    doubt stays as it is, or is taken for a new file if it is relative.
    """
    base = workspace.rstrip("/") + "/"
    line = F.when(F.substring_index("path", ":", -1).contains("-") & c("path").contains(":"), F.regexp_extract("path", "(:[^:]*)$", 1)).otherwise("")
    rows = paths.withColumn("_line", line).withColumn("_bare", F.expr("left(path, length(path) - length(_line))"))
    rows = rows.withColumn("_absolute", c("_bare").startswith("/"))
    inside = F.when(~c("_absolute"), c("_bare")).when(c("_bare").startswith(base), F.substring(c("_bare"), F.lit(len(base) + 1), F.length("_bare")))
    rows = rows.withColumn("_inside", inside).join(index.select(c("path").alias("_inside"), F.lit(True).alias("_there")).distinct(), "_inside", "left").withColumn("_leaf", _leaf("_bare"))
    rows = written(rows, "plan_paths")  # read three times
    lost = rows.filter("_there IS NULL")
    wanted = lost.select(c("_inside").alias("query")).unionByName(lost.filter("_absolute").select(c("_leaf").alias("query"))).filter("query IS NOT NULL")
    found = sole_matches(wanted, index)
    both = rows.join(found.select(c("query").alias("_inside"), c("match").alias("_match")), "_inside", "left").join(found.select(c("query").alias("_leaf"), c("match").alias("_named")), "_leaf", "left")
    lost_, match, named = c("_there").isNull(), c("_match"), c("_named")
    new = F.when(~c("_absolute"), F.when(lost_ & match.isNotNull(), match).otherwise(c("_bare"))).when(lost_, F.coalesce(match, named))
    reason = (
        F.when(~c("_absolute") & ~lost_, "relative→absolute")
        .when(~c("_absolute") & match.isNotNull(), F.concat(F.lit("relative+fuzzy:"), "_bare", F.lit("→"), match))
        .when(~c("_absolute"), "relative→absolute(new file)")
        .when(match.isNotNull(), F.concat(F.lit("fuzzy:"), "_inside", F.lit("→"), match))
        .otherwise(F.concat(F.lit("fuzzy_filename:"), "_leaf", F.lit("→"), named))
    )
    changed = both.withColumns({"new": F.concat(F.lit(base), new, "_line"), "reason": reason}).filter("new IS NOT NULL")
    return changed.select(*paths.columns, "new", "reason")
