"""Catalogs, logs and state as tables: registries, sessions, histories, ingest state, schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.relational import global_ranks

c = F.col


def registered(projects: DataFrame, seen: DataFrame) -> DataFrame:
    """Projects (slug, name, last_used) after `seen` ones: a new slug is added, one that is there keeps its name, and was last used when it was last seen."""
    last = seen.groupBy("slug").agg(F.max_by("name", "last_used").alias("new_name"), F.max("last_used").alias("seen_at"))
    both = projects.join(last, "slug", "full")
    return both.select("slug", F.coalesce("name", "new_name").alias("name"), F.coalesce("seen_at", "last_used").alias("last_used"))


def renamed(projects: DataFrame, slug: str, name: str) -> DataFrame:
    return projects.withColumn("name", F.when(c("slug") == slug, name).otherwise(c("name")))


def removed(projects: DataFrame, slugs: list[str]) -> DataFrame:
    return projects.filter(~c("slug").isin(*slugs)) if slugs else projects


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their places, from 1, in an order that has no ties; the order is found in parts, not in one task."""
    return global_ranks(rows, order, name).withColumn(name, c(name) + 1)


def recent_first(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """(key, place) of the `most` rows that were used last."""
    top = rows.orderBy(c(at).desc(), key).limit(most)
    return top.select(key, F.row_number().over(Window.orderBy(c(at).desc(), key)).cast("long").alias("place"))  # `most` rows


def newest_then_named(files: DataFrame, at: str, key: str, names: list[str], most: int) -> DataFrame:
    """The `most` newest files, in the order of their names."""
    top = files.orderBy(c(at).desc(), key).limit(most)
    return top.select(F.row_number().over(Window.orderBy(*names)).cast("long").alias("place"), *names)  # `most` rows


def older_than(sessions: DataFrame, cutoff: float) -> DataFrame:
    return sessions.filter(c("at") < cutoff)


def uncurated(sessions: DataFrame) -> DataFrame:
    return sessions.filter("curated = 0")


def oldest(sessions: DataFrame, n: int) -> DataFrame:
    """The n oldest sessions; none for n of 0 or less."""
    return sessions.orderBy("at", "id").limit(max(0, n))


def purged(sessions: DataFrame, mode: str, argument=None) -> DataFrame:
    """Sessions (id, at, curated) with what becomes of each: by `age` those before the argument go, `all` go, `one` goes, or one is marked by `curate`."""
    gone = {"age": c("at") < F.lit(argument), "all": F.lit(True), "one": c("id") == F.lit(argument), "curate": F.lit(False)}[mode]
    curated = (c("id") == F.lit(argument)) | (c("curated") == 1) if mode == "curate" else F.lit(False)
    return sessions.withColumn("state", F.when(F.coalesce(gone, F.lit(False)), "removed").when(curated, "curated").otherwise("kept"))


def ingest_actions(known: DataFrame, seen: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): what an ingest does with each seen item: `new`, `same` (skipped, even by a refresh) or `changed` (its old chunks go first)."""
    old = known.select(key, c(digest).alias("old_digest"), F.lit(True).alias("there"))
    action = F.when(c("there").isNull(), "new").when(c("old_digest").eqNullSafe(c(digest)), "same").otherwise("changed")
    return seen.join(old, key, "left").select(key, action.alias("action"))


def ingest_stats(files: DataFrame, group: str, text: str) -> DataFrame:
    """(group, files, bytes, empty) of what was read."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return files.groupBy(group).agg(F.count("*").alias("files"), F.sum(size.cast("long")).alias("bytes"), F.count_if(size == 0).alias("empty"))


def two_way_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): what only one of two catalogs holds."""
    one = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("change", F.lit(name))
    return one(before, after, "removed").unionByName(one(after, before, "added"))


def projected(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows (kind, JSON payload) as columns; kinds that aren't known are left out, and lists that don't parse are empty."""
    files = F.coalesce(F.from_json(F.get_json_object("payload", "$.files"), "array<string>"), F.array().cast("array<string>"))
    return rows.filter(c("kind").isin(*kinds)).withColumns({"k": F.get_json_object("payload", "$.k").cast("long"), "files": files}).drop("payload")


def uncovered_symbols(edited: DataFrame, impacted: DataFrame, key: str = "symbol") -> DataFrame:
    """Edited symbols that no impacted one covers: the same, or either is the other's last segments. Both are met at their last segment."""
    leaf = F.element_at(F.split(key, "::"), -1)
    e, i = edited.select(key).distinct().withColumn("leaf", leaf), impacted.select(key).distinct().withColumn("leaf", leaf).withColumnRenamed(key, "other")
    ends = lambda a, b: F.endswith(F.concat(F.lit("::"), c(a)), F.concat(F.lit("::"), c(b)))
    hit = e.join(i, "leaf").filter(ends(key, "other") | ends("other", key)).select(key).distinct()
    return e.select(key).join(hit, key, "left_anti")


def migrated(rows: DataFrame, columns: dict[str, tuple[str, object]], version: int, newest: int) -> DataFrame:
    """`rows` with the columns that lack, at their defaults; a table of a newer version than is known is refused."""
    if version > newest:
        raise ValueError(f"schema version {version} is newer than {newest}")
    return rows.withColumns({n: F.lit(default).cast(kind) for n, (kind, default) in columns.items() if n not in rows.columns})


def appended(events: DataFrame, order: str, last: int) -> DataFrame:
    """New events with the ids that follow `last`, in their order."""
    return global_ranks(events, [c(order)], "id").withColumn("id", c("id") + last + 1)


def rotating_append(path: str, rows: DataFrame, most_bytes: int) -> bool:
    """Append rows of JSON to a log in shared storage, which is emptied first if it holds `most_bytes` or more; true if it was."""
    spark = rows.sparkSession
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.exists(where) and fs.getContentSummary(where).getLength() >= most_bytes
    rows.write.mode("overwrite" if full else "append").json(path)
    return full
