"""Joins, windows, sets and upserts over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.storage import written

c = F.col


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what an upsert by key leaves. `order` ascends; ties go to any row unless it breaks them."""
    struct = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c(x) for x in rows.columns if x not in keys]), struct).alias("row"))
    return packed.select(*keys, "row.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`table` with `changes` over it, the last change of a key winning; both have the table's columns and changes have `order` too."""
    new = latest(changes, keys, [c(order)]).select(*table.columns)
    return table.join(new, keys, "left_anti").unionByName(new)


def upsert_keeping(table: DataFrame, changes: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """As upsert, but a key that was there keeps its columns `kept`."""
    old = table.select(*keys, *[c(k).alias(f"old_{k}") for k in kept], F.lit(True).alias("was"))
    new = changes.join(old, keys, "left")
    new = new.select(*[F.when(c("was"), c(f"old_{x}")).otherwise(c(x)).alias(x) if x in kept else c(x) for x in table.columns])
    return table.join(changes, keys, "left_anti").unionByName(new)


def newest(rows: DataFrame, order: str, keep: int) -> DataFrame:
    """The `keep` rows of the highest `order`, which is different in each row: a distributed top-k finds the least kept
    value and a filter the rows. Where very many are kept, an approximate percentile leaves the top-k only its own error."""
    n = rows.count()
    if keep <= 0:
        return rows.limit(0)
    if n <= keep:
        return rows
    if keep <= 100_000:
        least = rows.select(order).orderBy(c(order).desc()).limit(keep).agg(F.min(order))
    else:
        low = rows.agg(F.percentile_approx(order, max(0.0, 1 - keep / n - 2e-4), 10_000)).first()[0]
        above = rows.filter(c(order) >= low).count()
        if above < keep:
            low, above = rows.agg(F.min(order)).first()[0], n
        least = rows.filter(c(order) >= low).select(order).orderBy(order).limit(above - keep + 1).agg(F.max(order))
    return rows.filter(c(order) >= F.lit(least.first()[0]))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: distinct by key, in the order of first sight."""
    return latest(rows, keys, [-c(order)])


def overlapping(spans: DataFrame, ranges: DataFrame, bin_lines: int = 64) -> DataFrame:
    """Pairs of a span (path, start_line, end_line) and a range (path, a, b) that overlap; each pair once.

    Both sides are dealt into bins of lines, so that the join is on (path, bin); a pair counts in the first bin they share.
    """
    binned = lambda d, lo, hi: d.withColumn("bin", F.explode(F.sequence(F.floor(c(lo) / bin_lines), F.floor(c(hi) / bin_lines))))
    s = binned(spans, "start_line", "end_line").withColumn("s_first", F.floor(c("start_line") / bin_lines))
    r = binned(ranges, "a", "b").withColumn("r_first", F.floor(c("a") / bin_lines))
    both = s.join(r, ["path", "bin"]).filter((c("start_line") <= c("b")) & (c("end_line") >= c("a")) & (c("bin") == F.greatest("s_first", "r_first")))
    return both.drop("bin", "s_first", "r_first")


def with_neighbours(chunks: DataFrame, keys: list[str], index: str, text: str, separator: str = "\n---\n") -> DataFrame:
    """Each chunk's text with those of index - 1 and + 1 of the same keys, where they exist."""
    of = lambda step, name: chunks.select(*keys, (c(index) + step).alias(index), c(text).alias(name))
    both = chunks.join(of(1, "before"), [*keys, index], "left").join(of(-1, "after"), [*keys, index], "left")
    return both.select(*keys, index, F.concat_ws(separator, "before", text, "after").alias("expanded"))


def overlay(base: DataFrame, over: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `base` with those of `over` in their places, and the rows that only `over` has after them."""
    b = base.select(c(key), c(order).alias("o1"), F.struct(*[c(x) for x in base.columns]).alias("b"))
    o = over.select(c(key), c(order).alias("o2"), F.struct(*[c(x) for x in base.columns]).alias("o"))
    both = b.join(o, key, "full")
    row = F.coalesce("o", "b")
    place = F.struct(c("o1").isNull().alias("extra"), F.coalesce("o1", "o2").alias("at"))
    return both.select(row.alias("row"), place.alias("place")).select(*[c(f"row.{x}").alias(x) for x in base.columns if x != order], F.when(c("place.extra"), c("place.at") + F.lit(1 << 40)).otherwise(c("place.at")).alias(order))


def running(rows: DataFrame, keys: list[str], order: list[Column], **folds: tuple[str, Column]) -> DataFrame:
    """`rows` with the folds (`sum` or `max`, of a column) of each key's rows so far, in an order that should have no ties.

    Rows are sorted in ranges and written once; a range's own folds are completed by those of the ranges before it, of which a key has one
    row each, so a key that holds most rows is many tasks' work. Nulls add nothing.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apply, both = {"sum": F.sum, "max": F.max}, {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    given = rows.withColumns({f"__{name}": column for name, (_, column) in folds.items()})
    by = [*map(c, keys), *order]
    dealt = written(given.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    of = lambda name, kind: apply[kind](f"__{name}")
    totals = dealt.groupBy("__part", *keys).agg(*[of(name, kind).alias(f"__{name}") for name, (kind, _) in folds.items()])
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", *[c(k).alias(f"__key_{k}") for k in keys], *[of(name, kind).over(ahead).alias(f"__before_{name}") for name, (kind, _) in folds.items()])
    so_far = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"__{name}": of(name, kind).over(so_far) for name, (kind, _) in folds.items()}).withColumnRenamed("__part", "__own")
    same = c("__own") == c("__part")
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"__key_{k}"))
    met = local.join(carried, same)
    return met.select(*rows.columns, *[both[kind](c(f"__{name}"), c(f"__before_{name}")).alias(name) for name, (kind, _) in folds.items()])


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """`rows` with `island`: how many rows of the keys so far start one."""
    return running(rows.withColumn("__start", starts), keys, [c(order)], island=("sum", c("__start").cast("long"))).drop("__start")


def collapsed_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values as one row: keys, run, value, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~c(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return islands(rows.withColumn("new", new), keys, order, c("new")).groupBy(*keys, c("island").alias("run"), value).agg(F.count("*").alias("n"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """For each percent the value at index round((n - 1) * p / 100) of the sorted values, not interpolated. Values are ranked in ranges, so a key
    that holds most rows is many tasks' work."""
    ranked = ranks_per_key(rows.select(*keys, value), keys, [c(value)], "__i")
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("__n"))
    index = {p: F.floor((c("__n") - 1) * p / 100 + 0.5) for p in percents}
    hit = ranked.join(sizes, keys).filter(c("__i").isin(*index.values()))
    return hit.groupBy(*keys).agg(*[F.max(F.when(c("__i") == i, c(value))).alias(f"p{p}") for p, i in index.items()])


def within_budget(rows: DataFrame, keys: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Rows that begin before the sizes of the rows ahead of them reach the budget."""
    spent = running(rows.withColumn("__size", size), keys, [c(order)], __spent=("sum", c("__size")))
    return spent.filter(c("__spent") - F.coalesce("__size", F.lit(0)) < budget).drop("__size", "__spent")


def last_definition(uses: DataFrame, keys: list[str], line: str, is_def: str) -> DataFrame:
    """`uses` with `def_line`: the last line before this one, of the same keys, that defines; null if none."""
    w = Window.partitionBy(*keys).orderBy(line).rangeBetween(Window.unboundedPreceding, -1)
    return uses.withColumn("def_line", F.max(F.when(c(is_def), c(line))).over(w))


def capped_per_key(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(c("rn") <= most).drop("rn")


def sequence_numbers(new: DataFrame, old: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """`new` with `number` going on from the highest of each key in `old`."""
    top = old.groupBy(key).agg(F.max(number).alias("top"))
    w = Window.partitionBy(key).orderBy(order)
    return new.join(top, key, "left").withColumn(number, F.coalesce("top", F.lit(0)) + F.row_number().over(w)).drop("top")


def purge_path(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes not of this path, and edges that touch none of those that are."""
    gone = nodes.filter(c("path") == path).select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.filter(c("path") != path), left.select(*edges.columns)


def global_ranks(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with their ranks, from 0, in an order that should have no ties. Rows are sorted in ranges and written once; what is added to a
    range's own ranks is how many rows the ranges before it hold, so no task has all rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": at}), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # `n` rows
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, c("__before") + c("__at")).drop("__part", "__at", "__before")


def ranks_per_key(rows: DataFrame, key: str | list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with their ranks, from 0, among the rows of their key, however many rows a key has."""
    keys = [key] if isinstance(key, str) else key
    ranked = global_ranks(rows, [*map(c, keys), *order], name)
    first = ranked.groupBy(*keys).agg(F.min(name).alias("__first"))
    return ranked.join(first, keys).withColumn(name, c(name) - c("__first")).drop("__first")


def event_trace(rows: DataFrame, topic: str, role: str, who: str) -> DataFrame:
    """Who emits and who subscribes to each topic, each once, with `others`: how many are on its other side. Emitters aren't joined
    with subscribers, for a topic that all share would give all pairs."""
    each = rows.select(topic, role, who).distinct()
    sides = each.groupBy(topic).agg(F.count_if(c(role) == "emits").alias("emitters"), F.count_if(c(role) == "subscribes").alias("subscribers"))
    return each.join(sides, topic).select(topic, role, who, F.when(c(role) == "emits", c("subscribers")).otherwise(c("emitters")).alias("others"))
