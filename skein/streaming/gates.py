"""Stateful stream operators, each with the batch table that it must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.relational import running
from skein.streaming.changes import starts

c = F.col


def last_per_path(changes: DataFrame) -> DataFrame:
    """(path, kind, seq): the last event of each path decides whether it is changed or deleted."""
    return changes.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


def debounced(changes: DataFrame, width: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(window_start, path, kind, seq) of a stream or table: the last event of each path in each window of event time."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq")).select(c("w.start").alias("window_start"), "path", "kind", "seq")


def apply_batches(changes: DataFrame, sink: Callable[[DataFrame, DataFrame], None], checkpoint: str):
    """Start a query that hands each micro-batch's deleted and changed paths to `sink`, deletions first."""

    def each(batch: DataFrame, _: int) -> None:
        last = last_per_path(batch)
        sink(last.filter("kind = 'deleted'"), last.filter("kind <> 'deleted'"))

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def unseen(items: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key and hash the ledger lacks: the gate of an incremental index."""
    return items.join(ledger.select(*keys), keys, "left_anti")


def _accepted(times: list[tuple[float, int]], last: float | None, wait: float) -> tuple[list[int], float | None]:
    out = []
    for at, seq in sorted(times):
        if last is None or at - last >= wait:
            out.append(seq)
            last = at
    return out, last


def cooled_down(events: DataFrame, key: str, seconds: float = 60.0) -> DataFrame:
    """(key, seq) of the events accepted: none within `seconds` of the last accepted one of its key. Batch form."""
    rows = events.select(key, F.unix_micros(c("ts").cast("timestamp")).alias("at"), "seq")
    accepted = starts(rows, key, "at", round(seconds * 1_000_000)).withColumnRenamed("start", "at")
    return rows.join(accepted, [key, "at"]).groupBy(key, "at").agg(F.min("seq").alias("seq")).select(key, "seq")


def cooled_down_stream(events: DataFrame, key: str, seconds: float = 60.0) -> DataFrame:
    """cooled_down() of a stream: the last accepted time of each key is its state."""
    kind = dict(events.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = [x for f in frames for x in zip(f["at"], f["seq"])]
        last = state.get[0] if state.exists else None
        kept, last = _accepted(times, last, seconds)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "seq": kept})

    return events.select(key, c("ts").cast("timestamp").cast("double").alias("at"), "seq").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long", "last double", "append", GroupStateTimeout.NoTimeout)


def latched(events: DataFrame, key: str, seq: str, value: str, threshold: float) -> DataFrame:
    """(key, seq): the first event at which the running sum of a key's values reaches the threshold; one for each key at most."""
    sums = running(events.select(key, seq, value), [key], [c(seq)], __sum=("sum", c(value)))
    return sums.filter(c("__sum") >= threshold).groupBy(key).agg(F.min(seq).alias(seq))


def evicted(loads: DataFrame, key: str, now_s: int, idle_s: int = 1800, age_s: int = 1800) -> DataFrame:
    """Keys whose last access is idle_s or more ago, or that were loaded age_s or more ago."""
    return loads.groupBy(key).agg(F.max("accessed_s").alias("last"), F.min("loaded_s").alias("loaded")).filter((c("last") <= now_s - idle_s) | (c("loaded") <= now_s - age_s)).select(key)


def after_earlier(events: DataFrame, key: str, seq: str, need: str, then: str, event: str = "event") -> DataFrame:
    """(key, seq) of events `then` with an event `need` of the key before them."""
    own = (c(event) == need).cast("long")
    seen = running(events.select(key, seq, event), [key], [c(seq)], __seen=("sum", own))
    return seen.filter((c(event) == then) & (c("__seen") - own > 0)).select(key, seq)


def reconciled(registry: DataFrame, bound: DataFrame) -> DataFrame:
    """(slug, action, path): projects of the registry (slug, path) that aren't bound are added; bound ones (slug, source_path) that it lacks are removed,
    unless they have no source path, for those never came from it."""
    add = registry.join(bound.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.max("path").alias("path"))
    gone = bound.filter("source_path IS NOT NULL").join(registry.select("slug"), "slug", "left_anti").select("slug", c("source_path").alias("path")).distinct()
    return add.select("slug", F.lit("add").alias("action"), "path").unionByName(gone.select("slug", F.lit("remove").alias("action"), "path"))


def reconcile_batches(changes: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], sink: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that reconciles once for each micro-batch of changes to the registry, however many it holds; `load` gives registry and bound projects."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sink(reconciled(*load()))

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def embedded(chunks: DataFrame, text: str, embed: Callable[[list[str | None]], list[list[float]]], size: int = 256) -> DataFrame:
    """`chunks` with an `embedding` of their texts, asked for in batches of `size` and a last one of what is left of a partition.

    Partitions are pulled, so no more than a batch waits. Where `embed` raises, the rows of that batch have a null embedding and the rest goes on.
    """
    schema = chunks.drop("embedding").withColumn("embedding", F.array().cast("array<double>")).schema
    schema["embedding"].nullable = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                found = [list(map(float, v)) for v in embed(list(batch[text]))]
                if len(found) != len(batch):
                    raise ValueError(f"{len(found)} vectors for {len(batch)} texts")
            except Exception:  # whatever a model raises costs its own batch alone
                found = [None] * len(batch)
            return batch.assign(embedding=pd.Series(found, index=batch.index, dtype=object))

        left = None
        for frame in frames:
            left = frame if left is None else pd.concat([left, frame], ignore_index=True)
            while len(left) >= size:
                yield one(left.iloc[:size])
                left = left.iloc[size:]
        if left is not None and len(left):
            yield one(left)

    return chunks.drop("embedding").mapInPandas(run, schema)
