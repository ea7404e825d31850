"""A stream of changed files, and bursts of changes that end after a quiet start."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.sources.storage import written

c = F.col
CHANGE = "path string, kind string, snapshot long"


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.rows = rows


class _Snapshots(DataSourceStreamReader):
    """An offset names a snapshot: a file of `manifests` with the size and time of every file. A batch is the difference of two."""

    ROWS = 10_000

    def __init__(self, root: str, manifests: str, skipped: list[str]):
        self.root, self.manifests, self.skipped = root.rstrip("/"), manifests, skipped

    def _file(self, offset: dict) -> str:
        return os.path.join(self.manifests, f"{offset['snapshot']:012d}-{offset['id']}.json")

    def _load(self, offset: dict) -> dict[str, list[int]]:
        if not offset["snapshot"]:
            return {}
        with open(self._file(offset)) as f:
            return json.load(f)

    def _listed(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        folders = [self.root]
        while folders:
            try:
                entries = list(os.scandir(folders.pop()))
            except FileNotFoundError:  # gone since it was listed
                continue
            for e in entries:
                if any(fnmatch(e.name, s) for s in self.skipped):
                    continue
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    try:
                        s = e.stat()
                    except FileNotFoundError:
                        continue
                    out[e.path[len(self.root) + 1 :]] = [s.st_size, s.st_mtime_ns]
        return out

    def initialOffset(self) -> dict:
        return {"snapshot": 0, "id": ""}

    def latestOffset(self) -> dict:
        os.makedirs(self.manifests, exist_ok=True)
        names = sorted(n for n in os.listdir(self.manifests) if n.endswith(".json"))
        last = {"snapshot": int(names[-1][:12]), "id": names[-1][13:-5]} if names else self.initialOffset()
        now = self._listed()
        if now == self._load(last):
            return last
        new = {"snapshot": last["snapshot"] + 1, "id": uuid.uuid4().hex}
        with open(self._file(new) + ".part", "w") as f:
            json.dump(now, f)
        os.rename(self._file(new) + ".part", self._file(new))  # a snapshot is there whole or not at all
        return new

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        old, new = self._load(start), self._load(end)
        rows = [(p, "deleted", end["snapshot"]) for p in sorted(old.keys() - new.keys())]
        rows += [(p, "created" if p not in old else "changed", end["snapshot"]) for p in sorted(new) if old.get(p) != new[p]]
        return [_Part(rows[i : i + self.ROWS]) for i in range(0, len(rows), self.ROWS)]

    def read(self, partition: _Part) -> Iterator[tuple[str, str, int]]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.manifests):  # snapshots before the one that the next batch begins at
            if name.endswith(".json") and int(name[:12]) < end["snapshot"] - 1:
                os.remove(os.path.join(self.manifests, name))


class FileChanges(DataSource):
    """`file_changes`: (path, kind, snapshot) of the files below a mounted folder that were created, changed (in size or time) or deleted.

    Options: `path`, the folder; `manifests`, a shared folder for snapshots, which with the query's checkpoint makes a restarted
    stream go on where it stopped; `skipped`, names of folders and files to leave out, with `*`, comma-separated. Every state of the
    tree between two batches is one change a file. The listing is the driver's work; rows go out in parts.
    """

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        skipped = [s for s in self.options.get("skipped", ".git,node_modules,target").split(",") if s]
        return _Snapshots(self.options["path"], self.options["manifests"], skipped)


def starts(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, start): the first time of each key, then ever the first time `gap` or more after the last start. `at` and `gap` are whole numbers.

    Times lie in buckets of width `gap`, so what is `gap` after a time is in the next bucket: sorted together, the times of a bucket and those asked
    for give each pointer by a running minimum from the end, and where the bucket has none, the next bucket's first time is it. The starts are those
    that a key's first time reaches, in as many doubled steps as the logarithm of their number.
    """
    per = events.select(key, c(at).alias("at")).distinct()
    bucket = lambda x: F.floor(c(x) / gap)
    there = per.select(key, bucket("at").alias("bucket"), c("at").alias("v"), c("at").alias("time"), F.lit(None).cast("long").alias("from"))
    asked = per.select(key, (bucket("at") + 1).alias("bucket"), (c("at") + gap).alias("v"), F.lit(None).cast("long").alias("time"), c("at").alias("from"))
    # from the latest on; a time stands before what asks for it
    back = Window.partitionBy(key, "bucket").orderBy(F.desc("v"), F.col("from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = there.unionByName(asked).withColumn("next", F.min("time").over(back)).filter("from IS NOT NULL").select(key, "bucket", c("from").alias("at"), "next")
    first = per.groupBy(key, bucket("at").alias("bucket")).agg(F.min("at").alias("first"))  # a row for each bucket, as are the buckets asked of
    heads = first.unionByName(first.select(key, (c("bucket") + 1).alias("bucket"), F.lit(None).cast("long").alias("first"))).groupBy(key, "bucket").agg(F.min("first").alias("first"))
    ahead = heads.select(key, "bucket", F.min("first").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    step = written(met.join(ahead, [key, "bucket"]).select(key, "at", F.coalesce("next", "later").alias("next")).filter("next IS NOT NULL"), "pointers")
    steps = [step]
    while True:
        last = steps[-1]
        further = written(last.join(last.select(key, c("at").alias("next"), c("next").alias("after")), [key, "next"]).select(key, "at", c("after").alias("next")), "pointers")
        if not further.limit(1).count():
            break
        steps.append(further)
    found = per.groupBy(key).agg(F.min("at").alias("at"))
    for jump in reversed(steps):
        found = written(found.unionByName(found.join(jump, [key, "at"]).select(key, c("next").alias("at"))), "starts")
    return found.select(key, c("at").alias("start"))


def bursts(changes: DataFrame, key: str = "root", gap_ms: int = 300) -> DataFrame:
    """(key, start, step, path, kind, seq) of changes (key, ts, path, kind, seq): the bursts of each key, each of `gap_ms` from its first
    change on; the last change of a path in a burst counts, deletions (step 0) before others (step 1). Batch form; start in microseconds."""
    gap = gap_ms * 1000
    rows = changes.withColumn("at", F.unix_micros(c("ts").cast("timestamp")))
    first = starts(rows, key, "at", gap)
    near = first.withColumn("bucket", F.explode(F.array(F.floor(c("start") / gap), F.floor(c("start") / gap) + 1)))
    both = rows.withColumn("bucket", F.floor(c("at") / gap)).join(near, [key, "bucket"]).filter((c("start") <= c("at")) & (c("at") < c("start") + gap))
    last = both.groupBy(key, "start", "path").agg(F.max_by(F.struct("kind", "seq"), F.struct("at", "seq")).alias("last"))
    return last.select(key, "start", F.when(c("last.kind") == "deleted", 0).otherwise(1).alias("step"), "path", "last.kind", "last.seq")


class _Bursts(StatefulProcessor):
    """Pending changes of a key; a timer `gap` after the first of them ends its burst."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, path string, kind string, seq long")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "start", "step", "path", "kind", "seq"], dtype=object)

    def _timer(self, first: int) -> None:
        self.handle.registerTimer((first + self.gap + 999) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.pending.get())
        new = [tuple(r) for f in rows for r in f[["at", "path", "kind", "seq"]].itertuples(index=False, name=None)]
        new = [(int(a), p, k, int(s)) for a, p, k, s in new]
        first = min((int(r[0]) for r in held), default=None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.pending.appendList(new)
        self._timer(min(x for x in (first, min((r[0] for r in new), default=None)) if x is not None))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted((int(a), int(s), p, k) for a, p, k, s in self.pending.get())
        watermark, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        while held and held[0][0] + self.gap <= watermark:  # later bursts may be over too
            start = held[0][0]
            mine, held = [r for r in held if r[0] < start + self.gap], [r for r in held if r[0] >= start + self.gap]
            last = {p: (k, s) for _, s, p, k in mine}
            out += sorted((start, int(k != "deleted"), p, k, s) for p, (k, s) in last.items())
        self.pending.clear()
        if held:
            self.pending.put([(a, p, k, s) for a, s, p, k in held])
            self._timer(held[0][0])
        yield self._frame([(key[0], *r) for r in out])


def bursts_stream(changes: DataFrame, key: str = "root", gap_ms: int = 300, late: str = "1 second") -> DataFrame:
    """bursts() of a stream: a burst comes out when the watermark has passed its end. Needs the RocksDB state store."""
    kind = dict(changes.dtypes)[key]
    rows = changes.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), "path", "kind", c("seq").cast("long").alias("seq"))
    return rows.groupBy(key).transformWithStateInPandas(_Bursts(key, gap_ms * 1000), f"{key} {kind}, start long, step int, path string, kind string, seq long", "Append", "EventTime")
