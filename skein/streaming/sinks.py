"""Append sinks: a log in shared storage whose manifest names its parts, and running totals over it.

A batch's rows are written first; then a new manifest takes the place of the last. So readers see a batch whole or not at all, a batch that
comes again is known by its number, and what a crash left between the two steps is never named.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: Fixed value: a history of so many bytes is begun anew before the next append.
HISTORY_BYTES = 512 * 1024


@dataclass
class Manifest:
    """Version, the last batch of each writer, and (folder, bytes) of the parts, oldest first."""

    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    parts: list[tuple[str, int]] = field(default_factory=list)


class Log:
    """Rows of JSON lines under a folder. `cap` bytes or more are let go before an append; None keeps all."""

    def __init__(self, spark: SparkSession, path: str, schema: str, cap: int | None = None):
        self.spark, self.path, self.schema, self.cap = spark, path.rstrip("/"), schema, cap

    # the folder may be in any store that Spark reaches
    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _store(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        store = self._store()
        if not store.exists(self._at("manifests")):
            return Manifest()
        names = sorted(n for s in store.listStatus(self._at("manifests")) if (n := s.getPath().getName()).endswith(".json"))
        if not names:
            return Manifest()
        line = self.spark.read.text(f"{self.path}/manifests/{names[-1]}").first().value
        found = json.loads(line)
        return Manifest(found["version"], found["batches"], [tuple(p) for p in found["parts"]])

    def _swap(self, new: Manifest) -> None:
        """Put a manifest in the last one's place; an error if another writer did so first."""
        store, name = self._store(), f"{new.version:012d}.json"
        draft = self._at(f"manifests/{name}.{uuid.uuid4().hex}.part")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(vars(new)).encode()))
        out.close()
        if store.exists(self._at(f"manifests/{name}")) or not store.rename(draft, self._at(f"manifests/{name}")):
            raise RuntimeError(f"{self.path}: version {new.version} is another writer's")

    def append(self, rows: DataFrame, batch: int, writer: str = "main", ts: str | None = None) -> bool:
        """Add a batch unless it or a later one of its writer is there; whether it was added. A null `ts` becomes the time of writing."""
        now = self.manifest()
        if batch <= now.batches.get(writer, -1):
            return False
        stamped = rows if ts is None else rows.withColumn(ts, F.coalesce(ts, F.current_timestamp()))
        part = f"parts/{writer}-{batch:012d}-{uuid.uuid4().hex}"
        stamped.select(F.to_json(F.struct(*stamped.columns)).alias("value")).write.text(f"{self.path}/{part}")
        size = self.spark.read.schema("value string").text(f"{self.path}/{part}").agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
        full = self.cap is not None and sum(b for _, b in now.parts) >= self.cap
        self._swap(Manifest(now.version + 1, now.batches | {writer: batch}, ([] if full else now.parts) + [(part, size)]))
        return True

    def read(self) -> DataFrame:
        parts = [f"{self.path}/{p}" for p, _ in self.manifest().parts]
        return self.spark.read.schema(self.schema).json(parts) if parts else self.spark.createDataFrame([], self.schema)

    def clear(self) -> None:
        """Let go of all rows; batches that were there stay known."""
        now = self.manifest()
        self._swap(Manifest(now.version + 1, now.batches, []))

    def compact(self) -> None:
        """All parts as one."""
        now = self.manifest()
        part = f"parts/all-{uuid.uuid4().hex}"
        self.read().select(F.to_json(F.struct("*")).alias("value")).write.text(f"{self.path}/{part}")
        self._swap(Manifest(now.version + 1, now.batches, [(part, sum(b for _, b in now.parts))]))

    def vacuum(self) -> None:
        """Remove parts and manifests that the last manifest doesn't name; no reader or writer should be at work."""
        now, store = self.manifest(), self._store()
        keep = {p.split("/")[-1] for p, _ in now.parts} | {f"{now.version:012d}.json"}
        for folder in ("parts", "manifests"):
            if store.exists(self._at(folder)):
                for s in store.listStatus(self._at(folder)):
                    if s.getPath().getName() not in keep:
                        store.delete(s.getPath(), True)


def append_stream(rows: DataFrame, log: Log, checkpoint: str, ts: str | None = None):
    """Start a query that appends each micro-batch to the log once, however often it is replayed."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: log.append(batch, n, "stream", ts) and None).start()


def running_usage(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """(session_id, lines, input_tokens, output_tokens) of a stream or table of lines (session_id, line_id, ts, input_tokens, output_tokens): a
    line that comes again with its id, within `late` of itself, counts once. A stream gives the totals of the sessions that changed."""
    marked = lines.withWatermark("ts", late)
    once = marked.dropDuplicatesWithinWatermark(["session_id", "line_id"]) if lines.isStreaming else marked.dropDuplicates(["session_id", "line_id"])
    return once.groupBy("session_id").agg(F.count("*").alias("lines"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def usage_snapshots(lines: DataFrame, log: Log, checkpoint: str, late: str = "1 hour"):
    """Start a query that keeps running_usage() in a log: each micro-batch appends the totals that changed."""
    return running_usage(lines, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: log.append(batch.withColumn("batch", F.lit(n)), n, "usage") and None).start()


def last_usage(log: Log) -> DataFrame:
    """The last totals of each session in a log of usage_snapshots()."""
    rows = log.read()
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*[x for x in rows.columns if x not in ("session_id", "batch")]), "batch").alias("u")).select("session_id", "u.*")
