"""Streams against their batch forms, over restarts and replays."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from skein.streaming import changes as C
from skein.streaming import gates
from skein.streaming import sinks as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def greedy(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def test_starts_equal_a_loop(spark):
    rnd = random.Random(1)
    events = [(k, rnd.randint(0, 3000)) for k in ("a", "b", None) for _ in range(200)] + [("far", 5), ("far", 1_000_000), ("one", 7)]
    got = C.starts(spark.createDataFrame(events, "k string, t long"), "k", "t", 30)
    by = {}
    for k, t in events:
        by.setdefault(k, set()).add(t)
    assert rows(got.filter("k IS NOT NULL")) == sorted(((k, s) for k, ts in by.items() if k for s in greedy(ts, 30)), key=str)


def change_rows():
    rnd = random.Random(5)
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    burst = lambda start, n, seq: [("r", at(start + rnd.randint(0, 290)), f"f{rnd.randint(0, 3)}", rnd.choice(["changed", "deleted", "created"]), seq + i) for i in range(n)]
    first = [("r", at(0), "f0", "created", 0), *burst(0, 6, 1)]
    second = [("r", at(700), "f1", "deleted", 20), *burst(700, 6, 21), ("q", at(900), "x", "changed", 40)]
    third = [("r", at(5000), "f9", "changed", 50), ("r", at(5299), "f9", "deleted", 51), ("r", at(5300), "f9", "created", 52)]
    return [first, second, third, [("end", at(100_000), "z", "changed", 99)]]


def test_bursts_of_a_stream_equal_the_batch_form(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "root string, ts timestamp, path string, kind string, seq long"
    parts = change_rows()
    table = spark.createDataFrame([r for p in parts for r in p], kind)
    want = [r for r in rows(C.bursts(table).select("root", "start", "step", "path", "kind", "seq")) if r[0] != "end"]
    assert len({r[1] for r in want if r[0] == "r"}) == 4
    got = []
    for n, part in enumerate(parts):  # a restart after each part
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = C.bursts_stream(spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda d, _: got.extend(map(tuple, d.collect())) and None).start()
        assert q.awaitTermination(240)
    assert sorted(got, key=str) == want
    order = [(r[1], r[2]) for r in got if r[0] == "r"]
    assert order == sorted(order)  # deletions of a burst come before its changes
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_cool_down_equals_a_loop(spark):
    rnd = random.Random(3)
    events = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 500)), i) for i, u in enumerate(rnd.choices([1, 1, 1, 2], k=150))]
    got = rows(gates.cooled_down(spark.createDataFrame(events, "u long, ts timestamp, seq long"), "u", 60.0))
    want, last = [], {}
    for u, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        if u not in last or (t - last[u]).total_seconds() >= 60:
            want.append((u, i))
            last[u] = t
    assert got == sorted(want, key=str)


def test_file_changes_over_a_restart(spark, tmp_path):
    spark.dataSource.register(C.FileChanges)
    root, seen = tmp_path / "src", []
    (root / "a").mkdir(parents=True)
    (root / ".git").mkdir()
    put = lambda name, text: (root / name).write_text(text)

    def run():
        stream = spark.readStream.format("file_changes").option("path", str(root)).option("manifests", str(tmp_path / "m")).load()
        before = len(seen)
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda d, _: seen.extend((r.path, r.kind) for r in d.collect())).start()
        q.processAllAvailable()
        q.stop()
        return sorted(seen[before:])

    put("a/one", "1"), put("two", "2"), put(".git/x", "no")
    assert run() == [("a/one", "created"), ("two", "created")]
    put("two", "changed"), put("a/three", "3"), os.remove(root / "a/one")
    assert run() == [("a/one", "deleted"), ("a/three", "created"), ("two", "changed")]
    assert run() == []
    os.remove(root / "two"), put("two", "back"), put(".git/x", "still no")
    assert run() == [("two", "changed")]


def test_running_usage_counts_replayed_lines_once(spark, tmp_path):
    kind = "session_id long, line_id long, ts timestamp, input_tokens long, output_tokens long"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    lines = [(i % 3, i, at(i), i, 2 * i) for i in range(60)]
    late = [(0, 1000, at(20), 5, 5)]
    parts = [lines[:30], lines[10:45], lines[40:] + late + late]
    log = S.Log(spark, f"file://{tmp_path}/log", "session_id long, lines long, input_tokens long, output_tokens long, batch long")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        assert S.usage_snapshots(stream, log, f"{tmp_path}/c").awaitTermination(240)
    assert rows(S.last_usage(log)) == rows(S.running_usage(spark.createDataFrame([r for p in parts for r in p], kind)))


def test_log_takes_a_batch_once_and_survives_a_crash(spark, tmp_path, monkeypatch):
    log = S.Log(spark, f"file://{tmp_path}/log", "id long, ts timestamp", cap=400)
    batch = lambda a, b: spark.range(a, b).select("id", F.lit(None).cast("timestamp").alias("ts"))
    ids = lambda: sorted(r.id for r in log.read().collect())
    assert log.read().collect() == [] and log.append(batch(0, 3), 0, ts="ts") and not log.append(batch(0, 3), 0, ts="ts")
    assert ids() == [0, 1, 2] and log.read().filter("ts IS NULL").count() == 0
    real = log._swap

    def crash(new):
        raise OSError("killed")

    monkeypatch.setattr(log, "_swap", crash)
    with pytest.raises(OSError):
        log.append(batch(3, 5), 1, ts="ts")
    assert ids() == [0, 1, 2]
    monkeypatch.setattr(log, "_swap", real)
    assert log.append(batch(3, 5), 1, ts="ts") and ids() == [0, 1, 2, 3, 4]
    log.compact()
    assert ids() == [0, 1, 2, 3, 4] and len(log.manifest().parts) == 1
    assert log.append(batch(5, 12), 2, ts="ts") and sum(b for _, b in log.manifest().parts) >= 400
    assert log.append(batch(12, 13), 3, ts="ts") and ids() == [12]  # the cap was reached before
    log.vacuum()
    assert ids() == [12] and len(os.listdir(tmp_path / "log/parts")) == 1
    log.clear()
    assert ids() == [] and not log.append(batch(0, 1), 3)
    stale = S.Log(spark, f"file://{tmp_path}/log", "id long, ts timestamp")
    version = stale.manifest().version
    assert log.append(batch(0, 1), 4)
    with pytest.raises(RuntimeError):
        stale._swap(S.Manifest(version + 1, {}, []))


def test_append_stream_replays_nothing(spark, tmp_path):
    log = S.Log(spark, f"file://{tmp_path}/log", "id long")
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    assert S.append_stream(stream(), log, f"{tmp_path}/c").awaitTermination(120)
    assert S.append_stream(stream(), log, f"{tmp_path}/other").awaitTermination(120)  # as if the checkpoint had been lost
    assert sorted(r.id for r in log.read().collect()) == [0, 1, 2, 3, 4]


def test_starts_of_one_full_bucket_carry_no_lists(spark):
    """Each time carried all times of two buckets with it, so a bucket of n times was n * n numbers in memory."""
    times = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    got = C.starts(times, "k", "t", 7_000)
    assert rows(got) == [("k", 0), ("k", 14_000), ("k", 7_000)]
