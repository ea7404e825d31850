"""Queries over the batch forms of the stream operators; tests run the streams against them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.plans.registry import query
from skein.sources.storage import shared_dir
from skein.streaming import changes as C
from skein.streaming import gates as G
from skein.streaming import sinks as K

c = F.col


def _starts_sql(rows: str, key: str, gap: str) -> str:
    """CTE w (key, start): each key's first time, then ever the first one `gap` or more after the last."""
    return f"""e AS ({rows}), u AS (SELECT DISTINCT {key}, tm FROM e), w AS (
      SELECT {key}, min(tm) AS start FROM u GROUP BY {key}
      UNION ALL SELECT {key}, nx FROM (SELECT w.{key}, (SELECT min(u.tm) FROM u WHERE u.{key} = w.{key} AND u.tm >= w.start + {gap}) AS nx FROM w) WHERE nx IS NOT NULL)"""


@query(
    "x01_debounce",
    f"""WITH RECURSIVE {_starts_sql("SELECT split_part(path, '/', 1) AS root, epoch_us(ts) AS tm, path, kind, seq FROM {file_events}", "root", "14400000000")}
    SELECT start, CASE WHEN arg_max(kind, (tm, seq)) = 'deleted' THEN 0 ELSE 1 END AS step, path, arg_max(kind, (tm, seq)) AS kind, arg_max(seq, (tm, seq)) AS seq
    FROM e JOIN w USING (root) WHERE tm >= start AND tm < start + 14400000000 GROUP BY start, path""",
)
def _(t):
    """Bursts of four hours from their first change on, as the table's changes are minutes apart; the operator's own width is 300 ms."""
    changes = t.file_events.withColumn("root", F.substring_index("path", "/", 1))
    return C.bursts(changes, "root", 4 * 3600 * 1000).drop("root")


@query("x02_reindex_gate", "SELECT path, seq FROM {file_events} f WHERE NOT EXISTS (SELECT 1 FROM {file_events} g WHERE g.path = f.path AND g.kind = f.kind AND g.seq < 5000 AND g.kind = 'deleted')")
def _(t):
    ledger = t.file_events.filter("seq < 5000 AND kind = 'deleted'").select("path", "kind").distinct()
    return G.unseen(t.file_events, ledger, ["path", "kind"]).select("path", "seq")


@query(
    "x07_cool_down",
    f"""WITH RECURSIVE {_starts_sql("SELECT user_id, epoch_us(ts) AS tm, event_id AS seq FROM {events}", "user_id", "21600000000")}
    SELECT user_id, min(seq) AS seq FROM e JOIN w USING (user_id) WHERE tm = start GROUP BY user_id, tm""",
)
def _(t):
    events = t.events.select("user_id", "ts", c("event_id").alias("seq"))
    return G.cooled_down(events, "user_id", 6 * 3600.0)


@query("x08_after_earlier", "SELECT session_id, seq FROM (SELECT *, max(CASE WHEN event = 'impact' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {enforcement}) WHERE event = 'enforcement_block' AND seen = 1")
def _(t):
    return G.after_earlier(t.enforcement, "session_id", "seq", "impact", "enforcement_block")


@query("x09_latch", "SELECT user_id, min(event_id) AS event_id FROM (SELECT *, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM {events}) WHERE s >= 100000 GROUP BY user_id")
def _(t):
    return G.latched(t.events.withColumn("cents", F.round(c("value") * 100).cast("long")), "user_id", "event_id", "cents", 100_000)


@query("x06_eviction", "SELECT user_id FROM {events} GROUP BY user_id HAVING max(event_id) <= 9900 OR min(event_id) <= 20")
def _(t):
    loads = t.events.select("user_id", c("event_id").alias("accessed_s"), c("event_id").alias("loaded_s"))
    return G.evicted(loads, "user_id", 10_000, 100, 9980)


@query("x10_running_usage", "SELECT session_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM (SELECT DISTINCT * FROM {turn_usage}) GROUP BY session_id")
def _(t):
    """Every third line comes twice, as it does when a file of lines is read again; the operator counts it once."""
    at = F.timestamp_seconds(c("session_id") * 60 + c("seq"))
    lines = t.turn_usage.select("session_id", F.xxhash64("*").alias("line_id"), at.alias("ts"), "input_tokens", "output_tokens")
    return K.running_usage(lines.unionByName(lines.filter("pmod(line_id, 3) = 0")))


_ENTRIES = "SELECT event_id AS id, event_type AS kind, CAST(event_id % 6 AS INT) AS batch FROM {events}"
_CAP = 60_000


@query(
    "k23_history_cap",
    f"""WITH RECURSIVE h AS ({_ENTRIES}), s AS (SELECT batch, sum(strlen(concat('{{"id":', id, ',"kind":"', kind, '"}}')) + 1) AS size FROM h GROUP BY batch),
    f AS (SELECT 0 AS batch, 0 AS since, (SELECT size FROM s WHERE batch = 0) AS held
      UNION ALL SELECT f.batch + 1, CASE WHEN held >= {_CAP} THEN f.batch + 1 ELSE since END, CASE WHEN held >= {_CAP} THEN size ELSE held + size END FROM f JOIN s ON s.batch = f.batch + 1)
    SELECT id, kind FROM h WHERE batch >= (SELECT since FROM f WHERE batch = 5)""",
)
def _(t):
    """Six appends, each made twice, to a history that is begun anew once it has so many bytes."""
    log = K.Log(t.spark, f"{shared_dir(t.spark)}/history_{uuid.uuid4().hex}", "id long, kind string", _CAP)
    entries = t.events.select(c("event_id").alias("id"), c("event_type").alias("kind"), (c("event_id") % 6).alias("batch"))
    for n in range(6):
        for _ in range(2):
            log.append(entries.filter(c("batch") == n).drop("batch"), n)
    return log.read()


@query("k29_appenders", "SELECT CASE WHEN value > 50 THEN 'phase' ELSE 'usage' END AS log, event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END IS NOT NULL, false) AS dated FROM {events}")
def _(t):
    """Usage and phase records in a log each; a record without a time gets that of its writing."""
    rows = t.events.select(c("event_id").alias("id"), F.when(c("event_id") % 2 == 0, c("ts").cast("timestamp")).alias("ts"), F.when(c("value") > 50, "phase").otherwise("usage").alias("log"))
    out = None
    for name in ("usage", "phase"):
        log = K.Log(t.spark, f"{shared_dir(t.spark)}/{name}_{uuid.uuid4().hex}", "id long, ts timestamp")
        log.append(rows.filter(c("log") == name).drop("log"), 0, ts="ts")
        one = log.read().select(F.lit(name).alias("log"), "id", (c("ts") < F.lit("2026-01-01").cast("timestamp")).alias("dated"))
        out = one if out is None else out.unionByName(one)
    return out


@query("x03_embedding_batches", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(length(text) AS DOUBLE) END AS size FROM {documents}")
def _(t):
    rows = t.documents.select("doc_id", "text")
    return G.embedded(rows, "text", lambda texts: [[len(x)] for x in texts]).select("doc_id", F.get("embedding", F.lit(0)).alias("size"))


@query(
    "x05_registry_reconcile",
    """WITH b AS (SELECT s_suppkey * 20 AS k, s_suppkey % 2 = 0 AS known FROM {supplier}) SELECT concat('p', c_custkey) AS slug, 'add' AS action, c_name AS path FROM {customer} WHERE c_custkey NOT IN (SELECT k FROM b)
    UNION ALL SELECT concat('p', k), 'remove', concat('/', k) FROM b WHERE known AND k NOT IN (SELECT c_custkey FROM {customer})""",
)
def _(t):
    id_ = c("s_suppkey") * 20
    bound = t.supplier.select(F.concat(F.lit("p"), id_).alias("slug"), F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("/"), id_)).alias("source_path"))
    return G.reconciled(t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("slug"), c("c_name").alias("path")), bound)
