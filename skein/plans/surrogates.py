"""The engine's tables, derived from the star-schema and text tables that the queries run on.

Each definition is SQL that Spark and DuckDB both understand, so a query and its SQL counterpart start
from the same rows. `{name}` stands for another table of this module or a base table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from skein.operators.adjacency import Adjacency, Scanned

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED = {
    # one row per turn of a conversation, in order
    "turns": "SELECT CAST(conv_id AS STRING) AS session_id, CAST(turn + 1 AS BIGINT) AS turn_number, role, text AS content FROM {conversations}",
    # symbols of a property graph; parts divisible by 50 are referred to but not defined
    "nodes": """
        SELECT concat('region::', r_name) AS id, 'trait' AS kind, 'core/region.rs' AS path, CAST(r_regionkey AS INT) AS line FROM {region}
        UNION ALL SELECT concat('nation::', n_name), 'type', 'core/nation.rs', CAST(n_nationkey AS INT) FROM {nation}
        UNION ALL SELECT concat('customer::c', c_custkey), 'type', concat('crm/customer', c_custkey % 7, '.py'), CAST(c_custkey AS INT) FROM {customer}
        UNION ALL SELECT concat('supplier::s', s_suppkey), 'function', concat('crm/supplier', s_suppkey % 3, '.py'), CAST(s_suppkey AS INT) FROM {supplier}
        UNION ALL SELECT concat('part::p', p_partkey), 'function', concat('shop/part', p_partkey % 11, '.ts'), CAST(p_partkey AS INT) FROM {part} WHERE p_partkey % 50 <> 0
        UNION ALL SELECT concat('order::o', o_orderkey), 'function', concat('shop/order', o_orderkey % 13, '.ts'), CAST(o_orderkey AS INT) FROM {orders}""",
    "edges": """
        SELECT concat('nation::', n_name) AS src, concat('region::', r_name) AS dst, 'extends' AS kind FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION SELECT concat('customer::c', c_custkey), concat('nation::', n_name), 'declared_in' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION SELECT concat('supplier::s', s_suppkey), concat('nation::', n_name), 'extends' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION SELECT concat('order::o', o_orderkey), concat('customer::c', o_custkey), 'references' FROM {orders}
        UNION SELECT concat('order::o', l_orderkey), concat('part::p', l_partkey), 'calls' FROM {lineitem}
        UNION SELECT concat('part::p', l_partkey), concat('supplier::s', l_suppkey), 'imports' FROM {lineitem} WHERE l_partkey % 50 <> 0
        UNION SELECT concat('supplier::s', l_suppkey), concat('part::p', l_partkey), 'calls' FROM {lineitem}""",
    # edges that were never resolved: their ends are the last segments of names
    "loose_edges": """
        SELECT concat('customer::c', c_custkey) AS src, n_name AS dst, 'references' AS kind FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION SELECT concat('order::o', l_orderkey), concat('p', l_partkey), 'calls' FROM {lineitem}""",
    # an append-only log with decay metadata
    "episodes": """
        SELECT event_id AS id, event_type AS kind, ts, props AS payload, (1 + event_id % 10) / 10.0 AS salience, CAST(event_id % 5 AS BIGINT) AS access_count,
               CAST(event_id AS BIGINT) * 60 AS at_s, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS BIGINT) * 60 + (event_id % 7) * 86400 END AS accessed_s
        FROM {events}""",
    "lessons": """
        SELECT concat(source, ' / ', lang) AS trigger_text, CAST(sum(quality) AS BIGINT) AS success, CAST(count(*) - sum(quality) AS BIGINT) AS failure
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source, lang""",
    "usage": """
        SELECT o_orderkey AS seq, concat('task-', o_orderkey) AS task_id, concat('session-', o_custkey % 40) AS session_id,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS complexity,
               CAST(floor(o_totalprice / 10) AS BIGINT) AS estimated, CAST(sum(CAST(floor(l_extendedprice / 5) AS BIGINT)) AS BIGINT) AS actual, CAST(count(*) AS BIGINT) AS tool_calls,
               CASE WHEN o_orderstatus = 'F' THEN 'claude-sonnet' WHEN o_orderstatus = 'O' THEN 'gpt' ELSE NULL END AS model
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderstatus""",
    "turn_usage": """
        SELECT CAST(l_orderkey AS BIGINT) AS session_id, CAST(l_linenumber AS BIGINT) AS seq,
               CASE l_returnflag WHEN 'A' THEN 'claude-opus-4-1' WHEN 'N' THEN 'claude-sonnet-4' WHEN 'R' THEN 'Claude_Haiku_4_5' ELSE 'other' END AS model,
               CAST(floor(l_quantity * 10) AS BIGINT) AS input_tokens, CAST(floor(l_quantity * 7) AS BIGINT) AS output_tokens,
               CAST(floor(l_extendedprice / 10) AS BIGINT) AS cache_read_tokens, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS cache_write_tokens
        FROM {lineitem}""",
    # tasks that depend on earlier ones; task 1 closes a cycle with task 2 and task 5 waits for one that isn't there
    "tasks": "SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CAST(p_size * 1000 AS BIGINT) AS budget_tokens, CASE p_partkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'skipped' END AS status FROM {part} WHERE p_partkey > 0",
    "task_deps": """
        SELECT id, CAST(floor(id / 2) AS BIGINT) AS dep FROM {tasks} WHERE id >= 2
        UNION SELECT id, CAST(floor(id / 3) AS BIGINT) FROM {tasks} WHERE id >= 3
        UNION SELECT CAST(1 AS BIGINT), CAST(2 AS BIGINT) UNION SELECT CAST(5 AS BIGINT), CAST(-1 AS BIGINT)""",
    "enforcement": """
        SELECT event_id AS seq, user_id AS session_id,
               CASE event_type WHEN 'error' THEN 'enforcement_block' WHEN 'click' THEN 'code_search' WHEN 'view' THEN 'impact' WHEN 'signup' THEN 'enforcement_override' ELSE 'detect_changes' END AS event,
               concat('src/file', event_id % 17, '.rs') AS file, concat('rule-', event_id % 5) AS rule, value FROM {events}""",
    # topics as symbols, who emits and who subscribes to them
    "bus_nodes": "SELECT id, kind, path, line FROM {nodes} UNION ALL SELECT DISTINCT concat('event::bus::', event_type), 'event', 'bus/events.rs', CAST(0 AS INT) FROM {events} WHERE event_type IS NOT NULL",
    "bus_edges": """
        SELECT src, dst, kind FROM {edges} UNION ALL SELECT src, dst, kind FROM {loose_edges}
        UNION ALL SELECT DISTINCT concat('customer::c', user_id), concat('event::bus::', event_type), 'emits' FROM {events} WHERE event_id % 2 = 0 AND event_type IS NOT NULL AND user_id IS NOT NULL
        UNION ALL SELECT DISTINCT concat('event::bus::', event_type), concat('supplier::s', user_id), 'subscribes' FROM {events} WHERE event_id % 2 = 1 AND event_type IS NOT NULL AND user_id IS NOT NULL""",
    # lines of a session's log, some of them broken; the tokens of its phases and the tasks of its plan
    "session_log": """
        SELECT CAST(user_id AS BIGINT) AS session_id, CAST(event_id AS BIGINT) AS seq,
               CASE WHEN event_id % 11 = 0 THEN concat(chr(123), '"event": "frustration"') WHEN event_type = 'error' THEN concat(chr(123), '"event": "frustration"', chr(125)) WHEN event_type = 'signup' THEN concat(chr(123), '"event": "lesson_saved"', chr(125))
                    WHEN event_type = 'view' THEN concat(chr(123), '"event": "lesson_surfaced", "triggers": ["t', event_id % 5, '", 7, "all"]', chr(125)) WHEN event_type = 'click' THEN concat(chr(123), '"event": "code_search"', chr(125)) ELSE '"other"' END AS line FROM {events}""",
    "phase_stats": "SELECT CAST(user_id AS BIGINT) AS session_id, CASE event_type WHEN 'error' THEN 'fix' WHEN 'click' THEN 'implement' WHEN 'view' THEN 'review' END AS phase, CAST(floor(value * 10) AS BIGINT) - 20 AS tokens FROM {events}",
    "session_tasks": "SELECT CAST(o_custkey AS BIGINT) AS session_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'done' ELSE 'passed' END END AS status, o_orderkey % 5 = 0 AS ui FROM {orders}",
    # spans of symbols in files, and changed line ranges
    "spans": "SELECT concat(source, '/d', doc_id) AS path, concat('doc::d', doc_id, '::', k) AS fqn, CAST(1 + k * 10 AS INT) AS start_line, CAST(10 + k * 10 AS INT) AS end_line FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks",
    "hunks": "SELECT concat(source, '/d', doc_id) AS path, CAST(1 + doc_id % 40 AS INT) AS a, CAST(4 + doc_id % 40 AS INT) AS b FROM {documents}",
    "vec_chunks": "SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'c0' ELSE 'c1' END AS collection, label, embedding FROM {embeddings}",
    "file_events": "SELECT event_id AS seq, ts, concat('src/f', user_id, '.rs') AS path, CASE WHEN event_type IN ('error', 'signup') THEN 'deleted' ELSE 'changed' END AS kind FROM {events}",
}
# the same edges, some of them more than once: for what walks, counts or numbers them anyway, so that nothing is shuffled to find repeats
DERIVED |= {f"{name}_rows": DERIVED[f"{name}s"].replace("UNION SELECT", "UNION ALL SELECT") for name in ("edge", "loose_edge")}
DERIVED["bus_edge_rows"] = DERIVED["bus_edges"].replace("edges}", "edge_rows}")  # pairs of events stay distinct, for they repeat often


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text)))


def _bases(name: str) -> set[str]:
    return {name} if name not in DERIVED else {b for n in _needs(DERIVED[name]) for b in _bases(n)}


_ADJACENCIES: dict[tuple, tuple[str, int]] = {}


class Tables:
    """Base and derived tables of one directory, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in DERIVED:
                text = DERIVED[name]
                self.made[name] = self.spark.sql(text, **{n: self[n] for n in _needs(text)})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.made[name]

    __getattr__ = __getitem__

    def scanned(self, *names: str) -> Scanned:
        """These tables' edges for one walk of few layers."""
        return Scanned(reduce(DataFrame.unionByName, [self[n] for n in names]))

    def adjacency(self, *names: str) -> Adjacency:
        """The edges of these tables, each written once for a session's walks, and anew where its base tables or the folder have changed."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = lambda p: path(p).getFileSystem(conf)

        def one(name: str) -> Adjacency:
            files = [f"{self.dir}/{b}.parquet" for b in sorted(_bases(name))]
            state = tuple((fs(f).getFileStatus(path(f)).getModificationTime(), fs(f).getContentSummary(path(f)).getLength()) for f in files)
            key = (self.spark.sparkContext.applicationId, self.dir, name, state)
            if key not in _ADJACENCIES or not fs(_ADJACENCIES[key][0]).exists(path(f"{_ADJACENCIES[key][0]}/_SUCCESS")):
                (folder, _, buckets), = Adjacency.build(self[name]).parts
                _ADJACENCIES[key] = folder, buckets
            return Adjacency.read(self.spark, *_ADJACENCIES[key])

        return reduce(Adjacency.__add__, map(one, names))


def oracle(text: str) -> str:
    """DuckDB SQL of a query that names derived tables as `{name}`: their definitions come before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in order:
            for n in _needs(DERIVED[name]):
                visit(n)
            order.append(name)

    for n in _needs(text):
        visit(n)
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", r"\1", t)
    body = plain(text).strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    parts = [f"{n} AS ({plain(DERIVED[n])})" for n in order]
    if not parts:
        return body
    head = "WITH RECURSIVE " + ",\n".join(parts)
    return f"{head},\n{body[own.end() :]}" if own else f"{head}\n{body}"
