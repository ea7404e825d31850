"""Queries over joins, windows, sets, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import graph as G
from skein.operators import relational as R
from skein.operators.context import symbol_context
from skein.plans.registry import query

c = F.col


@query("j01_out_neighbours", "SELECT e.src, n.id, n.kind, n.path FROM {edges} e JOIN {nodes} n ON n.id = e.dst WHERE e.kind = 'calls'")
def _(t):
    return t.edges.filter("kind = 'calls'").select("src", c("dst").alias("id")).join(t.nodes, "id").select("src", "id", "kind", "path")


@query(
    "j02_in_neighbours",
    """WITH e AS (SELECT * FROM {edges} UNION ALL SELECT * FROM {loose_edges}), o AS (SELECT split_part(id, '::', -1) AS suffix, min(id) AS owner FROM {nodes} GROUP BY suffix HAVING count(DISTINCT id) = 1),
    p AS (SELECT src, dst FROM e WHERE kind IN ('calls', 'imports') UNION SELECT e.src, o.owner FROM e JOIN o ON o.suffix = e.dst WHERE kind IN ('calls', 'imports') AND e.src <> o.owner)
    SELECT p.dst, n.id, n.path FROM p JOIN {nodes} n ON n.id = p.src""",
)
def _(t):
    return G.in_neighbours(t.edge_rows.unionByName(t.loose_edge_rows), t.nodes, ["calls", "imports"])


@query("j03_unresolved", "SELECT e.src, e.dst FROM {edges} e WHERE e.kind = 'calls' AND NOT EXISTS (SELECT 1 FROM {nodes} n WHERE n.id = e.dst)")
def _(t):
    return G.unresolved(t.edge_rows.filter("kind = 'calls'"), t.nodes)


@query("j05_interval_join", "SELECT s.fqn, h.a, h.b FROM {spans} s JOIN {hunks} h ON h.path = s.path AND s.start_line <= h.b AND s.end_line >= h.a")
def _(t):
    return R.overlapping(t.spans, t.hunks).select("fqn", "a", "b")


@query(
    "j06_neighbour_expansion",
    "SELECT conv_id, turn, concat_ws('|', lag(role) OVER w, role, lead(role) OVER w) AS expanded FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def _(t):
    return R.with_neighbours(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", "|")


@query("j07_covered_files", "SELECT DISTINCT path FROM {nodes} n WHERE EXISTS (SELECT 1 FROM {enforcement} e WHERE e.event = 'impact' AND regexp_extract(e.file, '([0-9]+)[.]', 1) = regexp_extract(n.path, '([0-9]+)[.]', 1))")
def _(t):
    number = lambda p: F.regexp_extract(p, "([0-9]+)[.]", 1)
    seen = t.enforcement.filter("event = 'impact'").select(number("file").alias("number"))
    return t.nodes.select("path", number("path").alias("number")).join(seen, "number", "left_semi").select("path").distinct()


@query("j08_uncovered_files", "SELECT DISTINCT e.file FROM {enforcement} e WHERE e.event = 'enforcement_block' AND NOT EXISTS (SELECT 1 FROM {enforcement} i WHERE i.event = 'detect_changes' AND i.file = e.file AND i.session_id = 3)")
def _(t):
    staged = t.enforcement.filter("event = 'enforcement_block'").select("file").distinct()
    return staged.join(t.enforcement.filter("event = 'detect_changes' AND session_id = 3").select("file"), "file", "left_anti")


@query(
    "j10_alias_resolution",
    """WITH leafs AS (SELECT split_part(id, '::', -1) AS leaf, min(id) AS fqn FROM {nodes} GROUP BY 1), calls AS (SELECT l_orderkey, l_linenumber, concat(CASE WHEN l_partkey % 3 = 0 THEN 's' ELSE 'p' END, l_partkey) AS callee FROM {lineitem}),
    alias AS (SELECT concat('p', p_partkey) AS name, concat('alias::p', p_partkey) AS target FROM {part} WHERE p_partkey % 10 = 0)
    SELECT l_orderkey, l_linenumber, coalesce(a.target, f.fqn, callee) AS resolved FROM calls LEFT JOIN alias a ON a.name = callee LEFT JOIN leafs f ON f.leaf = callee""",
)
def _(t):
    leafs = t.nodes.groupBy(X.last_segment(c("id")).alias("callee")).agg(F.min("id").alias("fqn"))
    alias = t.part.filter("p_partkey % 10 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("callee"), F.concat(F.lit("alias::p"), "p_partkey").alias("target"))
    calls = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.when(c("l_partkey") % 3 == 0, "s").otherwise("p"), "l_partkey").alias("callee"))
    return calls.join(alias, "callee", "left").join(leafs, "callee", "left").select("l_orderkey", "l_linenumber", F.coalesce("target", "fqn", "callee").alias("resolved"))


@query(
    "j12_overlay",
    """WITH g AS (SELECT n_nationkey AS id, n_name AS message, n_nationkey AS ord FROM {nation} WHERE n_nationkey < 15), p AS (SELECT n_nationkey AS id, concat('project ', n_name) AS message, 24 - n_nationkey AS ord FROM {nation} WHERE n_nationkey % 2 = 0)
    SELECT coalesce(p.id, g.id) AS id, coalesce(p.message, g.message) AS message, CAST(CASE WHEN g.ord IS NULL THEN p.ord + 1099511627776 ELSE g.ord END AS BIGINT) AS ord FROM g FULL JOIN p ON p.id = g.id""",
)
def _(t):
    g = t.nation.filter("n_nationkey < 15").select(c("n_nationkey").alias("id"), c("n_name").alias("message"), c("n_nationkey").cast("long").alias("ord"))
    p = t.nation.filter("n_nationkey % 2 = 0").select(c("n_nationkey").alias("id"), F.concat(F.lit("project "), "n_name").alias("message"), (24 - c("n_nationkey")).cast("long").alias("ord"))
    return R.overlay(g, p, "id", "ord")


@query("j13_trust_lookup", "SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'trusted' WHEN c_mktsegment = 'MACHINERY' THEN 'auto' ELSE 'untrusted' END AS state FROM {customer} LEFT JOIN {supplier} ON s_suppkey = c_custkey")
def _(t):
    trust = t.supplier.select(c("s_suppkey").alias("c_custkey"), F.lit(True).alias("known"))
    state = F.when(c("known"), "trusted").when(c("c_mktsegment") == "MACHINERY", "auto").otherwise("untrusted")
    return t.customer.join(trust, "c_custkey", "left").select("c_custkey", state.alias("state"))


@query("j14_dangling_dependencies", "SELECT id, dep FROM {task_deps} d WHERE NOT EXISTS (SELECT 1 FROM {tasks} t WHERE t.id = d.dep)")
def _(t):
    return t.task_deps.join(t.tasks.select(c("id").alias("dep")), "dep", "left_anti").select("id", "dep")


@query(
    "j16_registry_reconcile",
    "SELECT c_custkey AS id, 'add' AS action FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders}) UNION ALL SELECT DISTINCT o_custkey, 'remove' FROM {orders} WHERE o_custkey % 9 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)",
)
def _(t):
    known = t.orders.select(c("o_custkey").alias("id")).distinct()
    add = t.customer.select(c("c_custkey").alias("id")).join(known, "id", "left_anti").withColumn("action", F.lit("add"))
    gone = known.filter("id % 9 = 0").join(t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("id")), "id", "left_anti").withColumn("action", F.lit("remove"))
    return add.unionByName(gone)


@query("j17_file_imports", "SELECT DISTINCT n.path, e.dst FROM {edges} e JOIN {nodes} n ON n.id = e.src WHERE e.kind = 'imports'")
def _(t):
    return t.edges.filter("kind = 'imports'").select(c("src").alias("id"), "dst").join(t.nodes, "id").select("path", "dst").distinct()


@query(
    "j18_symbol_context",
    """WITH own AS (SELECT split_part(id, '::', -1) AS suffix, min(id) AS owner FROM {bus_nodes} GROUP BY suffix HAVING count(DISTINCT id) = 1),
    pairs AS (SELECT src AS id, kind, 'out' AS way, dst AS other, 0 AS walk FROM {bus_edges} UNION ALL SELECT dst, kind, 'in', src, 0 FROM {bus_edges} UNION ALL SELECT owner, kind, 'in', src, 2 FROM {bus_edges} JOIN own ON suffix = dst AND owner <> src AND owner <> dst),
    names(kind, way, section) AS (VALUES ('calls', 'in', 'callers'), ('calls', 'out', 'callees'), ('extends', 'out', 'extends'), ('extends', 'in', 'extended_by'), ('references', 'in', 'references'), ('emits', 'out', 'emits'),
      ('emits', 'in', 'emitted_by'), ('subscribes', 'out', 'subscribers'), ('subscribes', 'in', 'subscribes_to'), ('imports', 'out', 'imports_unresolved')),
    met AS (SELECT p.id, section, other, min(walk) AS walk FROM pairs p JOIN names n ON n.kind = p.kind AND n.way = p.way WHERE p.id IN (SELECT id FROM {bus_nodes}) GROUP BY p.id, section, other),
    known AS (SELECT *, other IN (SELECT id FROM {bus_nodes}) AS known FROM met),
    inside AS (SELECT id, section, other, walk FROM known WHERE known AND section <> 'imports_unresolved' UNION ALL SELECT a.id, 'siblings', b.id, 0 FROM {bus_nodes} a JOIN (SELECT id, path FROM {bus_nodes} QUALIFY row_number() OVER (PARTITION BY path ORDER BY id) <= 5) b ON b.path = a.path AND b.id <> a.id)
    SELECT id, section, other FROM inside QUALIFY row_number() OVER (PARTITION BY id, section ORDER BY walk, other) <= 4
    UNION ALL SELECT id, section, other FROM known WHERE NOT known AND section = 'imports_unresolved'""",
)
def _(t):
    return symbol_context(t.bus_edge_rows, t.bus_nodes, 4)


@query(
    "j19_event_trace",
    """WITH r AS (SELECT DISTINCT event_type AS topic, CASE WHEN event_id % 2 = 0 THEN 'emits' ELSE 'subscribes' END AS role, user_id FROM {events}),
    n AS (SELECT topic, count(*) FILTER (role = 'emits') AS emitters, count(*) FILTER (role = 'subscribes') AS subscribers FROM r GROUP BY topic)
    SELECT topic, role, user_id, CASE role WHEN 'emits' THEN subscribers ELSE emitters END AS others FROM r JOIN n USING (topic)""",
)
def _(t):
    role = F.when(c("event_id") % 2 == 0, "emits").otherwise("subscribes")
    return R.event_trace(t.events.select(c("event_type").alias("topic"), role.alias("role"), "user_id"), "topic", "role", "user_id")


@query("j22_fuzzy_paths", "WITH u AS (SELECT path, split_part(path, '/', -1) AS leaf FROM (SELECT DISTINCT path FROM {nodes})) SELECT leaf, min(path) AS fixed FROM u GROUP BY leaf HAVING count(*) = 1")
def _(t):
    return t.nodes.select("path").distinct().groupBy(F.substring_index("path", "/", -1).alias("leaf")).agg(F.min("path").alias("fixed"), F.count("*").alias("n")).filter("n = 1").drop("n")


# windows


@query(
    "w01_role_runs",
    """WITH m AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR role = 'user' THEN 1 ELSE 0 END AS new FROM {turns} WINDOW w AS (PARTITION BY session_id ORDER BY turn_number)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY turn_number ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT session_id, CAST(island AS BIGINT) AS island, role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM i GROUP BY ALL""",
)
def _(t):
    w = Window.partitionBy("session_id").orderBy("turn_number")
    new = ~c("role").eqNullSafe(F.lag("role").over(w)) | (c("role") == "user")
    runs = R.islands(t.turns.withColumn("new", new), ["session_id"], "turn_number", c("new"))
    return runs.groupBy("session_id", "island", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    "w02_exchange_pairs",
    """WITH e AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS exchange FROM {turns})
    SELECT session_id, exchange, min(turn_number) AS first_turn, count(*) AS n_turns, string_agg(role, '+' ORDER BY turn_number) AS roles FROM e GROUP BY session_id, exchange""",
)
def _(t):
    e = R.islands(t.turns, ["session_id"], "turn_number", c("role") == "user").withColumnRenamed("island", "exchange")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "role"))), lambda x: x["role"]), "+")
    return e.groupBy("session_id", "exchange").agg(F.min("turn_number").alias("first_turn"), F.count("*").alias("n_turns"), roles.alias("roles"))


@query(
    "w03_run_length",
    """WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m) SELECT user_id, run, event_type, count(*) AS n FROM i GROUP BY ALL""",
)
def _(t):
    return R.collapsed_runs(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("w04_row_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM {events}")
def _(t):
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("number"))


@query("w05_consecutive_edges", "SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM {events}) WHERE dst IS NOT NULL")
def _(t):
    return t.events.select(c("event_id").alias("src"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("dst")).filter("dst IS NOT NULL")


@query(
    "w06_last_definition",
    "SELECT event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_line FROM {events}",
)
def _(t):
    uses = t.events.select("user_id", "event_id", (c("event_type") == "signup").alias("is_def"))
    return R.last_definition(uses, ["user_id"], "event_id", "is_def").select("event_id", "def_line")


@query("w07_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM {events}")
def _(t):
    # numbers rise, so the last heading is the highest so far
    return R.running(t.events.select("user_id", "event_id", "event_type"), ["user_id"], [c("event_id")], heading=("max", F.when(c("event_type") == "view", c("event_id")))).select("event_id", "heading")


@query("w08_latest_match", "SELECT user_id, max(event_id) AS event_id FROM {events} WHERE event_type = 'purchase' GROUP BY user_id")
def _(t):
    return t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query(
    "w10_byte_budget",
    "SELECT conv_id, turn FROM (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM {conversations}) WHERE spent < 1500",
)
def _(t):
    return R.within_budget(t.conversations, ["conv_id"], "turn", F.octet_length("text"), 1500).select("conv_id", "turn")


@query(
    "w11_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {events})
    SELECT event_type, max(value) FILTER (i = floor((n - 1) * 50 / 100 + 0.5)) AS p50, max(value) FILTER (i = floor((n - 1) * 95 / 100 + 0.5)) AS p95 FROM r GROUP BY event_type""",
)
def _(t):
    return R.nearest_rank(t.events.select("event_type", "value"), ["event_type"], "value", [50, 95])


# sets


@query("u04_difference", "SELECT DISTINCT dst AS id FROM {edges} WHERE kind = 'calls' EXCEPT SELECT DISTINCT src FROM {edges} WHERE kind = 'imports'")
def _(t):
    return t.edges.filter("kind = 'calls'").select(c("dst").alias("id")).distinct().join(t.edges.filter("kind = 'imports'").select(c("src").alias("id")), "id", "left_anti")


@query("u02_tool_union", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tools FROM {events} GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tools"))


@query("u06_changed_and_deleted", "SELECT path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM {file_events} GROUP BY path")
def _(t):
    return t.file_events.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


# writers and deletes, as the tables they leave


@query(
    "k01_node_upsert",
    """WITH ch AS (SELECT concat('part::p', l_partkey) AS id, 'function' AS kind, concat('moved/', l_suppkey, '.ts') AS path, CAST(l_linenumber AS INT) AS line, l_orderkey * 10 + l_linenumber AS seq FROM {lineitem}),
    n AS (SELECT id, kind, path, line FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, path DESC) = 1)
    SELECT id, kind, path, line FROM {nodes} WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, kind, path, line FROM n""",
)
def _(t):
    changes = t.lineitem.select(
        F.concat(F.lit("part::p"), "l_partkey").alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("moved/"), "l_suppkey", F.lit(".ts")).alias("path"), c("l_linenumber").cast("int").alias("line"), F.struct(c("l_orderkey") * 10 + c("l_linenumber"), F.concat(F.lit("moved/"), "l_suppkey", F.lit(".ts"))).alias("seq")
    )
    return R.upsert(t.nodes, changes, ["id"], "seq")


@query("k02_statement_upsert", "SELECT id, kind, path, line, CAST(NULL AS VARCHAR) AS text FROM {nodes} WHERE id NOT LIKE 'order::%' UNION ALL SELECT concat('order::o', o_orderkey), 'stmt', 'shop/stmt.ts', CAST(o_orderkey AS INTEGER), concat('let total = ', o_custkey) FROM {orders}")
def _(t):
    statements = t.orders.select(F.concat(F.lit("order::o"), "o_orderkey").alias("id"), F.lit("shop/stmt.ts").alias("path"), c("o_orderkey").cast("int").alias("line"), F.concat(F.lit("let total = "), "o_custkey").alias("text"))
    return G.upsert_statements(t.nodes, statements)


@query("k03_edge_upsert", "SELECT src, dst, kind FROM {edges} UNION SELECT concat('order::o', o_orderkey), concat('customer::c', o_custkey), 'subscribes' FROM {orders}")
def _(t):
    new = t.orders.select(F.concat(F.lit("order::o"), "o_orderkey").alias("src"), F.concat(F.lit("customer::c"), "o_custkey").alias("dst"), F.lit("subscribes").alias("kind"))
    return t.edges.unionByName(new).dropDuplicates(["src", "kind", "dst"])


@query("k09_vector_delete", "SELECT id, collection FROM {vec_chunks} WHERE NOT (collection = 'c1' AND label IN (1, 3))")
def _(t):
    from skein.operators.retrieval import metadata_filter

    gone = metadata_filter({"$and": [{"collection": "c1"}, {"label": {"$in": [1, 3]}}]}, lambda k: c(k))
    return t.vec_chunks.filter(~gone).select("id", "collection")


@query("k11_turn_append", "SELECT session_id, turn_number FROM {turns} UNION ALL SELECT session_id, max(turn_number) + 1 FROM {turns} GROUP BY session_id")
def _(t):
    new = t.turns.select("session_id").distinct().withColumn("at", F.lit(1))
    return t.turns.select("session_id", "turn_number").unionByName(R.sequence_numbers(new, t.turns, "session_id", "at", "turn_number").select("session_id", "turn_number"))


@query("k12_access_bump", "SELECT e.id, access_count + coalesce(n, 0) AS access_count FROM {episodes} e LEFT JOIN (SELECT CAST(floor(l_orderkey / 2) AS BIGINT) AS id, count(*) AS n FROM {lineitem} GROUP BY 1) a ON a.id = e.id")
def _(t):
    seen = t.lineitem.groupBy(F.floor(c("l_orderkey") / 2).alias("id")).agg(F.count("*").alias("n"))
    return t.episodes.join(seen, "id", "left").select("id", (c("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"))


@query("k13_ttl_delete", "SELECT id FROM {episodes} WHERE NOT at_s < 300000")
def _(t):
    return t.episodes.filter(~(c("at_s") < 300_000)).select("id")


@query("k15_capacity_trim", "SELECT id FROM {episodes} ORDER BY id DESC LIMIT 500")
def _(t):
    return R.newest(t.episodes, "id", 500).select("id")


@query(
    "k16_session_upsert",
    """WITH a AS (SELECT c_custkey AS id, c_mktsegment AS topic, 100 AS ingested FROM {customer} WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS id, min(o_orderpriority) AS topic, 200 AS ingested FROM {orders} GROUP BY o_custkey)
    SELECT coalesce(n.id, a.id) AS id, coalesce(n.topic, a.topic) AS topic, coalesce(a.ingested, n.ingested) AS ingested FROM a FULL JOIN n ON a.id = n.id""",
)
def _(t):
    old = t.customer.filter("c_custkey % 2 = 0").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("topic"), F.lit(100).alias("ingested"))
    new = t.orders.groupBy(c("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("topic"), F.lit(200).alias("ingested"))
    return R.upsert_keeping(old, new, ["id"], ["ingested"])


@query("k18_path_purge", "WITH gone AS (SELECT id FROM {nodes} WHERE path = 'shop/part3.ts') SELECT src, dst, kind FROM {edges} WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def _(t):
    return R.purge_path(t.nodes, t.edges, "shop/part3.ts")[1]


@query("k28_dot_export", "SELECT string_agg(concat('  \"', src, '\" -> \"', dst, '\" [label=\"', kind, '\"];'), chr(10) ORDER BY src, dst, kind) AS dot FROM {edges} WHERE kind = 'extends'")
def _(t):
    rows = t.edges.filter("kind = 'extends'")
    line = lambda x: F.format_string('  "%s" -> "%s" [label="%s"];', x["src"], x["dst"], x["kind"])
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "kind"))), line), "\n").alias("dot"))


@query("t10_sandwich", "SELECT doc_id, CASE WHEN len(l) > 6 THEN array_to_string(list_concat(l[1:2], ['…'], l[-2:]), '~') ELSE array_to_string(l, '~') END AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents})")
def _(t):
    from skein.operators.lines import sandwich

    return t.documents.select("doc_id", F.array_join(sandwich(F.split("text", "\n"), 2, 2, 6, "…"), "~").alias("body"))


@query(
    "t07_handler_choice",
    "SELECT c_mktsegment AS cmd, c_custkey AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, floor(c_acctbal / 1000) DESC, c_custkey) AS rn FROM {customer}) WHERE rn = 1",
)
def _(t):
    return R.capped_per_key(t.customer, ["c_mktsegment"], [c("c_nationkey").desc(), F.floor(c("c_acctbal") / 1000).desc(), c("c_custkey")], 1).select(c("c_mktsegment").alias("cmd"), c("c_custkey").alias("chosen"))
