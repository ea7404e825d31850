"""Queries over memory files, JSON documents and statement graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import memory as M
from skein.plans.registry import query

c = F.col


@query("k19_rendered_facts", "SELECT p_partkey, concat('### ', p_name, chr(10), p_type, chr(10), 'tags: ', p_brand, ', part', chr(10), CASE WHEN p_size > 25 THEN concat('scope: on-demand', chr(10)) ELSE '' END) AS body FROM {part}")
def _(t):
    text = M.rendered_fact(c("p_name"), c("p_type"), F.array("p_brand", F.lit("part")), F.when(c("p_size") > 25, "on-demand").otherwise("always"))
    return t.part.select("p_partkey", text.alias("body"))


@query("k20_promotion", "SELECT p_partkey, p_partkey = (SELECT p_partkey FROM {part} ORDER BY p_partkey LIMIT 1 OFFSET 7) AS moved FROM {part}")
def _(t):
    moved, rest = M.promoted(t.part.select("p_partkey"), "p_partkey", 7)
    return moved.withColumn("moved", F.lit(True)).unionByName(rest.withColumn("moved", F.lit(False)))


@query("k21_quarantine_move", "SELECT trigger_text, lower(trigger_text) IN ('src1 / en', 'src2 / de') AS gone FROM {lessons}")
def _(t):
    gone, kept = M.split_by_triggers(t.lessons.select("trigger_text"), [" SRC1 / EN", "src2 / de"])
    return gone.withColumn("gone", F.lit(True)).unionByName(kept.withColumn("gone", F.lit(False)))


@query("k22_counter_bump", "SELECT trigger_text, CAST(success + CASE WHEN trigger_text IN ('src1 / en', 'src3 / fr') THEN 1 ELSE 0 END AS BIGINT) AS success FROM {lessons}")
def _(t):
    return M.bumped(t.lessons, ["src1 / EN", "src3 / fr"], "success").select("trigger_text", "success")


@query("k24_capped_append")
def _(t):
    return M.accepted_within(t.conversations, "conv_id", "turn", F.octet_length("text"), 2000)


@query("k26_replace_by_query", "SELECT n_nationkey, CASE WHEN n_name = 'NATION_17' THEN 'changed' ELSE n_name END AS n_name FROM {nation}")
def _(t):
    return M.replaced(t.nation.select("n_nationkey", "n_name"), "n_nationkey", "n_name", "nation_17", "changed")


@query("k27_previews", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, CASE WHEN length(f) <= 120 THEN f ELSE concat(substring(f, 1, 120), '…') END AS first_line, CAST(strlen(text) AS INTEGER) AS bytes FROM (SELECT *, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS f FROM {conversations})")
def _(t):
    return M.previews(t.conversations, "conv_id", "turn", "text")


@query("t08_best_match", "SELECT n_nationkey FROM {nation} WHERE n_name = 'NATION_21'")
def _(t):
    return M.best_match(t.nation, "n_nationkey", "n_name", "NATION_21").select("n_nationkey")


@query("r14_sanitised_queries")
def _(t):
    return t.conversations.select("conv_id", "turn", M.sanitised_query(c("text")).alias("asked"))


@query("c25_compact_json", "SELECT event_id, concat('{\"k\":', json_extract(props, '$.k'), '}') AS props FROM {events}")
def _(t):
    return t.events.select("event_id", M.compacted_json("props").alias("props"))


@query("c24_json_patch", "SELECT event_id, concat('{\"k\":', event_id, ',\"tags\":[\"a\",', json_extract(props, '$.k'), ']}') AS patched FROM {events}")
def _(t):
    old = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    patch = F.concat(F.lit('[{"op":"test","path":"/k","value":'), old, F.lit('},{"op":"add","path":"/tags","value":["a"]},{"op":"copy","from":"/k","path":"/tags/-"},{"op":"replace","path":"/k","value":'), c("event_id").cast("string"), F.lit("}]"))
    return t.events.select("event_id", M.patched_json("props", patch).alias("patched"))


_STATEMENTS = "SELECT concat('o', l_orderkey) AS fn, CAST(min(l_linenumber) AS INT) AS line, concat('let p', min(l_partkey) % 4, ' = f(p', min(l_suppkey) % 4, ')') AS text FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query(
    "g11_statement_graph",
    f"""WITH s AS ({_STATEMENTS}), d AS (SELECT fn, line, regexp_extract(text, 'let (p[0-9])', 1) AS def, regexp_extract(text, 'f\\((p[0-9])', 1) AS use FROM s),
    n AS (SELECT fn, line, lead(line) OVER (PARTITION BY fn ORDER BY line) AS nxt FROM s), u AS (SELECT d.fn, d.line, max(e.line) AS prev FROM d JOIN d e ON e.fn = d.fn AND e.def = d.use AND e.line < d.line GROUP BY d.fn, d.line)
    SELECT concat(fn, '#s', line) AS src, concat(fn, '#s', nxt) AS dst, 'cfg' AS kind FROM n WHERE nxt IS NOT NULL UNION ALL SELECT concat(fn, '#s', prev), concat(fn, '#s', line), 'data_dep' FROM u""",
)
def _(t):
    return M.statement_edges(t.spark.sql(_STATEMENTS, lineitem=t.lineitem))
