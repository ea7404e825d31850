"""Queries over the remaining scans, writers, aggregates and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.operators import graph as G
from skein.operators import lifecycle as L
from skein.operators import relational as R
from skein.plans.registry import query

c = F.col
_UP, _LO = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


# scans


@query("s15_point_lookup", "SELECT id, kind, path FROM {nodes} WHERE id = 'part::p7'")
def _(t):
    return t.nodes.filter(c("id") == "part::p7").select("id", "kind", "path")


@query("s17_edges_from", "SELECT src, dst, kind FROM {edges} WHERE src = 'supplier::s3'")
def _(t):
    return t.edges.filter(c("src") == "supplier::s3")


@query("s18_edges_to", "SELECT src, dst, kind FROM {edges} WHERE dst = 'nation::NATION_4'")
def _(t):
    return t.edges.filter(c("dst") == "nation::NATION_4")


@query("s19_all_nodes", "SELECT id FROM {nodes}")
def _(t):
    return t.nodes.select("id")


@query("s21_rows_by_path", "SELECT id, line FROM {nodes} WHERE path = 'crm/customer2.py'")
def _(t):
    return t.nodes.filter("path = 'crm/customer2.py'").select("id", "line")


@query("s26_session_lookups", "SELECT session_id, count(*) AS n FROM {turns} GROUP BY session_id HAVING count(*) < 5 ORDER BY session_id LIMIT 20")
def _(t):
    return t.turns.groupBy("session_id").agg(F.count("*").alias("n")).filter("n < 5").orderBy("session_id").limit(20)


@query("s34_table_rows", "SELECT p_partkey, p_name AS cell FROM {part}")
def _(t):
    text = F.concat(F.lit("# Spec\n\n## Tasks\n\n| Name | Size |\n|---|---|\n| "), "p_name", F.lit(" | 3 |\n\n## Other\n\n| x | y |\n"))
    section = F.regexp_extract(text, r"(?s)\n## Tasks\n(.*?)(?:\n## |$)", 1)
    rows = F.filter(F.split(section, "\n"), lambda x: x.startswith("|"))
    cells = F.transform(F.slice(rows, 3, 1 << 20), lambda x: F.trim(F.get(F.split(x, r"\|"), 1)))
    return t.part.select("p_partkey", F.explode(cells).alias("cell"))


# writers and deletes


@query("k05_meta_put", "SELECT CAST(n_nationkey AS STRING) AS key, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS value FROM {nation} WHERE n_nationkey <> 9")
def _(t):
    old = t.nation.select(c("n_nationkey").cast("string").alias("key"), c("n_name").alias("value"))
    put = t.nation.filter("n_nationkey < 5").select(c("n_nationkey").cast("string").alias("key"), F.lit("new").alias("value"), c("n_nationkey").alias("seq"))
    return R.upsert(old, put, ["key"], "seq").filter("key <> '9'")


@query("k08_vector_upsert", "SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS INTEGER) AS label FROM {embeddings}")
def _(t):
    old = t.embeddings.select("vec_id", "label")
    new = old.filter("vec_id % 5 = 0").withColumns({"label": (c("label") + 100).cast("int"), "seq": c("vec_id")})
    return R.upsert(old, new, ["vec_id"], "seq")


@query("k14_id_list_delete", "SELECT id FROM {episodes} WHERE id NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderkey % 4 = 0)")
def _(t):
    return t.episodes.join(t.orders.filter("o_orderkey % 4 = 0").select(c("o_orderkey").alias("id")), "id", "left_anti").select("id")


@query("k17_archive_purge", "WITH old AS (SELECT session_id FROM {turns} GROUP BY session_id HAVING max(turn_number) < 4) SELECT session_id, turn_number FROM {turns} WHERE session_id NOT IN (SELECT session_id FROM old)")
def _(t):
    old = t.turns.groupBy("session_id").agg(F.max("turn_number").alias("last")).filter("last < 4").select("session_id")
    return t.turns.join(old, "session_id", "left_anti").select("session_id", "turn_number")


# filters, joins


@query("f03_kind_filter", "SELECT src, dst, kind FROM {edges} WHERE kind IN ('extends', 'references')")
def _(t):
    return G.directed(t.edges, "out", ["extends", "references"]).select(c("a").alias("src"), c("b").alias("dst"), "kind")


@query("f04_directions", "SELECT src AS a, dst AS b FROM {edges} WHERE kind = 'extends' UNION ALL SELECT dst, src FROM {edges} WHERE kind = 'extends'")
def _(t):
    return G.directed(t.edges, "both", ["extends"]).select("a", "b")


@query("f06_pattern_predicate", "SELECT id FROM {nodes} WHERE contains(lower(id), 'order::o12') OR contains(lower(path), 'supplier1')")
def _(t):
    return t.nodes.filter(F.lower("id").contains("order::o12") | F.lower("path").contains("supplier1")).select("id")


@query("f11_tag_filter", "SELECT user_id FROM {events} GROUP BY user_id HAVING bool_or(lower(event_type) IN ('error', 'view') AND value > 95)")
def _(t):
    tags = t.events.filter("value > 95").groupBy("user_id").agg(F.collect_set(F.lower("event_type")).alias("tags"))
    return tags.filter(F.arrays_overlap("tags", F.array(F.lit("error"), F.lit("view")))).select("user_id")


@query("f13_wakeup_scope", "SELECT p_partkey, number FROM (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number FROM {part}) WHERE p_size <= 25")
def _(t):
    # numbers are given before the filter, so that they stay what other tools show
    numbered = t.part.withColumn("number", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long"))
    return numbered.filter("p_size <= 25").select("p_partkey", "number")


@query("j20_chunk_enrichment", "WITH r AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM {edges} WHERE kind = 'calls') SELECT n.id, coalesce(string_agg(src, ',' ORDER BY src), '') AS callers FROM {nodes} n LEFT JOIN r ON r.dst = n.id AND rn <= 8 WHERE starts_with(n.id, 'part::') GROUP BY n.id")
def _(t):
    few = R.capped_per_key(t.edges.filter("kind = 'calls'"), ["dst"], [c("src")], 8).groupBy(c("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("callers"))
    return t.nodes.filter(c("id").startswith("part::")).select("id").join(few, "id", "left").select("id", F.coalesce("callers", F.lit("")).alias("callers"))


@query("j21_keyword_join", f"SELECT DISTINCT d.doc_id, k.word FROM {{documents}} d JOIN (SELECT unnest(['worthless', 'pathetic', 'password', 'that']) AS word) k ON contains(translate(d.text, {_UP}, {_LO}), k.word)")
def _(t):
    words = ("worthless", "pathetic", "password", "that")
    low = X.ascii_lower(c("text"))
    hits = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))
    return t.documents.select("doc_id", F.explode(hits).alias("word"))


# aggregates


@query("a03_counts", "SELECT 'nodes' AS name, count(*) AS n FROM {nodes} UNION ALL SELECT 'edges', count(*) FROM {edges}")
def _(t):
    n = lambda name: t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n("nodes").unionByName(n("edges"))


@query("a11_token_tally", "SELECT model, CAST(sum(CASE WHEN model = 'claude-opus-4-1' THEN greatest(input_tokens - cache_read_tokens, 0) ELSE input_tokens END) AS BIGINT) AS tokens FROM {turn_usage} GROUP BY model")
def _(t):
    own = F.when(c("model") == "claude-opus-4-1", F.greatest(c("input_tokens") - c("cache_read_tokens"), F.lit(0))).otherwise(c("input_tokens"))
    return t.turn_usage.groupBy("model").agg(F.sum(own).alias("tokens"))


@query("a21_forget_counts", "SELECT count(*) FILTER (at_s < 300000) AS ttl, greatest(count(*) FILTER (at_s >= 300000) - 3000, 0) AS capacity FROM {episodes}")
def _(t):
    stages = L.forget(t.episodes, 900_000, 600_000, 3000, floor=0)
    count = lambda d, name: d.agg(F.count("*").alias(name))
    sizes = count(t.episodes, "all").join(count(stages["ttl"], "fresh")).join(count(stages["capacity"], "held"))  # one row each
    return sizes.select((c("all") - c("fresh")).alias("ttl"), (c("fresh") - c("held")).alias("capacity"))


@query("w09_stage_ranks", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS BIGINT) AS rank FROM {events}")
def _(t):
    return R.ranks_per_key(t.events.select("event_type", "value", "event_id"), "event_type", [F.desc("value"), c("event_id")]).select("event_id", "rank")


@query("t01_top_k", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(t):
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey")


@query("t05_oldest_retention", "SELECT o_orderkey FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("u01_stage_union", "SELECT 'view' AS stage, count(*) AS n FROM {events} WHERE event_type = 'view' UNION ALL SELECT 'error', count(*) FROM {events} WHERE event_type = 'error'")
def _(t):
    n = lambda e: t.events.filter(c("event_type") == e).agg(F.count("*").alias("n")).select(F.lit(e).alias("stage"), "n")
    return n("view").unionByName(n("error"))


# scalars


# every class of prices by a name of its own, an unknown one and names that only look alike
_MODELS = {"claude-fable-1": (10.0, 12.5, 1.0, 50.0), "Claude_Opus_4_5": (5.0, 6.25, 0.5, 25.0), "claude-opus-4-1-x": (15.0, 18.75, 1.5, 75.0), "claude-opus-3": (15.0, 18.75, 1.5, 75.0), "claude-sonnet-4": (3.0, 3.75, 0.3, 15.0), "CLAUDE-HAIKU-4-5": (1.0, 1.25, 0.1, 5.0), "claude-haiku-3": (0.25, 0.3, 0.03, 1.25), "claude-haiku-4": (3.0, 3.75, 0.3, 15.0), "gpt": (3.0, 3.75, 0.3, 15.0)}
_MODEL_ROWS = ", ".join(f"('{m}', {', '.join(map(str, p))})" for m, p in _MODELS.items())


@query(
    "c18_prices",
    f"""WITH m(model, i, w, r, o) AS (VALUES {_MODEL_ROWS}), k AS (SELECT *, row_number() OVER (ORDER BY model) - 1 AS k FROM m)
    SELECT p_partkey, model, CAST(i AS DOUBLE) AS input, CAST(w AS DOUBLE) AS cache_write, CAST(r AS DOUBLE) AS cache_read, CAST(o AS DOUBLE) AS output FROM {{part}} JOIN k ON k = p_partkey % {len(_MODELS)}""",
)
def _(t):
    model = F.get(F.array(*[F.lit(m) for m in sorted(_MODELS)]), (c("p_partkey") % len(_MODELS)).cast("int"))
    rows = t.part.select("p_partkey", model.alias("model"))
    return rows.select("p_partkey", "model", *[F.round(S.price(c("model"), i) * 1e6, 6).alias(n) for i, n in enumerate(("input", "cache_write", "cache_read", "output"))])


@query("c23_map_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'patched' ELSE event_type END AS kind FROM {events}")
def _(t):
    base = F.create_map(F.lit("kind"), c("event_type"), F.lit("user"), c("user_id").cast("string"))
    patch = F.create_map(F.lit("kind"), F.lit("patched"))
    keep = F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k))
    merged = F.when(c("event_id") % 2 == 0, F.map_concat(keep, patch)).otherwise(base)
    return t.events.select("event_id", F.try_element_at(merged, F.lit("kind")).alias("kind"))


@query("c31_file_specs", "SELECT path, start_line AS a, end_line AS b FROM {spans}")
def _(t):
    spec = F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line")
    part = lambda i: F.regexp_extract(spec, r"^(.*?)(?::(\d+)-(\d+))?$", i)
    return t.spans.select(part(1).alias("path"), part(2).cast("int").alias("a"), part(3).cast("int").alias("b"))


@query("c34_baseline_delta", "SELECT session_id, greatest(0, max(input_tokens) - min(input_tokens)) AS delta FROM {turn_usage} GROUP BY session_id")
def _(t):
    return t.turn_usage.groupBy("session_id").agg(F.greatest(F.lit(0), F.max("input_tokens") - F.min("input_tokens")).alias("delta"))


@query("r05_graph_stage", "WITH s AS (SELECT unnest(['order::o10', 'order::o20', 'order::o30']) AS seed, unnest([0, 1, 2]) AS n), b AS (SELECT dst AS id, n FROM {edges} JOIN s ON src = seed UNION ALL SELECT src, n FROM {edges} JOIN s ON dst = seed) SELECT id, CAST(min(n) AS INTEGER) AS seed FROM b WHERE id IN (SELECT id FROM {nodes}) GROUP BY id")
def _(t):
    from skein.operators.retrieval import graph_stage

    return graph_stage(t.edges, t.nodes, ["order::o10", "order::o20", "order::o30"]).select("id", c("at").alias("seed"))


@query("g17_incident_edges", "SELECT src, dst, kind FROM {edges} WHERE src = 'part::p3' OR dst = 'part::p3'")
def _(t):
    return t.edges.filter((c("src") == "part::p3") | (c("dst") == "part::p3"))


@query("p07_detail_lookup", "SELECT 'F' AS kind, p_partkey AS id FROM {part} WHERE contains(p_name, 'widget') ORDER BY p_partkey LIMIT 1")
def _(t):
    hits = t.part.filter(c("p_name").contains("widget")).select(F.lit("F").alias("kind"), c("p_partkey").alias("id"), F.lit(0).alias("order"))
    other = t.documents.filter(c("text").contains("widget")).select(F.lit("L").alias("kind"), c("doc_id").alias("id"), F.lit(1).alias("order"))
    return hits.unionByName(other).orderBy("order", "id").limit(1).select("kind", "id")


@query("p09_context_bundles", "SELECT c_nationkey, string_agg(concat('- ', c_name), chr(10) ORDER BY c_custkey) AS bundle FROM (SELECT * FROM {customer} WHERE c_acctbal > 9000) GROUP BY c_nationkey")
def _(t):
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    return t.customer.filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.array_join(F.transform(rows, lambda x: F.concat(F.lit("- "), x["c_name"])), "\n").alias("bundle"))


@query("r12_render_budget", "SELECT conv_id, turn FROM (SELECT *, coalesce(sum(least(len(string_split(text, chr(10))), 5)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM {conversations}) WHERE spent < 8")
def _(t):
    lines = F.least(F.size(F.split("text", "\n")), F.lit(5))
    return R.within_budget(t.conversations, ["conv_id"], "turn", lines, 8).select("conv_id", "turn")


@query("r06_markdown_stage", f"SELECT p_partkey, sha256(concat(p_name, p_type)) AS id FROM {{part}} WHERE contains(translate(p_name, {_UP}, {_LO}), 'bolt') OR contains(translate(p_type, {_UP}, {_LO}), 'small')")
def _(t):
    hit = X.ascii_lower(c("p_name")).contains("bolt") | X.ascii_lower(c("p_type")).contains("small")
    return t.part.filter(hit).select("p_partkey", F.sha2(F.concat("p_name", "p_type"), 256).alias("id"))
