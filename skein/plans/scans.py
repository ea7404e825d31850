"""Queries over scans and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.plans.registry import query
from skein.sources import parsers as P

c = F.col


@query("s04_languages", "SELECT id, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' END AS language FROM {nodes}")
def _(t):
    return t.nodes.select("id", X.language_of(c("path")).alias("language"))


@query(
    "s06_text_chunks",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS body, generate_subscripts(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)), 1) AS line FROM (SELECT conv_id, turn, replace(text, '. ', chr(10) || chr(10)) AS text FROM {conversations})),
    p AS (SELECT *, sum(CASE WHEN trim(body) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY line) AS paragraph FROM l),
    r AS (SELECT *, floor((row_number() OVER (PARTITION BY conv_id, turn, paragraph ORDER BY line) - 1) / 120) AS piece FROM p WHERE trim(body) <> '')
    SELECT conv_id, turn, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line, CAST(sum(length(body)) AS BIGINT) AS chars FROM r GROUP BY conv_id, turn, paragraph, piece""",
)
def _(t):
    docs = t.conversations.select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit("\n\n")).alias("text"))
    return P.text_chunks(docs, ["conv_id", "turn"], "text")


@query("s07_line_spans", "SELECT doc_id, concat(array_to_string(string_split(text, chr(10))[1:2], chr(10)), chr(10)) AS span FROM {documents}")
def _(t):
    return t.documents.select("doc_id", X.spans_of_lines(c("text"), F.lit(1), F.lit(2)).alias("span"))


@query(
    "s08_transcript_turns",
    """WITH o AS (SELECT * FROM {turns} WHERE role IN ('user', 'assistant')), n AS (SELECT *, CASE WHEN role = 'user' OR lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY session_id ORDER BY turn_number)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY turn_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM n)
    SELECT session_id, number, role, string_agg(content, chr(10) || chr(10) ORDER BY turn_number) AS content FROM r GROUP BY session_id, number, role""",
)
def _(t):
    return P.merged_turns(t.turns)


@query("s10_markdown_facts", "SELECT p_partkey AS key, CAST(1 AS INTEGER) AS number, p_name AS heading, concat(p_type, chr(10), 'second line') AS body, concat(p_brand, ',x') AS tags, CASE WHEN p_size > 25 THEN 'on-demand' ELSE 'always' END AS scope FROM {part}")
def _(t):
    text = F.concat(F.lit("# Facts\n\nintro\n### "), "p_name", F.lit("\n"), "p_type", F.lit("\nsecond line\ntags: "), "p_brand", F.lit(", x,\nscope: "), F.when(c("p_size") > 25, "on-demand").otherwise("always"), F.lit("\n\n## Other\nnot a fact\n"))
    return P.markdown_records(t.part.select(c("p_partkey").alias("key"), text.alias("text")), "key", "text")


@query("s16_prefix_scan", "SELECT id FROM {nodes} WHERE starts_with(id, 'part::p1')")
def _(t):
    return t.nodes.filter(c("id").startswith("part::p1")).select("id")


@query("s20_suffix_scan", "SELECT id FROM {nodes} WHERE id = 'p77' OR ends_with(id, '::p77') OR ends_with('p77', concat('::', id))")
def _(t):
    n = F.lit("p77")
    return t.nodes.filter((c("id") == n) | c("id").endswith("::p77") | n.endswith(F.concat(F.lit("::"), "id"))).select("id")


@query("s22_flexible_paths", "SELECT id FROM {nodes} WHERE path = 'shop/part3.ts' OR ends_with(path, '/part3.ts')")
def _(t):
    return t.nodes.filter(X.path_matches(c("path"), F.lit("./part3.ts"))).select("id")


@query("s23_latest_episodes", "SELECT id, kind FROM {episodes} ORDER BY id DESC LIMIT 20")
def _(t):
    return t.episodes.select("id", "kind").orderBy(c("id").desc()).limit(20)


@query("s24_decay_scan", "SELECT id, CAST(salience AS DOUBLE) AS salience, greatest(access_count, 0) AS access_count, coalesce(accessed_s, at_s) AS last_s FROM {episodes}")
def _(t):
    return t.episodes.select("id", c("salience").cast("double").alias("salience"), F.greatest("access_count", F.lit(0)).alias("access_count"), F.coalesce("accessed_s", "at_s").alias("last_s"))


@query("s25_recent_turns", "SELECT session_id, turn_number FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) AS rn FROM {turns}) WHERE rn <= 3")
def _(t):
    from skein.operators.relational import capped_per_key

    return capped_per_key(t.turns, ["session_id"], [c("turn_number").desc()], 3).select("session_id", "turn_number")


@query("s29_event_log", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}")
def _(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("s31_diff_hunks", "SELECT o_orderkey AS id, concat('src/f', o_custkey, '.rs') AS path, CAST(1 + o_orderkey % 50 AS INTEGER) AS a, CAST(o_orderkey % 50 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 4 END AS INTEGER) AS b FROM {orders} WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 > 0")
def _(t):
    length = F.when(c("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), c("o_orderkey") % 4))
    text = F.concat(F.lit("diff --git\n--- a/x\n+++ b/src/f"), "o_custkey", F.lit(".rs\n@@ -3,2 +"), 1 + c("o_orderkey") % 50, length, F.lit(" @@ fn x\n+new\n-old\n+++ /dev/null\n@@ -1 +0,0 @@\n"))
    return P.diff_hunks(t.orders.select(c("o_orderkey").alias("id"), text.alias("text")), "id", "text")


@query("s32_patch_paths", "SELECT o_orderkey AS id, CAST(2 AS INTEGER) AS line, concat('a/', o_custkey, '.rs') AS path FROM {orders} UNION ALL SELECT o_orderkey, 4, 'moved.rs' FROM {orders}")
def _(t):
    text = F.concat(F.lit("*** Begin Patch\n*** Update File: a/"), "o_custkey", F.lit(".rs\n *** Add File: indented.rs\n*** Move to: moved.rs\n"))
    return P.patch_paths(t.orders.select(c("o_orderkey").alias("id"), text.alias("text")), "id", "text")


@query("s33_front_matter", "SELECT p_partkey, p_name AS name, p_brand AS description FROM {part}")
def _(t):
    text = F.concat(F.lit("---\nname: "), "p_name", F.lit("\ndescription: \""), "p_brand", F.lit("\"\n9bad: x\n---\nbody: no\n"))
    m = P.front_matter(text)
    return t.part.select("p_partkey", F.try_element_at(m, F.lit("name")).alias("name"), F.try_element_at(m, F.lit("description")).alias("description"))


@query("s37_orphan_slugs", "SELECT DISTINCT concat('u', user_id) AS slug FROM {events} WHERE user_id NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 3 = 0)")
def _(t):
    known = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("slug"))
    return t.events.select(F.concat(F.lit("u"), "user_id").alias("slug")).distinct().join(known, "slug", "left_anti")
