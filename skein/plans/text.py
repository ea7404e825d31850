"""Queries over scalar and text expressions, and filters built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.plans.registry import query

c = F.col
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def low(x: str) -> str:
    return _LOW.replace("{0}", x)


TOKENS = "list_filter(regexp_split_to_array(" + low("text") + r", '[^\p{L}\p{N}_:]+'), lambda t: strlen(t) >= 3)"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def sim_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({low(x)}, '[^A-Za-z0-9_]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP})))"


@query("c01_recall_tokens", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, array_to_string({TOKENS}[1:5], ' ') AS head FROM {{documents}}")
def _(t):
    tokens = X.recall_tokens(c("text"))
    return t.documents.select("doc_id", F.size(tokens).cast("long").alias("n"), F.array_join(F.slice(tokens, 1, 5), " ").alias("head"))


@query("c02_similarity_tokens", f"SELECT item_id, array_to_string(list_sort({sim_tokens('text')}), ' ') AS tokens FROM {{benchmark}}")
def _(t):
    return t.benchmark.select("item_id", F.array_join(F.array_sort(X.similarity_tokens(c("text"))), " ").alias("tokens"))


@query(
    "c03_jaccard_neighbours",
    f"""WITH s AS (SELECT item_id, {sim_tokens('text')} AS k FROM {{benchmark}})
    SELECT a.item_id AS a, b.item_id AS b,
           round(CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) END, 9) AS similarity
    FROM s a JOIN s b ON b.item_id = a.item_id + 1""",
)
def _(t):
    s = t.benchmark.select("item_id", X.similarity_tokens(c("text")).alias("k"))
    after = s.select((c("item_id") - 1).alias("item_id"), c("item_id").alias("b"), c("k").alias("k2"))
    return s.join(after, "item_id").select(c("item_id").alias("a"), "b", F.round(X.jaccard(c("k"), c("k2")), 9).alias("similarity"))


@query("c05_slugs", f"SELECT p_partkey, regexp_replace(regexp_replace({low('p_name')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {{part}}")
def _(t):
    return t.part.select("p_partkey", X.slug(c("p_name")).alias("slug"))


@query("c06_segments", "SELECT id, split_part(id, '::', -1) AS leaf, regexp_extract(id, '^(.*)::[^:]*$', 1) AS module FROM {nodes}")
def _(t):
    return t.nodes.select("id", X.last_segment(c("id")).alias("leaf"), X.module_of(c("id")).alias("module"))


@query("c10_chunk_ids", "SELECT concat(path, ':', start_line, '-', end_line) AS chunk_id, path, CAST(start_line AS INT) AS a, CAST(end_line AS INT) AS b FROM {spans}")
def _(t):
    made = t.spans.select(F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line").alias("chunk_id"))
    part = lambda i: F.regexp_extract("chunk_id", r"^(.*):(\d+)-(\d+)$", i)
    return made.select("chunk_id", part(1).alias("path"), part(2).cast("int").alias("a"), part(3).cast("int").alias("b"))


@query("c11_content_hash", "SELECT doc_id, sha256(text) AS hash, concat('cx_', substring(sha256(concat(source, ':', doc_id)), 1, 24)) AS archive_id FROM {documents}")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"), F.concat(F.lit("cx_"), F.substring(F.sha2(F.concat("source", F.lit(":"), "doc_id"), 256), 1, 24)).alias("archive_id"))


@query("c13_retention_score", "SELECT id, round(salience * exp(-0.02 * greatest(0, 5000000 - coalesce(accessed_s, at_s)) / 86400.0) * ln(exp(1.0) + access_count), 6) AS score FROM {episodes}")
def _(t):
    idle = F.lit(5_000_000) - F.coalesce("accessed_s", "at_s")
    return t.episodes.select("id", F.round(S.retention(c("salience").cast("double"), idle, c("access_count")), 6).alias("score"))


@query("c14_timestamps", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS unix_s, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM {events}")
def _(t):
    return t.events.select("event_id", F.unix_timestamp("ts").alias("unix_s"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


_LITERAL = "CASE event_id % 4 WHEN 0 THEN concat(event_id, 'd') WHEN 1 THEN concat(event_id, 'h') WHEN 2 THEN concat(event_id, 'm') ELSE 'soon' END"


@query("c15_durations", f"SELECT event_id, {_LITERAL} AS literal, CAST(CASE event_id % 4 WHEN 0 THEN event_id * 86400 WHEN 1 THEN event_id * 3600 WHEN 2 THEN event_id * 60 END AS BIGINT) AS seconds FROM {{events}}")
def _(t):
    return t.events.selectExpr("event_id", f"{_LITERAL} AS literal").withColumn("seconds", S.duration_seconds(c("literal")))


@query("c16_labels", "SELECT event_id, CASE WHEN event_id % 500 < 60 THEN concat(event_id % 500, 's') ELSE printf('%dm%02ds', (event_id % 500) // 60, (event_id % 500) % 60) END AS label FROM {events}")
def _(t):
    return t.events.select("event_id", S.elapsed(c("event_id") % 500).alias("label"))


@query("c17_token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens FROM {documents}")
def _(t):
    return t.documents.select("doc_id", S.estimated_tokens(c("text")).alias("tokens"))


@query("c19_grades", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.7 THEN 'A' WHEN l_discount * 10 >= 0.5 THEN 'B' WHEN l_discount * 10 >= 0.3 THEN 'C' WHEN l_discount * 10 >= 0.1 THEN 'D' ELSE 'F' END AS grade FROM {lineitem}")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.grade(c("l_discount") * 10).alias("grade"))


@query("c26_ansi_strip", "SELECT doc_id, concat(lang, source) AS plain FROM {documents}")
def _(t):
    coloured = F.concat(F.lit("\x1b[1;31m"), "lang", F.lit("\x1b[0m\x1b]0;title\x07"), "source", F.lit("\x1b[?25h"))
    return t.documents.select("doc_id", X.without_ansi(coloured).alias("plain"))


@query("c28_normalised", f"SELECT doc_id, trim(regexp_replace({low('text')}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM {{documents}}")
def _(t):
    return t.documents.select("doc_id", X.normalized(c("text")).alias("body"))


@query("c33_short_paths", "SELECT doc_id, concat_ws('/', 'root', '…', source, concat('d', doc_id)) AS short FROM {documents}")
def _(t):
    return t.documents.select("doc_id", X.truncated_path(F.concat_ws("/", F.lit("root"), F.lit("a"), F.lit("b"), "source", F.concat(F.lit("d"), "doc_id"))).alias("short"))


@query("c35_symbols", "SELECT p_partkey, regexp_replace(p_name, '[^a-z]+', '_', 'g') AS symbols FROM {part}")
def _(t):
    code = F.concat(F.lit("pub fn "), F.regexp_replace("p_name", "[^a-z]+", "_"), F.lit("(x: u8) {}"))
    return t.part.select("p_partkey", F.array_join(X.mentioned_symbols(code), ",").alias("symbols"))


@query("f01_scope_filter", f"SELECT id FROM {{nodes}} WHERE (path LIKE 'shop/%' OR contains(path, 'crm')) AND regexp_matches(path, '[.](py|ts)$') AND contains({low('id')}, '1')")
def _(t):
    in_scope = (c("path").startswith("shop/") | c("path").contains("crm")) & X.language_of(c("path")).isin("python", "typescript")
    return t.nodes.filter(in_scope & X.ascii_lower(c("id")).contains("1")).select("id")


@query("f05_entry_points", "SELECT id FROM {nodes} WHERE id = 'main' OR ends_with(id, '::main') OR starts_with(id, 'order::') OR contains(id, '::c1') OR ends_with(id, '99')")
def _(t):
    hit = (c("id") == "main") | c("id").endswith("::main")
    for glob in ("order::*", "*::c1*", "*99"):
        hit = hit | X.glob_at_ends(c("id"), glob)
    return t.nodes.filter(hit).select("id")


@query("f10_score_floor", "SELECT id, score FROM (SELECT id, round(1.0 / (11 + id % 40), 9) AS score FROM {episodes}) WHERE score >= 0.03")
def _(t):
    scored = t.episodes.select("id", F.round(S.reciprocal_rank(c("id") % 40), 9).alias("score"))
    return scored.filter(c("score") >= 0.03)


@query("f12_multi_needle_grep", f"SELECT doc_id FROM {{documents}} WHERE contains({low('text')}, 'password') OR contains({low('text')}, 'worthless') OR contains({low('text')}, 'token =')")
def _(t):
    needles = F.array(*[F.lit(n) for n in ("password", "worthless", "token =")])
    return t.documents.filter(F.exists(needles, lambda n: F.contains(X.ascii_lower(c("text")), n))).select("doc_id")


_MEMO = """CASE doc_id % 7 WHEN 0 THEN concat('Session 2025-01-0', 1 + doc_id % 9, ' shipped it') WHEN 1 THEN substring(sha2(text, 256), 1, 12) WHEN 2 THEN 'on 2024-05-06.' WHEN 3 THEN concat('src/', source, '/main.rs')
 WHEN 4 THEN concat('always use src/', source, '.rs') WHEN 5 THEN '' ELSE concat('prose about ', source) END"""
_LIKE = _MEMO.replace("sha2(text, 256)", "sha256(text)")


@query(
    "f14_content_policy",
    f"""WITH m AS (SELECT doc_id, trim({_LIKE}) AS memo FROM {{documents}}), b AS (SELECT *, regexp_replace(memo, '[ \\t\\n\\r.,:]', '', 'g') AS bare, {low('memo')} AS l FROM m)
    SELECT doc_id, CASE WHEN memo = '' THEN NULL WHEN regexp_matches(l, '^session 20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}[ \\t]*shipped') THEN 'session_handoff'
      WHEN regexp_matches(l, 'always|must|never|because|so that') THEN NULL WHEN regexp_matches(bare, '^[0-9a-fA-F]{{7,40}}$') AND regexp_matches(bare, '[a-fA-F]') THEN 'commit_sha_only'
      WHEN strlen(memo) <= 32 AND length(regexp_replace(memo, '[^0-9]', '', 'g')) = 8 AND regexp_matches(memo, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date_only'
      WHEN NOT contains(memo, ' ') AND contains(memo, '/') AND contains(memo, '.') THEN 'path_only' END AS policy FROM b""",
)
def _(t):
    return t.documents.selectExpr("doc_id", f"{_MEMO} AS memo").select("doc_id", X.content_policy(c("memo")).alias("policy"))


@query("f15_same_file", "SELECT s.path, h.path AS other FROM (SELECT DISTINCT path FROM {spans}) s JOIN (SELECT path FROM {hunks}) h ON h.path = s.path")
def _(t):
    spans = t.spans.select("path").distinct()
    hunks = t.hunks.select(c("path").alias("other"), F.concat(F.lit("./"), "path").alias("dotted"))
    # the last component is equal in any match, so the join is on it
    leaf = lambda p: F.substring_index(p, "/", -1)
    return spans.join(hunks, (leaf(c("path")) == leaf(c("dotted"))) & X.same_file(c("path"), c("dotted"))).select("path", "other")


@query("f16_source_files", "SELECT DISTINCT path FROM {nodes} WHERE regexp_matches(path, '[.](rs|ts|tsx|js|jsx|py|go|java|c|cpp|h|hpp|rb|swift|kt)$')")
def _(t):
    return t.nodes.filter(X.is_source_file(c("path"))).select("path").distinct()


@query("f17_incomplete_tasks", "SELECT count(*) FILTER (status NOT IN ('completed', 'done', 'skipped', 'failed')) AS strict_count, count(*) FILTER (status NOT IN ('completed', 'done', 'skipped')) AS loose_count FROM {tasks}")
def _(t):
    finished = ("completed", "done", "skipped")
    return t.tasks.agg(F.count_if(~c("status").isin(*finished, "failed")).alias("strict_count"), F.count_if(~c("status").isin(*finished)).alias("loose_count"))


@query("f20_previews", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3], ' ⏎ ') AS preview FROM {conversations}")
def _(t):
    return t.conversations.select("conv_id", "turn", X.preview(c("text")).alias("preview"))
