"""Queries over ranking, vectors, fusion and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.operators import relational as R
from skein.operators import fulltext as I
from skein.operators import retrieval as Q
from skein.plans.registry import query

c = F.col
ASKED = ["the", "ereti", "worthless", "password"]
_TERMS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_TF = ", ".join(f"len(list_filter(terms, lambda t: t = '{q}')) AS tf{i}" for i, q in enumerate(ASKED))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(ASKED)))
_BM25 = f"""t AS (SELECT doc_id, {_TERMS} AS terms FROM {{documents}}), z AS (SELECT doc_id, len(terms) AS dl, {_TF} FROM t),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(ASKED)))} FROM z),
    bm AS (SELECT doc_id, round({_SCORE}, 6) AS score FROM z, st WHERE {' + '.join(f'tf{i}' for i in range(len(ASKED)))} > 0)"""


def bm25(t):
    return Q.bm25(t.documents, ASKED, "doc_id", "text").withColumn("score", F.round("score", 6))


@query("r03_bm25", f"WITH {_BM25} SELECT doc_id, score FROM bm")
def _(t):
    return bm25(t)


def _indexed(text: str) -> str:
    return f"WITH {_BM25} SELECT doc_id, score FROM bm".replace("{documents}", f"(SELECT doc_id, {text} AS text FROM {{documents}})")


@query("j04_indexed_search", f"WITH {_BM25} SELECT doc_id, score, source FROM bm JOIN {{documents}} USING (doc_id)")
def _(t):
    index = I.build(t.documents, "doc_id", "text")
    return I.search(t.spark, index, " ".join(ASKED)).withColumn("score", F.round("score", 6)).join(t.documents.select("doc_id", "source"), "doc_id")


@query("k06_indexed_upsert", _indexed(f"CASE WHEN source = 'src1' THEN concat(text, ' {ASKED[0]}') ELSE text END"))
def _(t):
    index = I.build(t.documents, "doc_id", "text")
    changed = t.documents.filter("source = 'src1'").select("doc_id", F.concat("text", F.lit(f" {ASKED[0]}")).alias("text"))
    return I.search(t.spark, I.upsert(index, changed, "text"), " ".join(ASKED)).withColumn("score", F.round("score", 6))


@query("k07_full_text_delete", f"WITH {_BM25} SELECT doc_id, score FROM bm".replace("{documents}", "(SELECT doc_id, text FROM {documents} WHERE source <> 'src2')"))
def _(t):
    """A search after the documents of one source were removed from the index: neither they nor their words count."""
    index = I.remove(I.build(t.documents, "doc_id", "text"), t.documents.filter("source = 'src2'").select("doc_id"))
    return I.search(t.spark, index, " ".join(ASKED)).withColumn("score", F.round("score", 6))


@query("r17_turn_search")
def _(t):
    turns = t.turns.withColumn("id", F.concat_ws("/", "session_id", "turn_number"))
    return I.search_turns(t.spark, I.build(turns, "id", "content", stems=True), turns, "things", 10)


_GREP = "gr AS (SELECT doc_id, n_chars FROM {documents} WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'worthless'))"
_Q0 = "q0 AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM {embeddings} WHERE vec_id = 7)"
_DIST = "round(1.0 - list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6)"


@query(
    "r01_hybrid_recall",
    f"""WITH {_BM25}, {_GREP}, s1 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, 'full_text' AS stage, 1 AS stage_no FROM bm QUALIFY rank < 24),
    s2 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, 'grep' AS stage, 2 AS stage_no FROM gr QUALIFY rank < 24),
    f AS (SELECT id, round(sum(1.0 / (11 + rank)), 9) AS score, arg_min(stage, stage_no) AS stage FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id),
    k AS (SELECT *, max(score) OVER () AS best FROM f)
    SELECT id, score, stage FROM k WHERE best >= 0.05 ORDER BY score DESC, id LIMIT 12""",
)
def _(t):
    """Full text and grep, each ranked, fused by reciprocal rank, floored, best first."""
    hits = X.ascii_lower(c("text")).contains("worthless")
    full = Q.ranked(bm25(t).withColumnRenamed("doc_id", "id"), "full_text", 1, [c("score").desc(), c("id")], 24)
    grep = Q.ranked(t.documents.filter(hits).select(c("doc_id").alias("id"), "n_chars"), "grep", 2, [c("n_chars"), c("id")], 24)
    return Q.above_floor(Q.fused([full, grep])).orderBy(c("score").desc(), "id").limit(12)


@query(
    "r02_symbol_stage",
    "SELECT id, CAST(min(n) AS INTEGER) AS token FROM {nodes} JOIN (SELECT unnest(['part::p12', 'order::o9', 'nation']) AS token, unnest([0, 1, 2]) AS n) ON starts_with(id, token) GROUP BY id",
)
def _(t):
    return Q.symbol_stage(t.nodes, ["part::p12", "order::o9", "nation"]).select("id", c("at").alias("token"))


@query("r01_all_stages")
def _(t):
    """Every stage over the engine's tables: nodes and edges of the graph, documents as chunks, parts as facts, lessons, nations as preferences."""
    chunks = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), c("source").alias("path"), F.lit(None).cast("string").alias("symbol"), "text")
    facts = t.part.select(c("p_partkey").alias("n"), F.concat("p_name", F.lit(" "), "p_type").alias("key"), F.concat("p_name", F.lit(" "), "p_type").alias("text"), c("p_brand").alias("tags"))
    lessons = t.lessons.select(F.xxhash64("trigger_text").alias("n"), c("trigger_text").alias("key"), c("trigger_text").alias("text"))
    preferences = t.nation.select(c("n_nationkey").alias("n"), c("n_name").alias("key"), c("n_name").alias("text"), F.lit("").alias("tags"))
    return Q.recall("part::p12 widget worthless src1 nation_7", t.nodes, t.edges, chunks, facts, lessons, preferences, k=12)


@query("r04_fuzzy_terms", "SELECT DISTINCT p_name AS term FROM {part} WHERE levenshtein(split_part(p_name, ' ', 2), 'widgte') <= 1 OR split_part(p_name, ' ', 2) = 'widget'")
def _(t):
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    return t.part.filter(S.osa_at_most(word, F.lit("widgte"), 1)).select(c("p_name").alias("term")).distinct()


@query("r07_vector_stage", f"WITH {_Q0} SELECT vec_id AS id, {_DIST} AS distance FROM {{embeddings}}, q0 ORDER BY distance, vec_id LIMIT 20")
def _(t):
    asked = t.embeddings.filter("vec_id = 7").first().embedding  # the query's own vector
    return Q.nearest(t.vec_chunks, list(asked), 20).withColumn("distance", F.round("distance", 6))


@query("r08_rank_fusion", "WITH r AS (SELECT user_id AS id, event_type AS stage, row_number() OVER (PARTITION BY event_type ORDER BY sum(value) DESC, user_id) - 1 AS rank FROM {events} GROUP BY user_id, event_type) SELECT id, round(sum(1.0 / (11 + rank)), 9) AS score FROM r GROUP BY id")
def _(t):
    sums = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    ranked = R.ranks_per_key(sums, "event_type", [F.desc("v"), c("user_id")])
    return ranked.groupBy(c("user_id").alias("id")).agg(F.round(F.sum(S.reciprocal_rank(c("rank"))), 9).alias("score"))


@query("r09_boost", "SELECT event_id, round(CASE WHEN event_type = 'view' THEN value * least(10, greatest(0, 1.5)) ELSE value END, 6) AS score FROM {events}")
def _(t):
    return t.events.select("event_id", F.round(F.when(c("event_type") == "view", c("value") * 1.5).otherwise(c("value")), 6).alias("score"))


@query(
    "r10_fold_duplicates",
    """WITH h AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS symbol, value AS score FROM {events}),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY score DESC, event_id) AS rn, sum(score) OVER (PARTITION BY user_id, symbol) AS s FROM h)
    SELECT event_id, round(CASE WHEN symbol IS NULL THEN score ELSE s END, 6) AS score FROM r WHERE symbol IS NULL OR rn = 1""",
)
def _(t):
    hits = t.events.select("event_id", "user_id", F.when(c("event_type") != "error", c("event_type")).alias("symbol"), c("value").alias("score"))
    return Q.folded(hits, ["user_id", "symbol"], [c("score").desc(), c("event_id")]).select("event_id", F.round("score", 6).alias("score"))


@query("r11_materialised", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:6], lambda x: trim(x)), lambda x: x <> '')[1:3], ' ⏎ ') AS preview FROM {documents}")
def _(t):
    body = F.array_join(F.slice(F.split("text", "\n"), 1, 6), "\n")
    return t.documents.select("doc_id", X.preview(body).alias("preview"))


@query(
    "r16_archive_search",
    f"WITH {_Q0}, d AS (SELECT vec_id AS id, label, {_DIST} AS distance FROM {{embeddings}}, q0), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS rn FROM d) SELECT id, label, distance FROM k WHERE rn <= 3 ORDER BY distance, id LIMIT 10",
)
def _(t):
    asked = t.embeddings.filter("vec_id = 7").first().embedding
    q = F.array(*[F.lit(float(x)) for x in asked])
    rows = t.vec_chunks.select("id", "label", F.round(S.cosine_distance(c("embedding"), q), 6).alias("distance"))
    return R.capped_per_key(rows, ["label"], [c("distance"), c("id")], 3).orderBy("distance", "id").limit(10)


# the words are written out here, not taken from the operator, so that the SQL checks them
_TOPICS = {
    "technical": "code,python,rust,function,bug,error,api,database,server,deploy,git,test,debug,refactor,compile,build,cargo,npm,typescript,javascript",
    "architecture": "architecture,design,pattern,structure,schema,interface,module,component,service,layer,crate",
    "planning": "plan,roadmap,milestone,deadline,priority,sprint,backlog,scope,requirement,spec,todo",
    "decisions": "decided,chose,picked,switched,migrated,replaced,trade-off,alternative,option,approach,instead",
    "problems": "problem,issue,broken,failed,crash,stuck,workaround,fix,solved,resolved",
}


def _topic_sql(x: str) -> str:
    low = f"translate(substring({x}, 1, 3000), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = {k: f"len(list_filter(string_split('{ws}', ','), lambda w: contains({low}, w)))" for k, ws in _TOPICS.items()}
    best = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in n.items()) + " END"


@query("r18_topics", f"SELECT conv_id, turn, {_topic_sql('text')} AS topic FROM {{conversations}}")
def _(t):
    return t.conversations.select("conv_id", "turn", Q.topic(c("text")).alias("topic"))


@query("f02_metadata_filter", "SELECT id FROM {vec_chunks} WHERE (collection = 'c1' OR label IN (2, 4)) AND label <> 3")
def _(t):
    spec = {"$or": [{"collection": {"$eq": "c1"}}, {"label": {"$in": [2, 4]}}], "label": {"$ne": 3}}
    return t.vec_chunks.filter(Q.metadata_filter(spec, c)).select("id")
