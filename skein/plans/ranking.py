"""Queries over the persisted ranked index."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import postings as P
from skein.operators import vectors as V
from skein.operators.recall import Scope, recall, span_id
from skein.plans.registry import query

c = F.col
#: A common word and a rare one; and words of the texts, each mistyped.
RARE_AND_COMMON = "the thonblean"
MISTYPED = "wrothlesz disgustinqg thanedqble qthatt xq"
_LOW = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array(" + _LOW + r", '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_TERMS = f"""f AS (SELECT doc_id, 0 AS field, {_WORDS % "text"} AS ws FROM {{documents}} UNION ALL SELECT doc_id, 1, {_WORDS % "source"} FROM {{documents}}),
    a AS (SELECT field, count(*) AS n, avg(len(ws)) AS avgdl FROM f GROUP BY field),
    p AS (SELECT doc_id, field, dl, term, count(*) AS tf FROM (SELECT doc_id, field, len(ws) AS dl, unnest(ws) AS term FROM f) GROUP BY ALL)"""


@query(
    "t03_block_max",
    f"""WITH {_TERMS}, d AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
    s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
          FROM p JOIN d USING (field, term) JOIN a USING (field) WHERE term IN ({', '.join(f"'{x}'" for x in RARE_AND_COMMON.split())}) GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10""",
)
def _(t):
    index = P.build(t.documents.select("doc_id", "text", "source"), "doc_id", ["text", "source"], near=False)
    return P.search(index, RARE_AND_COMMON, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "r04_fuzzy_search",
    f"""WITH {_TERMS}, q AS (SELECT unnest(['wrothlesz', 'disgustinqg', 'thanedqble', 'qthatt']) AS token, unnest([2, 2, 2, 1]) AS edits),
    m AS (SELECT token, term FROM (SELECT DISTINCT term FROM p), q WHERE abs(length(term) - length(token)) <= edits AND damerau_levenshtein(term, token) <= edits)
    SELECT doc_id, CAST(count(DISTINCT (token, field)) AS DOUBLE) AS score FROM p JOIN m USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
)
def _(t):
    """No document holds any of the words, so the fuzzy pass runs."""
    index = P.build(t.documents.select("doc_id", "text", "source"), "doc_id", ["text", "source"])
    return P.search(index, MISTYPED, 20).select("doc_id", "score")


@query(
    "r04_near_terms",
    f"""WITH {_TERMS}, q AS (SELECT unnest(['wrothlesz', 'disgustinqg', 'thanedqble', 'qthatt']) AS token, unnest([2, 2, 2, 1]) AS edits)
    SELECT token, term FROM (SELECT DISTINCT term FROM p), q WHERE abs(length(term) - length(token)) <= edits AND damerau_levenshtein(term, token) <= edits""",
)
def _(t):
    index = P.build(t.documents.select("doc_id", "text", "source"), "doc_id", ["text", "source"])
    return P.near_terms(index, P.fuzzy_tokens(MISTYPED))


@query("r01_recall")
def _(t):
    """Recall over documents as files, ten lines of them as a symbol and chunk, on an index of all chunks; parts, labelled sources and nations are the memory files."""
    files = t.documents.select(F.concat("source", F.lit("/d"), "doc_id").alias("path"), "text")
    nodes = t.spans.select(c("fqn").alias("id"), "path", "start_line", "end_line")
    bodies = files.join(t.spans, "path").select(span_id(c("path"), c("start_line"), c("end_line")).alias("id"), "path", c("fqn").alias("symbol"), "start_line", "end_line", X.spans_of_lines(c("text"), c("start_line"), c("end_line")).alias("body"))
    step = lambda a, b: nodes.filter(c("id").endswith(f"::{a}")).select("id", F.concat(F.substring_index("id", "::", 2), F.lit(f"::{b}")).alias("dst"), F.lit("calls").alias("kind"))
    edges = step(0, 1).unionByName(step(1, 2)).unionByName(nodes.select("id", F.split_part("path", F.lit("/"), F.lit(1)).alias("dst"), F.lit("imports").alias("kind"))).withColumnRenamed("id", "src")
    facts = t.part.select(c("p_partkey").alias("n"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.array("p_brand").alias("tags"))
    lessons = t.lessons.select(F.xxhash64("trigger_text").alias("n"), c("trigger_text").alias("trigger"), F.concat(F.lit("kept "), c("success").cast("string")).alias("advice"))
    preferences = t.nation.select(c("n_nationkey").alias("n"), c("n_name").alias("text"))
    index = P.build(bodies.filter("body <> ''"), "id", ["body", "symbol"])
    return recall(index, "doc::d12::1 worthless thanedqble src1 widget nation_7", nodes, edges, files, facts, lessons, preferences, scope=Scope(paths=("src",)), k=12)


_DIST = "round(1.0 - list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 9)"
_ARCHIVE = f"q0 AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM {{embeddings}} WHERE vec_id = 7), d AS (SELECT vec_id, vec_id // 8 AS session_id, vec_id % 8 AS chunk, label, {_DIST} AS distance FROM {{embeddings}}, q0)"


def _archive(t):
    """The embeddings as an archive: sessions of eight chunks, with the project and topic of their labels."""
    session, chunk = (c("vec_id") / 8).cast("long"), c("vec_id") % 8
    return t.embeddings.select("vec_id", session.alias("session_id"), chunk.alias("chunk"), F.when(c("label") % 2 == 0, "even").otherwise("odd").alias("project"), F.concat(F.lit("t"), "label").alias("topic"), F.concat(F.lit("chunk "), "vec_id").alias("text"), "embedding")


def _asked(t):
    return list(t.embeddings.filter("vec_id = 7").first().embedding)


@query(
    "r16_archive_filtered",
    f"""WITH {_ARCHIVE}, f AS (SELECT * FROM d WHERE label % 2 = 1 ORDER BY distance, vec_id LIMIT 40), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY distance, vec_id) AS rn FROM f)
    SELECT vec_id, session_id, chunk, round(distance, 6) AS distance, concat_ws(chr(10) || '---' || chr(10), CASE WHEN chunk > 0 THEN concat('chunk ', vec_id - 1) END, concat('chunk ', vec_id), CASE WHEN chunk < 7 AND vec_id + 1 <= (SELECT max(vec_id) FROM {{embeddings}}) THEN concat('chunk ', vec_id + 1) END) AS expanded
    FROM k WHERE rn <= 3 ORDER BY k.distance, vec_id LIMIT 20""",
)
def _(t):
    archive = _archive(t)
    found = V.archive_search(V.build(archive.drop("text"), "vec_id"), archive.select("session_id", "chunk", "text"), _asked(t), 20, project="odd")
    return found.withColumn("distance", F.round("distance", 6))


@query("r16_archive_topic", f"WITH {_ARCHIVE} SELECT vec_id, round(distance, 6) AS distance FROM d WHERE label % 2 = 0 AND label = 2 ORDER BY d.distance, vec_id LIMIT 15")
def _(t):
    where = (c("project") == "even") & (c("topic") == "t2")
    return V.nearest(V.build(_archive(t).drop("text"), "vec_id"), _asked(t), 15, where).rows.withColumn("distance", F.round("distance", 6))


@query("r13_appended_hits", f"WITH {_ARCHIVE} SELECT vec_id AS id, round(1.0 / (1 + distance), 6) AS score FROM d ORDER BY d.distance, vec_id LIMIT 5")
def _(t):
    """The five nearest of the archive, which come after a recall's own answers, scored by their distance."""
    near = V.nearest(V.build(_archive(t).drop("text"), "vec_id"), _asked(t), 5).rows
    return near.select(c("vec_id").alias("id"), F.round(1.0 / (1 + c("distance")), 6).alias("score"))
