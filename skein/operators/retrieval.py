"""Retrieval: full-text ranking, vectors, rank fusion and what follows it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.operators.relational import ranks_per_key
from skein.sources.storage import written

c = F.col


def metadata_filter(spec: dict, field: Callable[[str], Column]) -> Column:
    """A predicate of `$eq $ne $in $and $or`, a bare value meaning equality and several keys `$and`; `{}` matches all.

    A missing key is unequal to every value: `$ne` is true for it, `$eq` and `$in` are false.
    """
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            some = [metadata_filter(s, field) for s in value]
            out = F.lit(key == "$and")
            for s in some:
                out = (out & s) if key == "$and" else (out | s)
            parts.append(out)
        elif isinstance(value, dict) and len(value) == 1 and next(iter(value)) in ("$eq", "$ne", "$in"):
            op, x = next(iter(value.items()))
            same = F.coalesce(field(key).isin(*x) if op == "$in" else field(key) == F.lit(x), F.lit(False)) if x != [] else F.lit(False)
            parts.append(~same if op == "$ne" else same)
        elif isinstance(value, dict):
            parts.append(F.lit(False))  # an object of several operators is a literal that no scalar equals
        else:
            parts.append(F.coalesce(field(key) == F.lit(value), F.lit(False)))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def equals(value: str) -> Callable[[Column], Column]:
    return lambda t: t == value


def bm25(docs: DataFrame, query: list[str], key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold a query term (runs of letters and digits, in lower case), by BM25. Only the query's terms
    are counted, in place, in one scan; the counts are written, so that totals and scores don't scan the texts again."""
    low = X.ascii_lower(c(text))
    word = r"[\p{L}\p{N}]"
    times = lambda q: F.regexp_count(low, F.lit(rf"(?<!{word})\Q{q}\E(?!{word})"))
    counted = docs.select(c(key), F.regexp_count(c(text), F.lit(rf"{word}+")).alias("dl"), *[times(q).alias(f"tf{i}") for i, q in enumerate(query)])
    sized = written(counted.select(key, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("dl", *[f"tf{i}" for i in range(len(query))])]), "term_counts")
    s = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(c(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))]).first()  # one row of totals
    total = F.lit(0.0)
    for i in range(len(query)):
        idf = F.ln(F.lit(1 + (s.n - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5)))
        total = total + idf * c(f"tf{i}") * (k1 + 1) / (c(f"tf{i}") + k1 * (1 - b + b * c("dl") / F.lit(s.avgdl)))
    hit = F.lit(False)
    for i in range(len(query)):
        hit = hit | (c(f"tf{i}") > 0)
    return sized.filter(hit).select(key, total.alias("score"))


def ranked(hits: DataFrame, stage: str, stage_no: int, order: list[Column], most: int) -> DataFrame:
    """(stage, stage_no, rank, id, ...) of the best `most` hits; rank counts from 0."""
    top = hits.orderBy(*order).limit(most)
    w = Window.orderBy(*order)  # over `most` rows
    return top.withColumns({"stage": F.lit(stage), "stage_no": F.lit(stage_no), "rank": F.row_number().over(w) - 1})


def fused(stages: list[DataFrame], k: int = S.RRF_K) -> DataFrame:
    """(id, score, stage): reciprocal ranks summed over stages; the first stage that found an id names it."""
    every = stages[0].select("id", "stage", "stage_no", "rank")
    for s in stages[1:]:
        every = every.unionByName(s.select("id", "stage", "stage_no", "rank"))
    return every.groupBy("id").agg(F.round(F.sum(S.reciprocal_rank(c("rank"), k)), 9).alias("score"), F.min_by("stage", "stage_no").alias("stage"))


def above_floor(hits: DataFrame, floor: float = S.NOISE_FLOOR, least: float = 0.0) -> DataFrame:
    """Hits of `least` or more, and none at all if the best is below the floor."""
    hits = written(hits, "fused")  # the best and the hits are read from one result
    best = hits.agg(F.max("score")).first()[0]
    return hits.filter(c("score") >= least) if best is not None and best >= floor else hits.limit(0)


def folded(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best hit of each key keeps its place and takes the scores of the others; hits with a null key pass."""
    w = Window.partitionBy(*keys)
    known = F.lit(True)
    for k in keys:
        known = known & c(k).isNotNull()
    rows = hits.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("all", F.sum("score").over(w))
    return rows.filter(~known | (c("rn") == 1)).withColumn("score", F.when(known, c("all")).otherwise(c("score"))).drop("rn", "all")


def nearest(vectors: DataFrame, query: list[float], n: int, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """(key, distance) of the n nearest by cosine distance, ties to the smaller key; all at 0 for an empty query."""
    q = F.array(*[F.lit(float(x)) for x in query]) if query else None
    distance = F.round(S.cosine_distance(c(embedding), q), 9) if query else F.lit(0.0)
    return vectors.select(c(key), distance.alias("distance")).orderBy("distance", key).limit(n)


# Words of each topic, in order of preference; a word counts once if the text holds it anywhere.
TOPICS = {
    "technical": ("code", "python", "rust", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor", "compile", "build", "cargo", "npm", "typescript", "javascript"),
    "architecture": ("architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer", "crate"),
    "planning": ("plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec", "todo"),
    "decisions": ("decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach", "instead"),
    "problems": ("problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"),
}


def topic(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS, sample: int = 3000) -> Column:
    """The topic with most words in the head of the text, the earlier of equals; general if there is none."""
    low = X.ascii_lower(F.substring(text, 1, sample))
    counts = []
    for words in topics.values():
        n = F.lit(0)
        for w in words:
            n = n + low.contains(w).cast("int")
        counts.append(n)
    best = F.greatest(*counts)
    out = F.when(best == 0, "general")
    for name, n in zip(topics, counts):
        out = out.when(n == best, name)
    return out


def symbol_stage(nodes: DataFrame, tokens: list[str]) -> DataFrame:
    """(id, path, symbol, at): nodes whose name begins with a token, in order of the first such token, then by name."""
    first = F.lit(None).cast("int")
    for i, token in reversed(list(enumerate(tokens))):
        first = F.when(c("id").startswith(token), i).otherwise(first)
    return nodes.withColumn("at", first).filter("at IS NOT NULL").select(c("id"), "path", c("id").alias("symbol"), "at")


def graph_stage(edges: DataFrame, nodes: DataFrame, seeds: list[str]) -> DataFrame:
    """(id, path, symbol, at): the nodes next to the seeds, each at the first seed that it is next to."""
    at = F.lit(None).cast("int")
    for i, seed in reversed(list(enumerate(seeds))):
        at = F.when(c("a") == seed, i).otherwise(at)
    both = edges.select(c("src").alias("a"), c("dst").alias("id")).unionByName(edges.select(c("dst").alias("a"), c("src").alias("id"))).filter(c("a").isin(*seeds) if seeds else F.lit(False))
    near = both.withColumn("at", at).groupBy("id").agg(F.min("at").alias("at"))
    return nodes.join(near, "id").select("id", "path", c("id").alias("symbol"), "at")


def grep_stage(records: DataFrame, tokens: list[str], fields: list[str], path: str, prefix: str) -> DataFrame:
    """(id, path, symbol, at): records (n, key, ...) of a memory file of which a field holds a token; ids are hashes of the key."""
    hit = F.lit(False)
    for field in fields:
        for token in tokens:
            hit = hit | F.coalesce(F.contains(X.ascii_lower(c(field)), F.lit(token)), F.lit(False))
    return records.filter(hit).select(F.concat(F.lit(f"{prefix}:"), F.sha2(c("key"), 256)).alias("id"), F.lit(path).alias("path"), F.lit(None).cast("string").alias("symbol"), c("n").alias("at"))


def recall(query: str, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, facts: DataFrame, lessons: DataFrame, preferences: DataFrame, vectors: DataFrame | None = None, k: int = 8, boost: float = 1.0, least: float = 0.0) -> DataFrame:
    """(id, path, symbol, score, stage) of the k best answers to a query, from all stages, fused by reciprocal rank.

    Stages, in the order in which they name an answer that several found: symbols that begin with a token; the 3k best chunks (id, path,
    symbol, text) by BM25; the neighbours of the first eight symbols of both; facts (n, key, text, tags), lessons (n, key, text) and preferences (n, key,
    text, tags) that hold a token; and, where given, the 3k nearest `vectors` (id, path, symbol, at, by rising distance). Memory files count
    `boost` times. Nothing is said if the best is below the floor; answers of one path and symbol are folded.
    """
    tokens = [x for x in re.split(r"[^\w:]+", query.lower()) if len(x.encode()) >= 3]
    terms = [x for x in dict.fromkeys(re.split(r"[\W_]+", query.lower())) if x]
    symbols = written(symbol_stage(nodes, tokens), "symbol_stage")
    best = bm25(chunks, terms, "id", "text").orderBy(c("score").desc(), "id").limit(3 * k) if terms else chunks.limit(0).select("id", F.lit(0.0).alias("score"))
    full = written(chunks.select("id", "path", "symbol").join(F.broadcast(best), "id").select("id", "path", "symbol", (-c("score")).alias("at")), "full_text_stage")  # 3k rows
    firsts = [r.symbol for d in (symbols, full) for r in d.filter("symbol IS NOT NULL").orderBy("at", "id").limit(8).collect()][:8]
    stages = {"symbol": symbols, "full_text": full, "graph": graph_stage(edges, nodes, firsts), "fact": grep_stage(facts, tokens, ["text", "tags"], "MEMORY.md", "memory.md"), "lesson": grep_stage(lessons, tokens, ["text"], "LESSONS.md", "lessons.md"), "preference": grep_stage(preferences, tokens, ["text", "tags"], "USER.md", "user.md")}
    if vectors is not None:
        stages["vector"] = vectors
    every = None
    for i, (name, rows) in enumerate(stages.items()):
        one = rows.select("id", "path", "symbol", c("at").cast("double").alias("at"), F.lit(name).alias("stage"), F.lit(i).alias("stage_no"))
        every = one if every is None else every.unionByName(one)
    ranked = ranks_per_key(every, "stage", [c("at"), c("id")])
    score = F.sum(S.reciprocal_rank(c("rank")) * F.when(c("stage").isin("fact", "lesson", "preference"), boost).otherwise(1.0))
    hits = ranked.groupBy("id").agg(F.round(score, 9).alias("score"), F.min_by(F.struct("stage", "path", "symbol"), "stage_no").alias("first")).select("id", "first.path", "first.symbol", "score", "first.stage")
    kept = folded(above_floor(hits, least=least), ["path", "symbol"], [c("score").desc(), c("id")])
    return kept.orderBy(c("score").desc(), "id").limit(k).select("id", "path", "symbol", F.round("score", 9).alias("score"), "stage")


def edit_budget(token: str) -> int | None:
    """Edits that a fuzzy match of a token may need: none below four bytes, two from eight on."""
    size = len(token.encode())
    return None if size < 4 else 2 if size >= 8 else 1
