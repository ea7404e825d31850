"""Recall on a persisted index: every stage, fused, with the bodies of the answers and what stands around them in the graph.

Stages read what they need of their tables: the ranked index for the texts, predicates that reach the scan for symbols, edges and files.
From the fused list on all work is on k rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.operators import postings as P
from skein.operators.code import docstrings
from skein.operators.relational import capped_per_key, ranks_per_key
from skein.operators.retrieval import above_floor, folded
from skein.sources.storage import written

c = F.col
#: Seeds of the graph stage, neighbours of each kind about an answer, and lines above it that may document it.
SEEDS, AROUND, ABOVE = 8, 8, 40
#: The extensions of each language; another language is its own extension.
EXTENSIONS = {
    "rust": ("rs",),
    "python": ("py", "pyi"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "tsx"),
    "go": ("go",),
    "markdown": ("md", "markdown"),
}


@dataclass(frozen=True)
class Scope:
    """What answers must be in: each axis that names something must hold. Tags are those of facts; the others don't touch memory files."""

    paths: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_scope(scope: Scope, path: Column, symbol: Column) -> Column:
    """A path that holds one of the paths, an extension of one of the languages, a symbol that holds one of the symbols in any case."""
    out = F.lit(True)
    if scope.paths:
        out = out & _any(path.contains(p) for p in scope.paths)
    if scope.languages:
        name = F.element_at(F.split(path, "/"), -1)
        extension = F.when(name.rlike(r"^.+\."), X.ascii_lower(F.element_at(F.split(name, r"\."), -1)))
        out = out & _any(extension.isin(*EXTENSIONS.get(x.lower(), (x.lower(),))) for x in scope.languages)
    if scope.symbols:
        out = out & _any(X.ascii_lower(symbol).contains(x.lower()) for x in scope.symbols)
    return F.coalesce(out, F.lit(False))


def span_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def _first_line(text: Column) -> Column:
    return F.coalesce(F.element_at(F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != ""), 1), F.lit(""))


def _memory(rows: DataFrame, tokens: list[str], fields: list[str], path: str, name: Column, said: Column) -> DataFrame:
    """Records of a memory file of which a field holds a token, in the file's order (n)."""
    hit = _any(F.coalesce(F.contains(X.ascii_lower(c(f)), F.lit(t)), F.lit(False)) for f in fields for t in tokens)
    none = F.lit(None).cast("string")
    return rows.filter(hit).select(F.concat(F.lit(f"{path.lower()}:"), F.sha2(name, 256)).alias("id"), F.lit(path).alias("path"), none.alias("symbol"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), c("n").cast("double").alias("at"), said.alias("said"))


def _unique(rows: DataFrame) -> DataFrame:
    """The first row of each id of a stage."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*[x for x in rows.columns if x != "id"]), F.struct("at", "symbol")).alias("r")).select("id", "r.*")


def stages(index: P.TopIndex, query: str, nodes: DataFrame, edges: DataFrame, facts: DataFrame, lessons: DataFrame, preferences: DataFrame, scope: Scope, vectors: DataFrame | None, k: int) -> dict[str, DataFrame]:
    """(id, path, symbol, start_line, end_line, at, said) of each stage; `at` is the place in it, `said` what a memory file says."""
    spark = nodes.sparkSession
    tokens = list(dict.fromkeys(spark.range(1).select(X.recall_tokens(F.lit(query)).alias("t")).first().t))
    none = F.lit(None).cast("string")
    shape = lambda df, symbol, at: df.select(span_id(c("path"), c("start_line"), c("end_line")).alias("id"), "path", symbol.alias("symbol"), "start_line", "end_line", at.cast("double").alias("at"), none.alias("said"))
    scoped = lambda df: df.filter(in_scope(scope, c("path"), c("symbol")))
    place = F.coalesce(*[F.when(c("id").startswith(t), i) for i, t in enumerate(tokens)], F.lit(None)) if tokens else F.lit(None)
    # places are those of (token, name), with room for a name's rank behind the token
    named = nodes.filter(_any(c("id").startswith(t) for t in tokens)).withColumn("at", place)
    out = {"symbol": written(scoped(_unique(shape(named, c("id"), c("at")))), "symbol_stage")}
    best = P.search(index, query, 3 * k)
    out["full_text"] = written(scoped(shape(best, c("symbol"), -c("score")).withColumn("id", F.coalesce("id", F.lit("")))), "full_text_stage")
    seeds: list[str] = []
    for stage in ("symbol", "full_text"):
        seeds += [r.symbol for r in out[stage].filter("symbol IS NOT NULL").orderBy("at", "symbol", "id").limit(SEEDS).collect()]
    seeds = list(dict.fromkeys(seeds[:SEEDS]))
    either = lambda a, b: edges.filter(c(a).isin(*seeds)).select(c(a).alias("seed"), c(b).alias("id"))
    near = either("src", "dst").unionByName(either("dst", "src")).filter("seed <> id").withColumn("at", F.coalesce(*[F.when(c("seed") == x, i) for i, x in enumerate(seeds)], F.lit(None)) if seeds else F.lit(None))
    next_ = nodes.join(near.groupBy("id").agg(F.min("at").alias("at")), "id").withColumn("end_line", c("start_line"))
    out["graph"] = scoped(_unique(shape(next_, c("id"), c("at"))))
    tagged = facts.filter(_any(F.array_contains(F.transform("tags", X.ascii_lower), x.lower()) for x in scope.tags)) if scope.tags else facts
    out["fact"] = _memory(tagged.withColumn("words", F.array_join("tags", " ")), tokens, ["text", "words"], "MEMORY.md", c("text"), _first_line(c("text")))
    advice = F.concat(F.lit("lesson — "), F.trim("trigger"), F.when(_first_line(c("advice")) != "", F.concat(F.lit(" → "), _first_line(c("advice")))).otherwise(""))
    out["lesson"] = _memory(lessons, tokens, ["trigger", "advice"], "LESSONS.md", F.lower(F.trim("trigger")), advice)
    out["preference"] = _memory(preferences, tokens, ["text"], "USER.md", c("text"), F.concat(F.lit("preference — "), _first_line(c("text"))))
    if vectors is not None:
        out["vector"] = scoped(shape(vectors, none, c("at")))
    return out


def fuse(found: dict[str, DataFrame], boost: float = 1.0) -> DataFrame:
    """(id, path, symbol, start_line, end_line, said, score, stage): reciprocal ranks summed over the stages; the first that found an answer names it."""
    every = None
    for i, (name, rows) in enumerate(found.items()):
        one = rows.withColumns({"stage": F.lit(name), "stage_no": F.lit(i)})
        every = one if every is None else every.unionByName(one)
    ranked = ranks_per_key(every, "stage", [c("at"), c("symbol"), c("id")])
    score = F.sum(S.reciprocal_rank(c("rank")) * F.when(c("stage").isin("fact", "lesson", "preference"), boost).otherwise(1.0))
    first = F.min_by(F.struct("path", "symbol", "start_line", "end_line", "said", "stage"), "stage_no").alias("first")
    return ranked.groupBy("id").agg(F.round(score, 9).alias("score"), first).select("id", "score", "first.*")


def with_bodies(answers: DataFrame, files: DataFrame) -> DataFrame:
    """`answers` with `body` and `preview`: the lines that an answer spans in its file (path, text), or what a memory file says. The paths of the
    answers, k at most, reach the scan of the files."""
    paths = [r.path for r in answers.filter("said IS NULL").select("path").distinct().collect()]
    texts = files.filter(c("path").isin(*paths)).select(c("path").alias("of"), "text") if paths else files.limit(0).select(c("path").alias("of"), "text")
    start = F.greatest("start_line", F.lit(1))
    both = answers.join(texts, (c("path") == c("of")) & c("said").isNull(), "left")
    body = F.coalesce("said", X.spans_of_lines(c("text"), start, F.greatest("end_line", start)), F.lit(""))
    above = F.array_join(F.slice(F.split("text", "\n"), F.greatest(start - ABOVE, F.lit(1)), F.least(start - 1, F.lit(ABOVE))), "\n")
    return both.withColumns({"body": body, "above": F.coalesce(F.when(c("said").isNull() & (start > 1), above), F.lit(""))}).withColumn("preview", F.coalesce("said", X.preview(c("body")))).drop("of", "text")


def with_context(answers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`answers` with `callers`, `callees`, `siblings` (AROUND at most, by name), `imports` and `doc`; memory files have none of them."""
    mine = written(answers, "answers")
    code = mine.filter("said IS NULL")
    names, paths = ([r[0] for r in code.filter(c(x).isNotNull()).select(x).distinct().collect()] for x in ("symbol", "path"))
    calls = edges.filter("kind = 'calls'")

    def gathered(pairs: DataFrame, name: str, most: int | None = AROUND) -> DataFrame:
        some = pairs.distinct() if most is None else capped_per_key(pairs.distinct(), ["key"], [c("other")], most)
        return some.groupBy(c("key").alias(f"{name}_key")).agg(F.sort_array(F.collect_list("other")).alias(name))

    known = nodes.select(c("id").alias("other"))
    callers = gathered(calls.filter(c("dst").isin(*names)).select(c("dst").alias("key"), c("src").alias("other")).join(known, "other", "left_semi"), "callers")
    callees = gathered(calls.filter(c("src").isin(*names)).select(c("src").alias("key"), c("dst").alias("other")).join(known, "other", "left_semi"), "callees")
    here = nodes.filter(c("path").isin(*paths)).select("path", "id")
    pairs = code.select("id", "path", "symbol").alias("a").join(here.alias("b"), (c("a.path") == c("b.path")) & ~c("a.symbol").eqNullSafe(c("b.id")))
    siblings = gathered(pairs.select(c("a.id").alias("key"), c("b.id").alias("other")), "siblings")
    imports = gathered(here.join(edges.filter("kind = 'imports'"), c("id") == c("src")).select(c("path").alias("key"), c("dst").alias("other")), "imports", None)
    trimmed = F.regexp_extract("above", r"((?:^|\n)(?:[ \t]*(?:[/*#'\"][^\n]*)?(?:\n|$))*)$", 1)
    docs = docstrings(code.select("path", "start_line", F.concat(F.ltrim(trimmed), F.when(trimmed != "", "\n").otherwise(""), "body").alias("body"))).select(c("path").alias("doc_path"), c("start_line").alias("doc_line"), "doc").dropDuplicates(["doc_path", "doc_line"])
    out = mine.join(callers, c("symbol") == c("callers_key"), "left").join(callees, c("symbol") == c("callees_key"), "left").join(siblings, c("id") == c("siblings_key"), "left")
    out = out.join(imports, (c("path") == c("imports_key")) & c("said").isNull(), "left").join(docs, (c("path") == c("doc_path")) & (c("start_line") == c("doc_line")) & c("said").isNull(), "left")
    empty = F.array().cast("array<string>")
    return out.select(*[x for x in mine.columns if x != "above"], *[F.coalesce(x, empty).alias(x) for x in ("callers", "callees", "siblings", "imports")], "doc")


def recall(
    index: P.TopIndex, query: str, nodes: DataFrame, edges: DataFrame, files: DataFrame, facts: DataFrame, lessons: DataFrame, preferences: DataFrame,
    scope: Scope = Scope(), vectors: DataFrame | None = None, k: int = 8, boost: float = 1.0, least: float = 0.0,
) -> DataFrame:
    """The k best answers: id, path, start_line, end_line, symbol, score, stage, preview, body, callers, callees, siblings, imports, doc.

    `index` is over chunks (id as span_id(), path, symbol, start_line, end_line); where none of them holds a word of the query, words like
    those of the query count. `nodes` (id, path, start_line, end_line), `edges` (src, dst, kind), `files` (path, text), facts (n, text, tags array),
    lessons (n, trigger, advice) and preferences (n, text) are the other tables, `vectors` (path, start_line, end_line, at) the nearest chunks. Nothing
    is said if the best is below the floor; answers of one path and symbol are folded into the better one.
    """
    found = stages(index, query, nodes, edges, facts, lessons, preferences, scope, vectors, max(k, 1))
    kept = folded(above_floor(fuse(found, boost), least=least), ["path", "symbol"], [c("score").desc(), c("id")])
    best = written(kept.orderBy(c("score").desc(), "id").limit(max(k, 1)), "best_answers")
    out = with_context(with_bodies(best, files), nodes, edges)
    return out.select("id", "path", "start_line", "end_line", "symbol", F.round("score", 9).alias("score"), "stage", "preview", "body", "callers", "callees", "siblings", "imports", "doc")
