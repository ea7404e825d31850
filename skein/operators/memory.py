"""Memory files as tables: entries, previews, pending queues, capped appends, edits by query, and JSON documents."""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X

c = F.col
# Bytes that each kind of memory file may hold.
CAPS = {"memory": 16_384, "user": 4_096, "lessons": 16_384}
#: Similarity from which the best of several matches of a query is taken.
ACCEPT = 0.6


def rendered_fact(heading: Column, body: Column, tags: Column, scope: Column) -> Column:
    """The text of a fact: a heading of three levels, the body, then tags and scope where they say something."""
    return F.concat(F.lit("### "), heading, F.lit("\n"), F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(""), F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", "), F.lit("\n"))).otherwise(""), F.when(scope == "on-demand", "scope: on-demand\n").otherwise(""))


def first_line(text: Column, most: int = 120) -> Column:
    """The first line that isn't blank, trimmed, cut with an ellipsis beyond `most` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    one = F.coalesce(F.get(lines, 0), F.lit(""))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most), F.lit("…")))


def previews(entries: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, index from 0, first_line, bytes) of each entry of each file."""
    index = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return entries.select(key, index.alias("index"), first_line(c(text)).alias("first_line"), F.octet_length(text).alias("bytes"))


def best_match(entries: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """The one entry that a query means, or no row: the only one that holds it, else the one whose words are nearest, if near enough and nearer than all others."""
    hits = entries.filter(X.ascii_lower(c(text)).contains(query.lower()))
    asked = X.similarity_tokens(F.lit(query))
    scored = hits.withColumn("near", X.jaccard(X.similarity_tokens(c(text)), asked))
    top = scored.orderBy(c("near").desc(), key).limit(2)
    w = Window.orderBy(c("near").desc(), key)  # over two rows
    ranked = top.withColumns({"rn": F.row_number().over(w), "next": F.lead("near").over(w)})
    return ranked.filter((c("rn") == 1) & (c("next").isNull() | ((c("near") >= ACCEPT) & (c("near") > c("next"))))).drop("near", "rn", "next")


def replaced(entries: DataFrame, key: str, text: str, query: str, new: str | None) -> DataFrame:
    """`entries` with the one that the query means given a new text, or gone if `new` is None; as they were if it means none or several."""
    one = best_match(entries, key, text, query).select(key, F.lit(True).alias("hit"))
    marked = entries.join(F.broadcast(one), key, "left")  # one row
    out = marked.filter(c("hit").isNull()) if new is None else marked.withColumn(text, F.when(c("hit"), new).otherwise(c(text)))
    return out.drop("hit")


def promoted(pending: DataFrame, order: str, index: int) -> tuple[DataFrame, DataFrame]:
    """(the pending entry at `index` from 0, the rest); nothing moves if there is none."""
    at = pending.select(order).orderBy(order).offset(index).limit(1).withColumn("hit", F.lit(True))
    marked = pending.join(F.broadcast(at), order, "left")
    return marked.filter("hit").drop("hit"), marked.filter("hit IS NULL").drop("hit")


def split_by_triggers(lessons: DataFrame, triggers: list[str], trigger: str = "trigger_text") -> tuple[DataFrame, DataFrame]:
    """(lessons whose trigger is one of those given, in any case, and the rest)."""
    hit = F.coalesce(X.ascii_lower(F.trim(trigger)).isin(*[t.strip().lower() for t in triggers]), F.lit(False)) if triggers else F.lit(False)
    return lessons.filter(hit), lessons.filter(~hit)


def bumped(lessons: DataFrame, triggers: list[str], counter: str, trigger: str = "trigger_text") -> DataFrame:
    hit = X.ascii_lower(F.trim(trigger)).isin(*[t.strip().lower() for t in triggers])
    return lessons.withColumn(counter, c(counter) + F.coalesce(hit, F.lit(False)).cast("long"))


def accepted_within(entries: DataFrame, key: str, order: str, size: Column, cap: int) -> DataFrame:
    """(key, order, accepted): appends in order, each accepted if what was accepted before and it fit the cap; a rejected one takes no room."""
    state = F.aggregate(
        F.array_sort(F.collect_list(F.struct(c(order).alias("at"), size.cast("long").alias("size")))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<at:{dict(entries.dtypes)[order]},ok:boolean>>").alias("out")),
        lambda s, x: F.struct((s["used"] + F.when(s["used"] + x["size"] <= cap, x["size"]).otherwise(F.lit(0).cast("long"))).alias("used"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), (s["used"] + x["size"] <= cap).alias("ok")))).alias("out")),
        lambda s: s["out"],
    )
    return entries.groupBy(key).agg(state.alias("out")).select(key, F.explode("out").alias("x")).select(key, c("x.at").alias(order), c("x.ok").alias("accepted"))


def sanitised_query(q: Column) -> Column:
    """A long prompt cut to what it asks: its last line that is a question, else its last question, else its last sentence of ten characters, else its tail."""
    lines = F.filter(F.transform(F.split(q, "\n"), lambda x: F.trim(x)), lambda x: F.endswith(x, F.lit("?")))
    questions = F.transform(F.regexp_extract_all(q, F.lit(r"([^.!?\n]*\?)"), F.lit(1)), lambda x: F.trim(x))
    parts = F.filter(F.transform(F.split(q, r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 10)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.when(F.octet_length(q) <= 200, q).otherwise(F.substring(F.coalesce(last(lines), last(questions), last(parts), q), -250, 250))


def _no_json(name: str):
    raise ValueError(f"{name} is no JSON")


def _compacted(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            short = json.dumps(json.loads(x, parse_constant=_no_json), ensure_ascii=False, separators=(",", ":")) + ("\n" if x.endswith("\n") else "")
        except ValueError:
            return x
        return short if len(short.encode()) < len(x.encode()) else x

    return s.map(one)


def compacted_json(text: Column | str) -> Column:
    """JSON without white space where that is shorter, a last line end kept; other texts as they are."""
    return F.pandas_udf(_compacted, "string")(text)


def _pointer(path: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]


def patched(document, operations: list[dict]):
    """RFC 6902: the document after the operations; ValueError if one can't be done, and then none is."""
    doc = copy.deepcopy(document)

    def get(parts):
        at = doc
        for p in parts:
            try:
                at = at[int(p)] if isinstance(at, list) else at[p]
            except (KeyError, IndexError, TypeError, ValueError):
                raise ValueError(f"no such path: {parts}") from None
        return at

    def put(parts, value, replace):
        nonlocal doc
        if not parts:
            doc = value
            return
        at, key = get(parts[:-1]), parts[-1]
        if isinstance(at, list):
            i = len(at) if key == "-" else int(key)
            if not 0 <= i <= len(at) - replace:
                raise ValueError(f"no such index: {parts}")
            at[i : i + replace] = [value]
        elif isinstance(at, dict):
            if replace and key not in at:
                raise ValueError(f"no such path: {parts}")
            at[key] = value
        else:
            raise ValueError(f"not a container: {parts}")

    def drop(parts):
        value, at = get(parts), get(parts[:-1])
        del at[int(parts[-1]) if isinstance(at, list) else parts[-1]]
        return value

    for o in operations:
        parts = _pointer(o["path"])
        match o["op"]:
            case "add":
                put(parts, o["value"], False)
            case "replace":
                put(parts, o["value"], True)
            case "remove":
                drop(parts)
            case "move":
                put(parts, drop(_pointer(o["from"])), False)
            case "copy":
                put(parts, copy.deepcopy(get(_pointer(o["from"]))), False)
            case "test":
                if get(parts) != o["value"]:
                    raise ValueError(f"test failed: {parts}")
            case other:
                raise ValueError(f"unknown operation {other}")
    return doc


def _patched(document: pd.Series, patch: pd.Series) -> pd.Series:
    def one(d, p):
        try:
            return json.dumps(patched(json.loads(d), json.loads(p)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, TypeError, KeyError):
            return None

    return pd.Series([one(d, p) for d, p in zip(document, patch)], dtype=object)


def patched_json(document: Column | str, patch: Column | str) -> Column:
    """The JSON document after the JSON patch; null if either doesn't parse or an operation can't be done."""
    return F.pandas_udf(_patched, "string")(document, patch)


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def statement_edges(statements: DataFrame) -> DataFrame:
    """(src, dst, kind) among statements (fn, line, text), named `fn#s<line>`: cfg from each to the next of its function, data_dep
    from the last assignment of a name on an earlier line to each use of it."""
    node = lambda line: F.concat("fn", F.lit("#s"), line)
    after = statements.withColumn("next", F.lead("line").over(Window.partitionBy("fn").orderBy("line")))
    cfg = after.filter("next IS NOT NULL").select(node(c("line")).alias("src"), node(c("next")).alias("dst"), F.lit("cfg").alias("kind"))
    assigned = F.regexp_extract("text", rf"^\s*(?:let\s+(?:mut\s+)?)?({_NAME})\s*(?::[^=]*)?=[^=]", 1)
    right = F.when(assigned != "", F.regexp_replace("text", r"^[^=]*=", "")).otherwise(c("text"))
    defs = statements.select("fn", "line", assigned.alias("name"), F.lit(True).alias("is_def")).filter("name <> ''")
    uses = statements.select("fn", "line", F.explode(F.array_distinct(F.regexp_extract_all(right, F.lit(f"({_NAME})"), F.lit(1)))).alias("name")).withColumn("is_def", F.lit(False))
    w = Window.partitionBy("fn", "name").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    linked = defs.unionByName(uses).withColumn("from", F.max(F.when(c("is_def"), c("line"))).over(w)).filter(~c("is_def") & c("from").isNotNull())
    data = linked.select(node(c("from")).alias("src"), node(c("line")).alias("dst"), F.lit("data_dep").alias("kind")).distinct()
    return cfg.unionByName(data)
