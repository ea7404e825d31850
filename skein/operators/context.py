"""What stands around each symbol of a graph: its neighbours by section, names that it imports from elsewhere, and the symbols of its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import sole_owners
from skein.operators.relational import capped_per_key
from skein.sources.storage import written

c = F.col
#: Sections by kind: (section of the edge's source, section of its destination).
SECTIONS = {
    "calls": ("callees", "callers"),
    "extends": ("extends", "extended_by"),
    "references": (None, "references"),
    "emits": ("emits", "emitted_by"),
    "subscribes": ("subscribers", "subscribes_to"),
    "imports": ("imports_unresolved", None),
}
NAMES = [s for pair in SECTIONS.values() for s in pair if s]


def symbol_context(edges: DataFrame, nodes: DataFrame, limit: int = 32, asked: DataFrame | None = None) -> DataFrame:
    """(id, section, other) of each node, or of those `asked` (id): at most `limit` (1 to 128) others a section.

    Others are nodes, those that name the symbol in full first, then those that name its last two segments or its last one, where it alone
    owns that; each comes once, by name. `imports_unresolved` are imports without a node, and all are given. `siblings` are the other nodes
    of the symbol's path: a file's first limit + 1 are enough for all of its symbols, so no file meets itself. Ids are those of one node; null
    ids and ends take no part. Edges may repeat.

    Names meet the nodes once each, not once an edge. An edge is then shuffled by its destination, to find who is meant, and what stays of it
    by the symbol; there a section's first rows are taken before the shuffle, so a symbol that all call is no one task's work.
    """
    limit = min(max(limit, 1), 128)
    nodes = nodes.select("id", "path").dropna(subset=["id"])
    own = None if asked is None else written(nodes.join(asked.select("id"), "id", "left_semi").select("id").distinct(), "asked")
    edges = edges.select("src", "dst", "kind").filter(c("kind").isin(*SECTIONS)).dropna(subset=["src", "dst"])
    strange = _without_node(edges, nodes)
    lost, outside = (written(strange.filter(x).select("name"), x) for x in ("source", "imported"))  # a table of their own, whose size is known
    edges = edges.join(lost.withColumnRenamed("name", "src"), "src", "left_anti")
    loose = sole_owners(nodes, nodes if own is None else own, strange.filter("named").select(c("name").alias("suffix")))
    meant = strange.filter("named").join(loose.select(c("suffix").alias("name"), c("id").alias("owner"), "walk"), "name", "left")
    meant = meant.select(c("name").alias("dst"), "owner", "walk", F.lit(True).alias("strange"))

    # sections as numbers: they are shuffled with each row
    inner = edges.filter("kind <> 'imports'").select("src", "dst", *(_number(i).alias(x) for i, x in enumerate(("out", "in"))))
    met = inner.join(meant.hint("merge"), "dst", "left").filter("strange IS NULL OR owner <> src")  # the same plan at all sizes
    way = lambda at, x, y, walk, when: F.when(c(at).isNotNull() & when, F.struct(x.alias("id"), c(at).alias("section"), walk.alias("walk"), y.alias("other")))
    named = c("strange").isNull()
    both = F.array(way("out", c("src"), c("dst"), F.lit(0), named), way("in", F.coalesce("owner", "dst"), c("src"), F.coalesce("walk", F.lit(0)), F.lit(True)))
    rows = met.select(F.inline(F.array_compact(both)))
    rows = rows if own is None else rows.join(own, "id", "left_semi")
    # an other comes by three walks at most, so a section's first `limit` others lie in its first 3 * limit pairs of walk and other
    near = rows.withColumn("rn", F.dense_rank().over(Window.partitionBy("id", "section").orderBy("walk", "other"))).filter(c("rn") <= 3 * limit)
    once = near.groupBy("id", "section", "other").agg(F.min("walk").alias("walk"))
    kept = capped_per_key(once, ["id", "section"], [c("walk"), c("other")], limit)
    kept = kept.select("id", F.element_at(F.array(*map(F.lit, NAMES)), c("section") + 1).alias("section"), "other")

    imports = edges.filter("kind = 'imports'").select(c("src").alias("id"), c("dst").alias("other")).join(outside.withColumnRenamed("name", "other"), "other", "left_semi")
    imports = imports if own is None else imports.join(own, "id", "left_semi")
    return kept.unionByName(_siblings(nodes, own, limit)).unionByName(imports.distinct().select("id", F.lit("imports_unresolved").alias("section"), "other"))


def _number(way: int) -> Column:
    """The place in NAMES of the section to which an edge's kind belongs, at its source (0) or its destination (1)."""
    pairs = [(kind, pair[way]) for kind, pair in SECTIONS.items() if pair[way]]
    return F.coalesce(*(F.when(c("kind") == kind, F.lit(NAMES.index(section))) for kind, section in pairs))


def _without_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, source, imported, named) of the ends of edges that are no node: whether edges leave them, import them or lead to them otherwise."""
    imports, roles = c("kind") == "imports", ("source", "imported", "named")
    end = lambda name, *of: F.struct(c(name).alias("name"), *(x.alias(role) for role, x in zip(roles, of)))
    no, yes = F.lit(False), F.lit(True)
    ends = edges.select(F.inline(F.array(end("src", yes, no, no), end("dst", no, imports, ~imports)))).groupBy("name").agg(*(F.max(x).alias(x) for x in roles))
    return written(ends.join(nodes.select(c("id").alias("name")), "name", "left_anti"), "strange")


def _siblings(nodes: DataFrame, own: DataFrame | None, limit: int) -> DataFrame:
    ranked = nodes.filter("path IS NOT NULL").withColumn("rn", F.dense_rank().over(Window.partitionBy("path").orderBy("id"))).filter(c("rn") <= limit + 1)
    first = written(ranked.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("first")), "first")
    beside = nodes.distinct() if own is None else nodes.join(own, "id", "left_semi").distinct()
    others = beside.join(first, "path").select("id", F.filter("first", lambda x: x != c("id")).alias("others"))
    return others.select("id", F.lit("siblings").alias("section"), F.explode(F.slice("others", 1, limit)).alias("other"))
