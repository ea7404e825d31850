"""Ranked search on a persisted index: the k best documents are found without scoring the others.

Postings lie by document, BLOCK documents to a block, and the blocks of all terms cover the same documents. A block's row holds the most
that its term can add to a score, so what a block of documents can reach is known before its postings are read: the most promising
blocks are scored first, and of the others those alone that reach the k-th score found. The result is that of scoring every document.

Terms have a dictionary and a neighbourhood index: each beginning of PREFIX letters under all that is left of it by up to EDITS deletions. The
beginnings of two words within EDITS edits of each other share such a rest, so typing errors are looked up by a join, and a long term has
no more rests than a short one.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.operators.fulltext import words
from skein.operators.retrieval import edit_budget
from skein.sources.storage import shared_dir, written

c = F.col
#: Documents of a block (a power of two), folders of postings and of neighbourhoods, parts of a term that all documents hold, edits of the
#: neighbourhoods, and the letters of a beginning.
SHIFT, BUCKETS, RESTS, SALTS, EDITS, PREFIX = 7, 64, 64, 16, 2, 6
BLOCK = 1 << SHIFT
PARTS = {
    "postings": "term string, field int, block long, entries array<struct<doc:long,tf:int,len:int>>, most int, least int, df int, bucket int",
    "terms": "term string, df long",
    "rests": "prefix string, rest string, bucket int",
}
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class TopIndex:
    """Documents numbered in the order of their key; `lengths` are the average words of each field."""

    path: str
    key: str
    fields: tuple[str, ...]
    n: int
    lengths: tuple[float, ...]
    documents: DataFrame

    def read(self, part: str) -> DataFrame:
        return self.documents.sparkSession.read.schema(PARTS[part]).parquet(f"{self.path}/{part}")


@dataclass(frozen=True)
class Best:
    """The k best (doc, score), and how many of the blocks that hold a term were scored."""

    rows: DataFrame
    blocks: int
    scored: int


def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def _prefix(word: str) -> Column:
    return F.substring(word, 1, PREFIX)


def rests(words_: DataFrame, word: str, edits: int = EDITS) -> DataFrame:
    """`words_` with `rest`: a row for the word and for what is left of it by each way to delete up to `edits` letters."""
    keep = words_.columns
    layer = words_.withColumn("rest", c(word)).withColumn("_at", F.lit(1))
    out = layer
    for _ in range(edits):
        cut = layer.filter(c("_at") <= F.length("rest")).select(*keep, "rest", F.explode(F.sequence(c("_at"), F.length("rest"))).alias("_at"))
        layer = cut.withColumn("rest", F.expr("concat(substring(rest, 1, _at - 1), substring(rest, _at + 1))"))  # what follows is deleted from here on
        out = out.unionByName(layer)
    return out.drop("_at")


def build(docs: DataFrame, key: str, fields: list[str], near: bool = True) -> TopIndex:
    """An index of documents with a key each; all columns are kept with them. Null and empty fields have no words; an empty table gives an
    index that finds nothing. Keys should differ: rows of one key are documents of their own, in any order. Mistyped words are found only
    by an index with neighbourhoods (`near`)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/postings_{uuid.uuid4().hex}"
    numbered = docs.repartitionByRange(key).sortWithinPartitions(key).select(F.monotonically_increasing_id().alias("doc"), *docs.columns)
    sized = [F.size(words(F.coalesce(c(f), F.lit("")))).alias(f"len{i}") for i, f in enumerate(fields)]
    placed = numbered.select("*", *sized)
    placed.write.parquet(f"{path}/documents")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/documents")
    totals = stored.agg(F.count("*").alias("n"), *[F.avg(f"len{i}").alias(f"a{i}") for i in range(len(fields))]).first()
    # texts are dealt out by block once, so that neither counts nor lists are
    by_block = stored.select("doc", F.shiftright("doc", SHIFT).alias("block"), *[f"len{i}" for i in range(len(fields))], *dict.fromkeys(fields)).repartition("block")
    texts = F.array(*[F.struct(F.lit(i).alias("field"), c(f"len{i}").alias("len"), words(F.coalesce(c(f), F.lit(""))).alias("words")) for i, f in enumerate(fields)])
    terms = by_block.select("doc", "block", F.inline(texts)).select("doc", "block", "field", "len", F.explode("words").alias("term"))
    counted = terms.groupBy("block", "doc", "field", "len", "term").agg(F.count("*").cast("int").alias("tf"))
    # BLOCK documents at most in a list
    rows = counted.groupBy("term", "field", "block").agg(F.collect_list(F.struct("doc", "tf", "len")).alias("entries")).withColumn("bucket", _bucket(c("term"), BUCKETS))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "field", "block")
    most, least = F.array_max("entries.tf").alias("most"), F.array_min("entries.len").alias("least")
    dealt.select("term", "field", "block", F.sort_array("entries").alias("entries"), most, least, F.size("entries").alias("df"), "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = TopIndex(path, key, tuple(fields), totals.n, tuple(float(totals[f"a{i}"] or 1.0) for i in range(len(fields))), stored)
    if near:
        index.read("postings").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/terms")
        begun = rests(index.read("terms").select(_prefix("term").alias("prefix")).distinct(), "prefix").withColumn("bucket", _bucket(c("rest"), RESTS))
        begun.repartition("bucket", F.pmod(F.xxhash64("prefix"), F.lit(SALTS))).write.partitionBy("bucket").parquet(f"{path}/rests")
    return index


def _asked(spark: SparkSession, query: str) -> list[str]:
    return list(dict.fromkeys(spark.range(1).select(words(F.lit(query)).alias("w")).first().w))


def _gain(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(c("score").desc(), "doc").limit(k)


def top(index: TopIndex, query: str, k: int, probe: int = 64) -> Best:
    """The k best documents by BM25 over all fields, ties to the smaller key. A query without known words finds nothing.

    `probe` blocks are scored first; their k-th score is what the other blocks must be able to reach.
    """
    spark = index.documents.sparkSession
    terms = _asked(spark, query)
    average = F.element_at(F.array(*[F.lit(a or 1.0) for a in index.lengths]), c("field") + 1)
    postings = index.read("postings").filter(c("bucket").isin(*dict.fromkeys(r[0] for r in spark.createDataFrame([(x,) for x in terms or [""]], "t string").select(_bucket(c("t"), BUCKETS)).collect())) & c("term").isin(*terms))
    found = postings.groupBy("term", "field").agg(F.sum("df").alias("df")).collect()  # a row for each of the query's words and each field
    weight = F.lit(0.0)
    for r in found:
        weight = F.when((c("term") == r.term) & (c("field") == r.field), F.lit(1 + (index.n - r.df + 0.5) / (r.df + 0.5))).otherwise(weight)
    weight = F.ln(weight)
    if not found:
        return Best(spark.createDataFrame([], "doc long, score double"), 0, 0)
    blocks = written(postings.groupBy("block").agg(F.sum(_gain(weight, c("most"), c("least"), average)).alias("bound")), "block_bounds")

    def scored(some: DataFrame) -> DataFrame:
        each = postings.join(some.select("block"), "block", "left_semi").select("term", "field", F.inline("entries"))
        return each.groupBy("doc").agg(F.round(F.sum(_gain(weight, c("tf"), c("len"), average)), 9).alias("score"))

    first = _best(scored(blocks.orderBy(c("bound").desc(), "block").limit(probe)), k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
    reach = blocks.filter(c("bound") >= (first.least - 1e-8 if first.n == k else 0.0))
    sizes = blocks.agg(F.count("*"), F.count_if(c("bound") >= (first.least - 1e-8 if first.n == k else 0.0))).first()
    return Best(_best(scored(reach), k), *sizes)


def fuzzy_tokens(query: str) -> dict[str, int]:
    """Words of the query that may be mistyped, with the edits that each allows."""
    tokens = dict.fromkeys(x.lower() for x in re.split(r"[^\w]+", query))
    return {x: edit_budget(x) for x in tokens if edit_budget(x) is not None}


def near_terms(index: TopIndex, tokens: dict[str, int]) -> DataFrame:
    """(token, term) of the index's terms within each token's edits: insertions, deletions, substitutions and swaps of neighbours."""
    spark = index.documents.sparkSession
    asked = spark.createDataFrame(list(tokens.items()), "token string, edits int")
    sought = rests(asked.select("token", "edits", _prefix("token").alias("prefix")), "prefix").drop("prefix").distinct().withColumn("bucket", _bucket(c("rest"), RESTS))
    begun = index.read("rests").join(F.broadcast(sought), ["bucket", "rest"]).select("token", "edits", "prefix").distinct()  # a query's rests
    terms = index.read("terms").select("term", _prefix("term").alias("prefix")).join(F.broadcast(begun), "prefix")  # beginnings like those of a query
    apart = F.abs(F.length("term") - F.length("token")) <= c("edits")
    return terms.filter(apart).filter(S.osa_distance(c("term"), c("token")) <= c("edits")).select("token", "term")


def fuzzy(index: TopIndex, query: str, k: int) -> DataFrame:
    """The k best (doc, score) by how many pairs of a token and a field have a term near the token; ties to the smaller key."""
    tokens = fuzzy_tokens(query)
    if not tokens:
        return index.documents.sparkSession.createDataFrame([], "doc long, score double")
    near = written(near_terms(index, tokens).withColumn("bucket", _bucket(c("term"), BUCKETS)), "near_terms")
    hits = index.read("postings").join(near, ["bucket", "term"]).select("token", "field", F.explode("entries.doc").alias("doc")).distinct()
    return _best(hits.groupBy("doc").agg(F.count("*").cast("double").alias("score")), k)


def search(index: TopIndex, query: str, k: int) -> DataFrame:
    """(doc, score, rank, document's columns) of the k best; the fuzzy pass only runs where no document holds a word of the query."""
    strict = written(top(index, query, k).rows, "best")
    best = strict if strict.limit(1).count() else written(fuzzy(index, query, k), "best")
    return index.documents.join(F.broadcast(best), "doc")  # k rows


