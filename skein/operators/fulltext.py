"""A full-text index in shared storage: postings by term, in segments, so that a query reads its terms alone.

An update writes a segment of the documents that changed; a document of a later segment hides its older ones. An Index names its segments
and never changes, so readers see an update when they are given the new Index, and a lost executor loses nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.stems import stem, stemmed
from skein.sources.storage import shared_dir

c = F.col
WORD = r"[\p{L}\p{N}]+"
#: Folders of postings; a query reads one for each of its terms. SALTS bounds what one task writes of a term that all documents hold.
BUCKETS, SALTS = 64, 16


@dataclass(frozen=True)
class Index:
    key: str
    key_type: str
    stems: bool
    segments: tuple[str, ...] = ()


def words(text: Column) -> Column:
    return F.regexp_extract_all(X.ascii_lower(text), F.lit(f"({WORD})"), 1)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(index: Index, docs: DataFrame, text: str | None) -> DataFrame:
    """(key, dl, term, tf) of the documents."""
    # rows are dealt out by key with their texts, so that a document is counted where it is
    by_key = docs.select(c(index.key).alias("key"), (c(text) if text else F.lit(None).cast("string")).alias("text")).repartition("key")
    parted = by_key.select("key", words(c("text")).alias("words")).withColumn("dl", F.coalesce(F.array_size("words"), F.lit(0)).cast("int"))
    terms = parted.select("key", "dl", F.explode("words").alias("term"))
    if index.stems:
        terms = terms.withColumn("term", stemmed(c("term")))
    return terms.groupBy("key", "dl", "term").agg(F.count("*").cast("int").alias("tf"))


def _segment(index: Index, docs: DataFrame, text: str | None) -> Index:
    """`index` and a segment: the documents' words, or, without a text, no more than that they are gone."""
    path = f"{shared_dir(docs.sparkSession)}/fulltext_{uuid.uuid4().hex}"
    split = docs.select(c(index.key).alias("key"), (words(c(text)) if text else F.lit(None).cast("array<string>")).alias("words"))
    sized = split.withColumn("dl", F.when(F.lit(text is not None), F.coalesce(F.array_size("words"), F.lit(0))).cast("int"))
    sized.select("key", "dl").write.parquet(f"{path}/documents")
    counted = _counted(index, docs, text).withColumn("bucket", _bucket(c("term")))
    counted.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS))).write.partitionBy("bucket").parquet(f"{path}/postings")
    return replace(index, segments=(*index.segments, path))


def build(docs: DataFrame, key: str, text: str, stems: bool = False) -> Index:
    """An index of documents with a key each; null and empty texts count as documents without words. An empty table gives an index that finds nothing."""
    return _segment(Index(key, docs.schema[key].dataType.simpleString(), stems), docs, text)


def upsert(index: Index, docs: DataFrame, text: str) -> Index:
    """The index with documents put in: they replace the ones of their keys, whole."""
    return _segment(index, docs, text)


def remove(index: Index, keys: DataFrame) -> Index:
    return _segment(index, keys, None)


def _live(spark: SparkSession, index: Index, part: str, schema: str, keep: Column) -> DataFrame:
    """Rows of all segments that no later segment hides."""
    read = lambda path, p, s: spark.read.schema(s).parquet(f"{path}/{p}")
    keys = f"key {index.key_type}, dl int"
    out, later = None, None
    for path in reversed(index.segments):
        rows = read(path, part, schema).filter(keep)
        rows = rows if later is None else rows.join(later, "key", "left_anti")
        out = rows if out is None else out.unionByName(rows)
        own = read(path, "documents", keys).select("key")
        later = own if later is None else later.unionByName(own)
    return out


def compacted(spark: SparkSession, index: Index) -> Index:
    """One segment of what is live."""
    path = f"{shared_dir(spark)}/fulltext_{uuid.uuid4().hex}"
    _live(spark, index, "documents", f"key {index.key_type}, dl int", c("dl").isNotNull()).write.parquet(f"{path}/documents")
    rows = _live(spark, index, "postings", f"key {index.key_type}, dl int, term string, tf int, bucket int", F.lit(True))
    rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS))).write.partitionBy("bucket").parquet(f"{path}/postings")
    return replace(index, segments=(path,))


def search(spark: SparkSession, index: Index, query: str, every: bool = False, floored: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold a term of the query, or all of them if `every`, by BM25.

    The weight of a term is never negative: ln(1 + odds), or, if `floored`, ln(odds) of 1e-6 at least. A query without words finds nothing.
    """
    terms = list(dict.fromkeys(stem(x) if index.stems else x for x in _asked(spark, query)))
    schema = f"key {index.key_type}, dl int, term string, tf int, bucket int"
    if not terms:
        return spark.createDataFrame([], f"{index.key} {index.key_type}, score double")
    hits = _live(spark, index, "postings", schema, c("bucket").isin(*[_bucket(F.lit(x)) for x in terms]) & c("term").isin(*terms))
    total = _live(spark, index, "documents", f"key {index.key_type}, dl int", c("dl").isNotNull()).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    found = {r.term: r["count"] for r in hits.groupBy("term").count().collect()}  # a row for each term of the query
    n, avgdl = total.n, total.avgdl or 1.0
    odds = lambda df: F.lit((n - df + 0.5) / (df + 0.5))
    weight = F.lit(0.0)
    for x, df in found.items():
        idf = F.greatest(F.ln(odds(df)), F.lit(1e-6)) if floored else F.ln(1 + odds(df))
        weight = F.when(c("term") == x, idf).otherwise(weight)
    one = weight * c("tf") * (k1 + 1) / (c("tf") + k1 * (1 - b + b * c("dl") / F.lit(avgdl)))
    scored = hits.groupBy("key").agg(F.sum(one).alias("score"), F.count("*").alias("held"))
    return scored.filter(c("held") >= (len(terms) if every else 1)).select(c("key").alias(index.key), "score")


def _asked(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(words(F.lit(query)).alias("w")).first().w  # the query's own words, split as the texts are


def search_turns(spark: SparkSession, index: Index, turns: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k turns that hold all words of the query, by their stems, with their scores; ties to the smaller key."""
    best = search(spark, index, query, every=True, floored=True).withColumn("score", F.round("score", 9)).orderBy(c("score").desc(), index.key).limit(k)
    return turns.join(F.broadcast(best), index.key)  # k rows
