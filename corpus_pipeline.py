"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
`documents`. run() writes each stage's result as Parquet to the shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import fresh_name, stored, table
from skein.llm.mixing import labelled_domains, mixed
from skein.llm.neardup import near_duplicates
from skein.llm.packing import pack
from skein.llm.quality import quality_filter
from skein.llm.secrets import redact, scan_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts too, for they have no words. An empty table gives no rows."""
    return quality_filter(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays, of repeated rows one; a row without an id has its hash as id.

    Different texts under one id are documents of their own. Null and empty texts are near no other and stay, one row of each id. An
    empty table gives no rows.
    """
    id_ = fresh_name(docs.columns, "id")
    key = fresh_name([*docs.columns, id_], "key")
    own = docs.withColumn(id_, F.coalesce(F.col("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))).withColumn(key, F.xxhash64(id_, "text"))
    parts = near_duplicates(own, doc_id=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    first = parts.join(own.select(key, id_), key).groupBy("component_id").agg(F.min(F.struct(id_, key)).alias("least"))
    stay = first.select(F.col(f"least.{key}").alias(key))
    return own.join(stay, key, "left_semi").dropDuplicates([key, id_]).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mask; n_chars follows. All rows stay, null texts as they are; an empty table gives no rows."""
    found = scan_secrets(docs)
    return redact(found, found=found.columns[-1], n_chars="n_chars" if "n_chars" in docs.columns else None).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as their fitted rates say: all of the clean domain, and more, less of the toxic and the low. Null texts
    have the prior as posterior; an empty table gives no rows."""
    return mixed(docs, labelled_domains(table(spark, sf_dir, "labels")), whole="clean")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null text is its end id alone, an empty table gives no rows."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("minhash_dedup", minhash_dedup), ("secret_scans", secret_scans), ("mixing", mixing), ("packing", packing)]
#: SQL can express neither the sketches' verification order nor tokenization; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
