"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import quality_columns

    return quality_columns(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.secrets import scan_secrets, span_columns

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[c.alias(n) for n, c in span_columns(F.col("findings")).items()])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.topk import quantized, top_k

    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import TARGETS, labelled_domains, mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), labelled_domains(table(spark, sf_dir, "labels")), keep=["doc_id", "source"])
    return out.select("doc_id", "source", "tokens", *[F.element_at("posteriors", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate", "copies", "miss")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.tokenfile import token_output

    return token_output(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_sharding, op3_html_extraction, op4_topk_search, op5_mixing, op6_quality_rules, op7_language_id, op8_secret_scans, op9_minhash_dedup, op10_token_output, op11_filter_audit, op12_decontamination, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {}


def _oracles() -> None:
    from skein.llm import audit, decontam, neardup, topk, trie

    ORACLE_SQL["op4_topk_search"] = topk.ORACLE
    ORACLE_SQL["op9_minhash_dedup"] = neardup.ORACLE
    ORACLE_SQL["op11_filter_audit"] = audit.ORACLE
    ORACLE_SQL["op12_decontamination"] = decontam.ORACLE
    ORACLE_SQL["op13_prefix_trie"] = trie.ORACLE


_oracles()
