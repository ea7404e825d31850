import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skein.llm.quality import quality_filter
from skein.llm.secrets import MASK

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "secret_scans", "mixing", "packing"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    planted = " ".join(f"planted{i}" for i in range(60)) + " password=0123456789abcdef"
    docs = docs.unionByName(spark.createDataFrame([(10_000_000, planted, "en", "src0", len(planted))], docs.schema))
    columns, kept = docs.columns, docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SMALL).collect(), docs.schema)
        assert kept.columns == columns
        seen.append({r.doc_id: r for r in kept.collect()})
    quality, dedup, secrets, mixing = seen
    assert set(quality) == {r.doc_id for r in quality_filter(docs).collect()}
    assert set(dedup) < set(quality) and set(secrets) == set(dedup) and set(mixing) <= set(secrets)
    assert any(MASK in r.text for r in secrets.values()) and all(r.n_chars == len(r.text) for r in secrets.values())
    assert all(secrets[i].text == dedup[i].text for i in dedup if MASK not in secrets[i].text)
    pieces = corpus_pipeline.packing(spark, kept, SMALL)
    assert {r.doc_id for r in pieces.collect()} == set(mixing)


def test_rows_without_ids_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, text, "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text[::-1], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.minhash_dedup(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert got.filter(F.col("text") == text).count() == 1 and got.filter(F.col("text") == text[::-1]).count() == 1


def test_clean_documents_stay_where_few_others_are(spark, tmp_path):
    rows = [(i, f"word{i % 9} " * 30 + ("junk | junk" if i % 200 == 0 else "fine")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, int(i % 200 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()}
    assert kept >= {i for i, _ in rows if i % 200}


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    rows = [(5, a), (5, a + " more"), (5, b), (1, b + " more"), (5, "quite another"), (7, None), (7, "")]
    got = [tuple(r) for r in corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()]
    assert sum(r in got for r in rows[:2]) == 1
    assert len(got) == 5 and set(got) - set(rows[:2]) == set(rows[3:])
