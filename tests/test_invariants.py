"""SURVEY section 5 invariants: same answers under 1, 8 and 200 shuffle partitions;
monotone thresholds; every input row kept by the extractor."""

import pytest

from contentlens.plans.registry import all_queries

from .conftest import SMOKE

NAMES = ["t1_top_keywords", "j3_duplicate_pairs_documents", "m1_stratified_split", "t7_sentiment",
         "x16_parse_pages", "t3_corpus_keywords"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_answer_any_partitioning(spark, name):
    fn = all_queries()[name][0]
    results = []
    for parts in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            results.append(_rows(fn(spark, SMOKE)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_threshold_monotone_and_rows_kept(spark):
    from contentlens.operators import embed as EM
    from contentlens.operators import extract as E
    from contentlens.operators import similarity as SIM
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    v = SIM.as_vectors(EM.hashed_tfidf(docs), "doc_id", sparse=("indices", "values"))
    hi = {(r.id_1, r.id_2) for r in SIM.duplicate_pairs(v, 0.9)[0].collect()}
    lo = {(r.id_1, r.id_2) for r in SIM.duplicate_pairs(v, 0.6)[0].collect()}
    assert hi <= lo
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    assert E.parse_pages(pages).count() == pages.count()
