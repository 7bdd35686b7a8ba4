"""Sentiment, entities, sources, streaming and the driver contract."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from contentlens.operators import entities as ENT
from contentlens.operators import sentiment as SEN

from .conftest import SMOKE


def test_sentiment_rules(spark):
    docs = spark.createDataFrame([
        (1, "This is a great and wonderful product."),
        (2, "This is not a great product at all."),
        (3, "This is a very bad and terrible product."),
        (4, "short"),
        (5, "Plain words without any feeling here."),
    ], "doc_id long, text string")
    s = {r.doc_id: r for r in SEN.sentiment_scores(docs).collect()}
    assert s[1].sentiment == "Positive" and s[1].compound > 0.5
    assert s[2].compound < 0 and s[2].sentiment == "Negative"        # negation flips
    assert s[3].sentiment == "Negative" and s[3].compound < -0.5
    assert (s[4].neg, s[4].neu, s[4].pos, s[4].compound) == (0.0, 0.0, 0.0, 0.0)
    assert (s[5].neu, s[5].compound, s[5].sentiment) == (1.0, 0.0, "Neutral")
    assert s[1].pos + s[1].neu + s[1].neg == pytest.approx(1.0, abs=0.002)


def test_booster_increases_intensity(spark):
    docs = spark.createDataFrame([(1, "The service was good overall."), (2, "The service was very good overall.")],
                                 "doc_id long, text string")
    s = {r.doc_id: r.compound for r in SEN.sentiment_scores(docs).collect()}
    assert s[2] > s[1] > 0


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Yesterday John Smith flew from London to New York with Google staff."),
                                  (2, "tiny")], "doc_id long, text string")
    e = ENT.extract_entities(docs).orderBy("idx").collect()
    got = [(r.entity, r.type) for r in e]
    assert ("John Smith", "PERSON") in got and ("London", "GPE") in got
    assert ("New York", "GPE") in got and ("Google", "ORGANIZATION") in got
    assert ("Yesterday John Smith", "UNKNOWN") not in got
    assert all(r.doc_id == 1 for r in e)
    top = ENT.top_entity_types(ENT.extract_entities(docs), 5).collect()
    assert top[0].n >= 1


TRICKY = ['<p>x, "y"\nz</p>', "  padded, ", 'a ""quoted"" \\ back', "line\none,\n\ntwo", "plain"]


def test_csv_round_trip_of_pages_and_content(spark):
    from contentlens.sources.readers import read_content, read_pages, write_table
    d = tempfile.mkdtemp(prefix="cl-io-")
    rows = [(f"http://{i}", t) for i, t in enumerate(TRICKY)]
    write_table(spark.createDataFrame(rows, "url string, html_content string"), f"{d}/pages", fmt="csv")
    assert {(r.url, r.html_content) for r in read_pages(spark, f"{d}/pages").collect()} == set(rows)
    swapped = spark.createDataFrame([(t, u) for u, t in rows], "html_content string, url string")
    write_table(swapped, f"{d}/swapped", fmt="csv")
    assert {(r.url, r.html_content) for r in read_pages(spark, f"{d}/swapped").collect()} == set(rows)
    write_table(spark.createDataFrame([("u", "h")], "foo string, bar string"), f"{d}/other", fmt="csv")
    for wrong in ("other", "content"):
        if wrong == "content":
            write_table(spark.createDataFrame([(t,) for t in TRICKY], "body_text string"), f"{d}/content", fmt="csv")
        with pytest.raises(ValueError):
            read_pages(spark, f"{d}/{wrong}")
    got = read_content(spark, f"{d}/content", fmt="csv")
    assert sorted(r.body_text for r in got.collect()) == sorted(TRICKY)
    with pytest.raises(ValueError):
        read_content(spark, f"{d}/pages", fmt="csv")


def test_features_survive_csv(spark):
    from contentlens.plans.jobs import build_features
    from contentlens.sources.readers import read_features, write_table
    d = tempfile.mkdtemp(prefix="cl-feat-")
    feats = build_features(spark.createDataFrame(
        [(1, "alpha beta gamma, alpha!"), (2, ""), (3, "delta \"epsilon\" zeta eta")], "doc_id long, text string"))
    write_table(feats, f"{d}/csv", fmt="csv")
    write_table(feats, f"{d}/parquet")
    a = {r.url: r for r in read_features(spark, f"{d}/csv", fmt="csv").collect()}
    b = {r.url: r for r in read_features(spark, f"{d}/parquet").collect()}
    assert set(a) == set(b) == {"doc:1", "doc:2", "doc:3"}
    for u in a:
        assert a[u].embedding == pytest.approx(b[u].embedding) and len(a[u].embedding) == 384
        assert (a[u].word_count, a[u].sentence_count, a[u].flesch_reading_ease) == (
            b[u].word_count, b[u].sentence_count, b[u].flesch_reading_ease)
    write_table(feats.drop("word_count"), f"{d}/short", fmt="csv")
    with pytest.raises(ValueError):
        read_features(spark, f"{d}/short", fmt="csv")


def test_end_to_end_from_csv(spark):
    from contentlens.plans.jobs import run_end_to_end
    from contentlens.sources.readers import read_pages, write_table
    d = tempfile.mkdtemp(prefix="cl-e1csv-")
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    write_table(pages.select("url", pages.html.alias("html_content")), f"{d}/pages", fmt="csv")
    out = run_end_to_end(read_pages(spark, f"{d}/pages"), num_trees=5, out_dir=f"{d}/out", id_col="row_id", html_col="html_content")
    assert out["scored"].count() == pages.count()
    groups = {r.rep: r.copies for r in out["copy_groups"].collect()}
    members = out["copy_members"].collect()
    assert {g: sum(m.rep == g for m in members) for g in groups} == groups
    assert {r.feature for r in out["importances"].collect()} and out["importances"].agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert out["confusion"].agg(F.sum("n")).first()[0] == out["scored"].filter("split = 'test'").count()
    assert not spark._jsc.sc().getPersistentRDDs().size() or not any(df.is_cached for df in out.values() if hasattr(df, "is_cached"))


def test_a_million_capitalised_words(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("Word"), 1_000_000), " ").alias("text"))
    got = ENT.extract_entities(df).select(F.length("entity")).collect()
    assert [r[0] for r in got] == [5 * 1_000_000 - 1]


def test_a_replayed_epoch_changes_nothing(spark):
    from contentlens.streaming.analyze import fit_corpus, write_epoch
    d = tempfile.mkdtemp(prefix="cl-epoch-")
    corpus = spark.read.parquet(f"{SMOKE}/documents.parquet")
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").limit(8)
    fitted = fit_corpus(corpus, f"{d}/corpus")
    before = spark._jsc.sc().getPersistentRDDs().size()
    for epoch in (0, 1, 1):
        write_epoch(pages, epoch, f"{d}/sink", corpus, fitted=fitted)
    assert spark.read.parquet(f"{d}/sink").groupBy("epoch").count().select("count").distinct().count() == 1
    assert spark.read.parquet(f"{d}/sink").count() == 2 * spark.read.parquet(f"{d}/sink/epoch=0").count()
    assert spark._jsc.sc().getPersistentRDDs().size() == before


def test_load_model_raises_other_faults(spark):
    from contentlens.sources.readers import load_model
    d = tempfile.mkdtemp(prefix="cl-bad-")
    assert load_model(f"{d}/none") is None
    with pytest.raises(Exception):
        load_model(d)


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"url", "title", "word_count", "quality_label"} <= set(df.columns)
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60


def test_stream_job(spark):
    from contentlens.streaming.analyze import analyze_stream
    d = tempfile.mkdtemp(prefix="cl-stream-")
    corpus = spark.read.parquet(f"{SMOKE}/documents.parquet")
    q = analyze_stream(spark, f"{SMOKE}/pages*.parquet", corpus, f"{d}/out", checkpoint=f"{d}/ck")
    q.awaitTermination()
    out = spark.read.parquet(f"{d}/out")
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").count()
    assert 0 < out.count() <= pages
    assert "similar_to" in out.columns and os.path.isdir(f"{d}/ck")


def test_model_save_load(spark):
    from pyspark.sql import functions as F

    from contentlens.operators import model as M
    from contentlens.sources.readers import load_model, save_model
    d = tempfile.mkdtemp(prefix="cl-model-")
    assert load_model(f"{d}/missing") is None
    rows = [(i, 100 + i * 20, 5 + i % 3, 40.0 + i % 30, ["Low", "Medium", "High"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, word_count long, sentence_count long, "
                                     "flesch_reading_ease double, quality_label string")
    model = M.train_quality_model(df, num_trees=5, max_depth=3)
    save_model(model, f"{d}/m")
    again = load_model(f"{d}/m")
    a = M.predict_quality(model, df).orderBy("id").select("predicted_quality").collect()
    b = M.predict_quality(again, df).orderBy("id").select("predicted_quality").collect()
    assert a == b
    del F


def test_end_to_end_writes_stages(spark):
    from contentlens.plans.jobs import run_end_to_end
    d = tempfile.mkdtemp(prefix="cl-e1-")
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    out = run_end_to_end(pages, num_trees=20, out_dir=d)
    for name in ("extracted", "features", "pairs", "copy_groups", "copy_members", "summary", "scored", "metrics", "confusion", "report", "importances"):
        assert os.path.isdir(f"{d}/{name}"), name
    assert os.path.isdir(f"{d}/model")
    # later stages read the written feature table, and every page is scored
    assert spark.read.parquet(f"{d}/scored").count() == pages.count()
    assert out["features"].count() == pages.count()


def test_gazetteer_matches_at_any_place_and_case(spark):
    gaz = spark.createDataFrame([("New York", "GPE"), ("new york times", "ORG"), ("York", "GPE"), ("times square garden", "PLACE"), ("IBM", "ORG"),
                                 ("ibm", "ABC"), ("...", "NONE"), ("a-b", "PAIR")], "phrase string, type string")
    texts = [(1, "Old NEW york Times Square Garden, and ibm's york"), (2, "in new   york. A b"), (3, None), (4, ""), (5, "nothing"), (6, "ibm " * 50),
             (2, "York")]
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id int, text string, start int, phrase string")
    got = {tuple(r) for r in ENT.gazetteer_matches(docs.filter("text <> 'York' OR text IS NULL"), gaz).collect()}
    assert {r for r in got if r[0] < 6} == {
        (1, 1, 3, "new york times", "ORG"), (1, 7, 1, "ibm", "ABC"), (1, 9, 1, "york", "GPE"), (2, 1, 2, "new york", "GPE"), (2, 3, 2, "a b", "PAIR")}
    assert sum(r[0] == 6 for r in got) == 50
    assert ENT.gazetteer_matches(docs.limit(0), gaz).collect() == [] == ENT.gazetteer_matches(docs, gaz.limit(0)).collect()


def test_entities_with_gazetteer_keep_unknown_runs(spark):
    gaz = spark.createDataFrame([("acme works", "ORG")], "phrase string, type string")
    docs = spark.createDataFrame([(1, "Big Acme Works met Carol Jones. Then acme works and Carol Jones."), (2, "Acme Rivals"), (3, None)], "doc_id int, text string")
    got = {tuple(r) for r in ENT.entities_with_gazetteer(docs, gaz).collect()}
    assert got == {(1, "acme works", "ORG", 2), (1, "Carol Jones", "UNKNOWN", 2), (2, "Acme Rivals", "UNKNOWN", 1)}
