"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names: every operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contentlens.llm import (html_density, licenses, mixing, pieces, quality_embed, rules, sharding, simhash, topk,
                             toxicity)
from contentlens.llm.queries import PIECE_MODEL

LONG = "lorem ipsum dolor sit amet consetetur " * 8000
GOOD = " ".join(f"word{i} has plain sentence{i} here{i} and more." for i in range(40))
BAD = " ".join(f"w{i}### $$$%%% &&&" for i in range(60))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, hash long, size long, fp long, y int, "
          "fingerprint string, kept boolean, label string, words array<string>, `_fp` long, `_quality` int, `_m_words` int")


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), 0.5, 1, 2, 3, 4, "x", True, "l", ["w"], 5, 6, 7)


ROWS = [row(1, None), row(2, ""), row(3, " \t\n"), row(4, "x"), row(5, LONG), row(6, GOOD), row(7, GOOD), row(7, GOOD), row(8, BAD),
        row(None, GOOD, None), row(9, None, None), row(10, "MIT License\r\nidiot\0"), row(11, "𝔘é▁ <b>#</b>", "")]
LABELS = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(1, 12)] + [(None, 1, 1), (6, None, None), (7, 0, 0), (7, 1, 1), (8, 5, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def operators(labels):
    codec = pieces.Codec(pieces.Vocabulary.read(PIECE_MODEL))
    return {
        "op1": lambda d: quality_embed.score_documents(d, quality_embed.fit(d, labels)),
        "op2": simhash.near_duplicates,
        "op3": lambda d: toxicity.score_documents(d, toxicity.fit(d, labels)),
        "op4": licenses.scan_documents,
        "op6": mixing.mix,
        "op7": lambda d: sharding.balanced_shards(d, shards=4),
        "op9": lambda d: rules.quality_rules(d, labels),
        "op10": lambda d: pieces.encode_documents(d, codec),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op9", "op10"])
def test_one_result_a_row_and_none_for_none(docs, none, labels, name):
    run = operators(labels)[name]
    got = run(docs).collect()
    ids = [r[0] for r in ROWS]
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    twins = [r for r in got if r.doc_id == 7]
    if name != "op7":  # every row has its own place in a shard
        assert twins[0][0] == twins[1][0] and all(a == pytest.approx(b) if isinstance(a, float) else a == b for a, b in zip(*twins))
    assert run(none).collect() == []
    of = {r.doc_id: r for r in got}
    if name in ("op1", "op3"):
        assert of[1].score == of[2].score == of[3].score and all(0 <= r.score <= 1 for r in got)
        assert not of[None].held_out
    if name == "op2":
        assert of[1].fingerprint == "0" * 16 and of[1].component_id == of[2].component_id == of[9].component_id == 1
        assert of[None].component_id == of[7].component_id == 6
    if name == "op4":
        assert (of[10].n_base, of[10].labels, of[10].first_word) == (1, "mit", 0) and of[1].n_words == 0 and of[1].first_word is None
        assert of[5].n_words == 48000
    if name == "op6":
        assert of[5].size == 48000 and of[1].size == 0 == of[1].taken and all(r.taken <= 3 * r.size for r in got)
    if name == "op7":
        assert of[1].size == 16 and of[1].text_crc32 == 0 and of[5].text_crc32 == zlib.crc32(LONG.encode())
    if name == "op9":
        assert of[1].base_failed and not of[1].kept and of[6].kept and of[5].n_repeat_words == 48000
    if name == "op10":
        assert all(r.round_trip for r in got) and of[1].ids == [] == of[2].ids


def test_labels_of_one_class_or_none(spark, docs):
    for rows in ([], [(1, 1, 1), (3, 1, 1)]):
        few = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        for fit, score, target in ((quality_embed.fit, quality_embed.score_documents, 0.5), (toxicity.fit, toxicity.score_documents, 0.0)):
            got = {r.score for r in score(docs, fit(docs, few)).collect()}
            assert len(got) == 1 and (got.pop() > 0.99 if rows else True)
        assert rules.quality_rules(docs, few).filter("kept").count() > 0


def test_pages(spark):
    rows = [(1, "u", None, 7), (2, None, "", 7), (None, "v", "<p>a</p>", 7), (3, "u", "<p>" + "x y " * 100000, 7), (3, "u", "<p>b", 7), (3, "u", "<p>b", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_density.extract_pages(df).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.n_chars) for r in got) == [
        (False, 1, 0), (False, 2, 0), (False, 3, 1), (False, 3, 1), (False, 3, 399999), (True, 0, 1)]
    assert html_density.extract_pages(df.limit(0)).collect() == []


def test_vectors(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0], "a"), (50, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a")], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(50, 1, 1, 327680), (50, 2, 1, 327680)]
    assert topk.top_k(df.limit(0)).collect() == []


def test_stages_keep_the_columns_and_take_effect(spark, docs, none, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = empty = None
    for name, stage in corpus_pipeline.STAGES:
        source = spark.read.parquet(str(tmp_path / "documents.parquet")) if now is None else now
        now = stage(spark, source, str(tmp_path))
        empty = stage(spark, none, str(tmp_path))
        assert empty.collect() == []
        if name != "piece codes":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() is not None


def test_one_row_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs).collect()
    ids = sorted(r.doc_id for r in kept)
    assert ids == [1, 4, 5, 6, 8, 10, 11]
    assert len(kept[0]) == len(docs.columns)


def test_pipeline_against_plain_versions(spark):
    """Each stage's rows follow from its operator's own (separately tested) result."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fine = {r.doc_id for r in rules.quality_rules(docs, labels).filter("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == fine
    model = quality_embed.fit(docs, labels)
    good = {r.doc_id for r in quality_embed.score_documents(docs, model).filter("predicted = 1").collect()} & fine
    two = corpus_pipeline.quality_classifier(spark, one, sf)
    assert {r.doc_id for r in two.collect()} == good
    first = {r.component_id for r in simhash.near_duplicates(two).collect()}
    three = corpus_pipeline.near_duplicates(spark, two, sf)
    assert sorted(r.doc_id for r in three.collect()) == sorted(first)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(three).collect()}
    got = [r.doc_id for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(i for i, n in taken.items() for _ in range(n))


def test_mixed_rows_may_have_any_column_names(spark):
    rows = [(i, "some words here " * (i % 4), "abc"[i % 3], 1, "x", 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_source int, _mix_passes string, _MIX_below int")
    got = mixing.repeat_documents(docs)
    plain = mixing.repeat_documents(docs.drop("_mix_source", "_mix_passes", "_MIX_below"))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect())


def test_the_training_sample_has_one_row_an_id(spark):
    from contentlens.llm.common import split_remainder, training_sample
    docs = [(i, f"text {i}") for i in range(40)] + [(5, f"other {i}") for i in range(60)] + [(6, None)] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    known = {r.doc_id for r in labels.filter(split_remainder(F.col("doc_id")) != 2).collect()}
    sample, counts = training_sample(df, labels, "quality", 1000)
    got = sample.collect()
    assert len(got) == len(known) == sum(counts.values())
    again, _ = training_sample(df.repartition(7), labels, "quality", 1000)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
