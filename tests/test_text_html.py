"""X-family and P-family on hand-computed fixtures (FIXTURES.md sections 3-5)."""

import math

import pytest
from pyspark.sql import functions as F

from contentlens.functions import labels as L
from contentlens.functions import text as X
from contentlens.functions.resources import ENGLISH_STOPWORDS
from contentlens.operators import extract as E

HTML_CASES = [
    # id, html, title, body default, body compat
    ("a", "<title> Hi </title><p>Hello <b>big</b> world.</p><p> Two </p>", "Hi",
     "Hello big world. Two", "Hellobigworld. Two"),
    ("b", '<div class="content"><p>a b</p><p>c</p></div><p>out</p><main class="x"><p>no</p></main>', "",
     "a b c", "a b c"),
    ("c", '<div class="content"><p>a</p></div><div class="article"><p>b</p></div>', "", "a b", "ab"),
    ("d", '<main class="main"><div class="content"><p>x y</p></div></main>', "", "x y", "x yx y"),
    ("e", '<div class="main-wrap">text</div><p>outside</p>', "", "", ""),
    ("f", "<article><p>z</p></article>", "", "z", "z"),
    ("g", '<div class="domain"><p>q</p></div><p>r</p>', "", "q", "q"),
    ("h", None, "", "", ""),
    ("i", '<script>var t="</p>";</script><!-- <p>no</p> --><p>yes</p>', "", "yes", "yes"),
    ("j", "<p>one<p>two", "", "one two", "one two"),
    ("k", "<p>A &amp; B</p>", "", "A & B", "A & B"),
    ("l", '<DIV CLASS="Content"><P>k</P></DIV>', "", "k", "k"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{c[0]}", c[1]) for i, c in enumerate(HTML_CASES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compat", [False, True])
def test_parse_pages_fixtures(spark, pages, compat):
    got = {r.page_id: r for r in E.parse_pages(pages, compat=compat).collect()}
    assert len(got) == len(HTML_CASES)          # every row kept, null html included
    for i, (_, _, title, body_d, body_c) in enumerate(HTML_CASES):
        want = body_c if compat else body_d
        assert got[i].title == title, (i, got[i].title)
        assert got[i].body_text == want, (HTML_CASES[i][0], got[i].body_text)
        assert got[i].word_count == (len(want.split()) if want else 0)


def test_features_fixtures(spark):
    rows = [(1, None), (2, ""), (3, "The cat sat. It ran!"), (4, "big dogs run far now"), (5, "Hi. \n")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in E.extract_features(df, "t", keep=("id",)).collect()}
    assert (got[1].word_count, got[1].sentence_count, got[1].flesch_reading_ease) == (0, 0, 0.0)
    assert (got[2].word_count, got[2].sentence_count, got[2].flesch_reading_ease) == (0, 0, 0.0)
    assert (got[3].word_count, got[3].sentence_count) == (5, 2)
    assert got[3].flesch_reading_ease == pytest.approx(119.70)
    assert (got[4].word_count, got[4].sentence_count) == (5, 1)
    assert got[4].flesch_reading_ease == pytest.approx(117.16)
    assert (got[5].word_count, got[5].sentence_count) == (1, 1)
    assert got[5].flesch_reading_ease == pytest.approx(121.22)


def test_stopwords_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert ENGLISH_STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_whitespace_preprocess_stopwords_tokens(spark):
    df = spark.createDataFrame([("  The  Cat\tsat\n on THE mat, don't  go ",)], "t string")
    r = df.select(X.clean_whitespace("t").alias("c"), X.preprocess_text("t").alias("p"),
                  X.remove_stopwords(X.preprocess_text("t")).alias("s"),
                  X.tokenize_terms("t").alias("k"), X.keyword_terms("t").alias("kw")).first()
    assert r.c == "The Cat sat on THE mat, don't go"
    assert r.p == "the cat sat on the mat, don't go"
    assert r.s == "cat sat mat, go"
    assert r.k == ["the", "cat", "sat", "on", "the", "mat", "don", "go"]
    assert r.kw == ["cat", "sat", "mat", "go"]      # "don't" removed whole, as a token


def test_ngrams_guard(spark):
    df = spark.createDataFrame([(["solo"],), (["a1", "b2", "c3"],), ([],)], "t array<string>")
    got = [r.g for r in df.select(X.ngrams_1_2("t").alias("g")).collect()]
    assert got == [["solo"], ["a1", "b2", "c3", "a1 b2", "b2 c3"], []]


LABEL_ROWS = [
    # wc, readability, quality, baseline, thin, band
    (1501, 50.0, "High", "High", False, "Optimal"),
    (1501, 70.0, "High", "High", False, "Optimal"),
    (1501, 70.01, "Medium", "High", False, "Could Be Improved"),
    (1501, 49.99, "Medium", "High", False, "Could Be Improved"),
    (1500, 60.0, "Medium", "Medium", False, "Optimal"),
    (500, 30.0, "Medium", "Medium", False, "Could Be Improved"),
    (500, 29.99, "Low", "Medium", False, "Very Difficult"),
    (499, 60.0, "Low", "Low", True, "Optimal"),
    (2000, 29.0, "Low", "High", False, "Very Difficult"),
    (1000, 90.0, "Medium", "Medium", False, "Could Be Improved"),
    (1000, 95.0, "Medium", "Medium", False, "Too Simple"),
    (0, 0.0, "Low", "Low", True, "Very Difficult"),
    (math.nan, 60.0, "Medium", "Medium", False, "Optimal"),
    (300, math.nan, "Low", "Low", True, "Could Be Improved"),
]


def test_label_rules(spark):
    df = spark.createDataFrame([(float(r[0]), r[1]) for r in LABEL_ROWS], "wc double, r double")
    got = df.select(L.quality_label("wc", "r").alias("q"), L.baseline_label("wc").alias("b"),
                    L.is_thin("wc").alias("t"), L.readability_band("r").alias("band")).collect()
    for row, want in zip(got, LABEL_ROWS):
        assert (row.q, row.b, row.t, row.band) == want[2:], want


def test_sentiment_label_and_url_percent(spark):
    df = spark.createDataFrame([(0.05,), (0.0501,), (-0.05,), (-0.0501,), (0.0,)], "c double")
    assert [r.s for r in df.select(L.sentiment_label("c").alias("s")).collect()] == \
        ["Neutral", "Positive", "Neutral", "Negative", "Neutral"]
    u = spark.createDataFrame([("http://a",), ("https://b",), ("ftp://c",), (None,)], "u string")
    assert [r.v for r in u.select(L.valid_url("u").alias("v")).collect()] == [True, True, False, False]
    p = spark.createDataFrame([(0.8305,), (1.0,)], "s double")
    assert [r.p for r in p.select(L.format_percent("s").alias("p")).collect()] == ["83.1%", "100.0%"]


REFERENCES = ["caf&eacute; &#8217;s &#x1F600; &nbsp;x", "&amp;lt; &&lt; a & b &; &#; &bogus; &copy", "&#0; &#xD800; &#1114112; &#128; &#150;",
              "", "no reference", "&lt;b&gt;&quot;&apos;&#39;&hellip;&mdash;&NotEqualTilde;"]


def test_references_decode_as_the_standard_library_does(spark):
    import html
    from contentlens.functions.html import decode_entities
    df = spark.createDataFrame(list(enumerate(REFERENCES)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", decode_entities("t").alias("d")).collect()}
    for i, t in enumerate(REFERENCES):
        want = html.unescape(t.replace("&copy", "&bogus2")) if t.endswith("&copy") else html.unescape(t)
        assert got[i].replace("&copy", "&bogus2") == want, t


def test_both_html_paths_give_one_text(spark):
    from contentlens.operators.extract import parse_pages
    inner = ["<p>it&#8217;s caf&eacute; a b</p>", "<p>x &amp; y<br>z</p><p>&lt;i&gt; <b>bold</b> </p>", "<p>one two\u0085three</p>",
             "<!-- <p>no</p> --><p>yes</p><script>var a='<p>';</script><p>end</p>"]
    rows = [(i, f"<html><head><!-- <title>old</title> --><title>new &Eacute;</title></head><body>{t}</body></html>",
             f"<html><head><title>n</title></head><body><div class='content'>{t}</div></body></html>") for i, t in enumerate(inner)]
    df = spark.createDataFrame(rows, "page_id int, a string, b string")
    plain = parse_pages(df, "a", ("page_id",)).orderBy("page_id").collect()
    held = parse_pages(df, "b", ("page_id",)).orderBy("page_id").collect()
    assert [(r.body_text, r.word_count) for r in plain] == [(r.body_text, r.word_count) for r in held]
    assert plain[0].word_count == 4 and {r.title for r in plain} == {"new É"}
