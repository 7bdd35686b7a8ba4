"""X11 counted by arrays: the same numbers as the regular expressions, in a plan without them."""

from pyspark.sql import functions as F

from contentlens.functions import counts as C
from contentlens.functions import text as X
from contentlens.operators import extract as E
from contentlens.operators import model as M

TEXTS = ["", None, " ", ".", "...", "One two. Three!  ?! Four", "Ä été Ünï. ßtr öÖ", "a b c\x0bd\x1ce\x85f᠎g​h",
         "brr tsk psst", "İa İstanbul. AİA", "x" * 5000 + ". Y", "日本語。テキスト! 二", "😀 hi. 😀😀?", " . a .b. c . ", "end", "a.b c.d\n\n. E",
         "Kelvin Ǻ ée", "queue rhythm why", "?", "no end here　", " . a !"]


def test_counts_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r["n"]) for r in docs.select("doc_id", C.text_counts("text").alias("n")).collect()}
    want = docs.select("doc_id", X.word_count("text"), X.sentence_count("text"), X.syllable_count("text")).collect()
    assert got == {r[0]: tuple(r[1:]) for r in want}


def test_counts_do_not_depend_on_the_parts(monkeypatch):
    import pyarrow as pa
    texts = pa.array([t.lower() if t else "" for t in TEXTS])
    whole = C._count(texts)
    one = [C._count(texts.slice(i, 1)) for i in range(len(texts))]
    assert [list(x) for x in whole] == [[int(o[k][0]) for o in one] for k in range(3)]


def test_white_space_is_that_of_the_patterns(spark):
    every = spark.range(0x110000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = {r["id"] for r in every.filter(F.col("c").rlike(f"^[{X.SPACES}]$")).collect()}
    assert found == set(C.SPACES)


def test_features_scan_a_text_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = E.extract_features(docs, "text", keep=("doc_id",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 1
    want = docs.select("doc_id", X.text_features("text").alias("f")).select("doc_id", "f.*")
    assert sorted(out.collect()) == sorted(want.collect())


def test_split_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'Low', 'High') as lab").mapInArrow(run, "id long, lab string")
    split = M.stratified_split(df, "lab", "id")
    assert seen.value == 300  # stored before any of the jobs that read it
    assert split.filter("split = 'test'").count() == 90 and seen.value == 300
