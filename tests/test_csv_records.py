"""S1 by byte ranges: the same rows as the reader of whole files, many tasks a file, stable ids."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from contentlens.sources.readers import read_pages, write_table

PIECES = ['<p>one</p>', '\n', '\n\n', '"', '""', ',', 'é', ' ', '\r\n', "it's", '<a href="x,y">z</a>', 'long ' * 40]


def _pages(seed, n):
    rng = random.Random(seed)
    return [(f"http://site/{i}", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))) for i in range(n)]


def _one_file(folder):
    return [os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".csv")]


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")
    yield set_size
    for n, v in old.items():
        spark.conf.set(n, v)


def _rows(df):
    return [(r.url, r.html_content) for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_rows_as_whole_files_and_the_same_ids_at_any_range_size(spark, small_ranges, seed):
    d = tempfile.mkdtemp(prefix="cl-csvrec-")
    rows = _pages(seed, 300)
    write_table(spark.createDataFrame(rows, "url string, html_content string").coalesce(1), f"{d}/p", fmt="csv")
    assert len(_one_file(f"{d}/p")) == 1
    want = [(u, h) for u, h in _rows(read_pages(spark, f"{d}/p"))]
    ids = None
    for size in ("97", "1000", "100000"):
        small_ranges(size)
        got = read_pages(spark, f"{d}/p", split_records=True).cache()
        assert _rows(got) == want
        now = {r.url: r.row_id for r in got.collect()}
        assert now == {f"http://site/{i}": i for i in range(300)}
        assert ids is None or now == ids
        ids = now
        got.unpersist()
    assert [h or "" for _, h in want] == [h for _, h in rows]


def test_many_tasks_read_one_file(spark, small_ranges):
    d = tempfile.mkdtemp(prefix="cl-csvrec-")
    write_table(spark.createDataFrame(_pages(3, 400), "url string, html_content string").coalesce(1), f"{d}/p", fmt="csv")
    small_ranges("4000")
    assert spark.read.option("lineSep", "\n").text(f"{d}/p").rdd.getNumPartitions() > 5
    plan = read_pages(spark, f"{d}/p", split_records=True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_several_files_headers_blank_lines_and_open_ends(spark, small_ranges):
    d = tempfile.mkdtemp(prefix="cl-csvrec-")
    with open(f"{d}/a.csv", "w", newline="") as f:
        f.write('url,html_content,more\n\nu1,"x\n\ny",1\n\n\nu2,plain,\n')
    with open(f"{d}/b.csv", "w", newline="") as f:
        f.write('url,html_content,more\r\nu3,"say ""hi""\r\nthere",3\r\n\r\nu4,"",4')
    with open(f"{d}/c.csv", "w", newline="") as f:
        f.write("url,html_content,more\n")
    for size in ("7", "1000000"):
        small_ranges(size)
        got = read_pages(spark, d, split_records=True).orderBy("row_id").collect()
        assert [(r.row_id, r.url) for r in got] == [(0, "u1"), (1, "u2"), (2, "u3"), (3, "u4")]
        assert got[0].html_content == "x\n\ny" and got[1].html_content == "plain"
        assert got[2].html_content.replace("\r", "") == 'say "hi"\nthere'
        want = {(r.url, r.html_content) for r in read_pages(spark, d).collect()}
        assert {(r.url, r.html_content) for r in got if r.url != "u3"} == {w for w in want if w[0] != "u3"}


def test_a_record_over_many_ranges(spark, small_ranges):
    d = tempfile.mkdtemp(prefix="cl-csvrec-")
    body = "\n".join(f"line {i} of the page" for i in range(3000))
    rows = [("u0", "short"), ("u1", body), ("u2", "end")]
    write_table(spark.createDataFrame(rows, "url string, html_content string").coalesce(1), f"{d}/p", fmt="csv")
    small_ranges("5000")
    assert _rows(read_pages(spark, f"{d}/p", split_records=True)) == rows


def test_a_missing_column_and_an_empty_table(spark):
    d = tempfile.mkdtemp(prefix="cl-csvrec-")
    write_table(spark.createDataFrame([("u", "h")], "foo string, bar string"), f"{d}/other", fmt="csv")
    with pytest.raises(ValueError):
        read_pages(spark, f"{d}/other", split_records=True)
    with open(f"{d}/none.csv", "w") as f:
        f.write("url,html_content\n")
    assert read_pages(spark, f"{d}/none.csv", split_records=True).select(F.col("url")).count() == 0
