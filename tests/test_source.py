"""The data source of files: what it lists, pushes, plans, writes and streams."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringContains

from reelbase.operators.walk import elements
from reelbase.plans import fixtures as X
from reelbase.sources import media_files as M
from reelbase.sources.files import read_elements
from reelbase.sources.registry import route


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("source"))
    p = X.table(spark, sf, "part").limit(20)
    M.media_source(spark)
    X.gif(p).unionByName(X.wav(p)).write.format(M.NAME).mode("append").save(root)
    return root


def rows(df, *names):
    return sorted(map(repr, df.select(*names).collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_files_are_those_that_were_given(spark, sf, folder):
    p = X.table(spark, sf, "part").limit(20)
    given = {r.path: bytes(r.content) for r in X.gif(p).unionByName(X.wav(p)).collect()}
    for path, content in given.items():
        with open(os.path.join(folder, path), "rb") as f:
            assert f.read() == content
    assert not [x for x in os.listdir(folder) if x.startswith("_")]
    assert M.media_files(spark, folder).count() == len(given) == 40


def test_same_elements_as_by_spark_s_own_reader(spark, folder):
    mine = elements(route(M.media_files(spark, folder)))
    names = [c for c in mine.columns if c != "at"]  # the hash's has the bytes read, which differ
    assert rows(mine, *names) == rows(read_elements(spark, folder), *names)


def test_filters_reach_the_listing(spark, folder):
    files = M.media_files(spark, folder, head=0).where("suffix = 'wav' AND length BETWEEN 60 AND 150 AND path LIKE '%1.wav'")
    told = sorted((x, os.path.getsize(os.path.join(r, x))) for r, _, xs in os.walk(folder) for x in xs if x.endswith("1.wav") and 60 <= os.path.getsize(os.path.join(r, x)) <= 150)
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in files.collect()) == told
    assert not re.search(r"\bFilter\b", plan_of(files)), plan_of(files)  # nothing is left for Spark to filter
    odd = M.media_files(spark, folder, head=0).where("length % 2 = 1 AND suffix = 'gif'")
    assert re.search(r"\bFilter\b", plan_of(odd)) and odd.where("suffix <> 'gif' OR length % 2 <> 1").count() == 0


def test_fits():
    file = ("file:/d/A.GIF", 100, 10**18)
    assert M.fits(EqualTo(("suffix",), "gif"), file) and M.fits(Not(In(("suffix",), ("wav", "mp3"))), file) and not M.fits(GreaterThan(("length",), 100), file)
    assert M.fits(StringContains(("path",), "A.G"), file) and M.fits(EqualTo(("head",), b""), file) is None and M.fits(EqualTo(("length",), None), file) is None
    assert [M.suffix_of(x) for x in ("a/b.c/d", "a/.hidden", "x.tar.GZ", "x.")] == ["", "", "gz", ""]


def test_partitions_are_planned_by_the_bytes_to_be_read():
    big = [(f"/f/{k:04}.mkv", 10**9, 0) for k in range(1000)]  # of each, an index is read, not a gigabyte
    assert len(M.plan(big)) == -(-1000 * M.NEEDS["mkv"] // M.TASK)
    small = [(f"/f/{k:05}.gif", 100, 0) for k in range(10_000)]
    assert len(M.plan(small)) == 5 and sum(len(p.files) for p in M.plan(small)) == 10_000
    assert [p.files for p in M.plan([])] == [[]]


def test_sql_and_unreadable_and_hidden_files(spark, tmp_path):
    (tmp_path / "a.gif").write_bytes(b"GIF89a\x05\0\x06\0")
    (tmp_path / "gone.gif").symlink_to(tmp_path / "nowhere")
    (tmp_path / "_half.gif").write_bytes(b"GIF")
    (tmp_path / "empty.gif").write_bytes(b"")
    M.media_source(spark).sql(f"CREATE OR REPLACE TEMPORARY VIEW some_files USING {M.NAME} OPTIONS (path '{tmp_path}')")
    found = {r.path.rsplit("/", 1)[1]: r.head for r in spark.sql("SELECT path, head FROM some_files WHERE suffix = 'gif'").collect()}
    assert set(found) - {"gone.gif"} == {"a.gif", "empty.gif"} and found["a.gif"][:3] == b"GIF" and found["empty.gif"] == b""
    assert spark.sql("SELECT * FROM some_files WHERE suffix = 'mp3'").count() == 0


def test_writing_refuses_names_outside_of_the_folder_and_overwriting(spark, tmp_path):
    M.media_source(spark)
    for name in ("../x", "/etc/x", "a//b", ""):
        with pytest.raises(Exception, match="not a file below"):
            spark.range(1).select(F.lit(name).alias("path"), F.lit(bytearray(b"x")).alias("content")).write.format(M.NAME).mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="only appends"):
        spark.range(1).select(F.lit("a").alias("path"), F.lit(bytearray(b"x")).alias("content")).write.format(M.NAME).mode("overwrite").save(str(tmp_path / "out"))


def test_a_stream_takes_each_file_once(spark, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / x) for x in ("arriving", "out", "checkpoint"))
    os.mkdir(arriving)

    def put(name, age):
        path = os.path.join(arriving, name)
        with open(path, "wb") as f:
            f.write(b"GIF89a\x05\0\x06\0")
        os.utime(path, (time.time() - age,) * 2)

    def run():
        files = M.media_source(spark).readStream.format(M.NAME).load(arriving)
        elements(route(files)).where("place = ''").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    put("a.gif", 300), put("b.gif", 200)
    assert run() == ["a.gif", "b.gif"]
    put("c.gif", 100), put("young.gif", -60)  # not settled yet
    assert run() == ["a.gif", "b.gif", "c.gif"]
