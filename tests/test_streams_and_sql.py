"""Sidecars that come late or never, table functions in SQL, and makers' arrays of other lengths and names."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reelbase.functions.binary import join, to_be
from reelbase.functions.table_functions import table_functions
from reelbase.operators import id3, image
from reelbase.operators.walk import elements
from reelbase.plans import fixtures as X
from reelbase.sources.registry import route
from reelbase.streaming.ingest import run_to_end, with_late_sidecars

START = datetime(2026, 1, 1)
SIDE = b'<image><field name="title">from the sidecar</field></image>'
COLUMNS = "path string, modificationTime timestamp, title string, content binary"


def test_a_sidecar_in_a_later_batch_and_one_that_never_comes(spark, tmp_path):
    arriving, out, checkpoint = (str(tmp_path / x) for x in ("arriving", "out", "checkpoint"))

    def batch(*files):
        rows = [(path, START + timedelta(minutes=minute), "own", bytearray(SIDE) if path.endswith("xml") else None) for path, minute in files]
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(arriving)
        stream = lambda: spark.readStream.schema(COLUMNS).parquet(arriving)
        images = stream().where("path LIKE '%.gif'").drop("content")
        return sorted((r.path, r.title) for r in run_to_end(with_late_sidecars(images, stream(), "10 minutes", "1 minute"), out, checkpoint).collect())

    assert batch(("a.gif", 0), ("b.gif", 0), ("c.gif.xml", 1)) == []  # nothing to say yet: either may have a sidecar
    found = batch(("a.gif.xml", 5), ("c.gif", 6))
    assert found == [("a.gif", "from the sidecar"), ("c.gif", "from the sidecar")]  # in either order
    found = batch(("x.gif", 60), ("x.gif.xml", 60))
    assert found == [("a.gif", "from the sidecar"), ("b.gif", "own"), ("c.gif", "from the sidecar"), ("x.gif", "from the sidecar")]  # b's time is over
    assert batch(("b.gif.xml", 5), ("y.gif", 61), ("y.gif.xml", 62)) == sorted([*found, ("y.gif", "from the sidecar")])  # too late: nothing comes twice


@pytest.mark.parametrize("major", [2, 3, 4])
def test_table_functions_say_what_the_columns_say(spark, sf, major):
    files = X.mp3(X.table(spark, sf, "customer").limit(20), major)
    files.createOrReplaceTempView("some_mp3")
    mine = table_functions(spark).sql("SELECT path, f.version, f.n, f.frameid, f.texts FROM some_mp3, LATERAL id3_frames(content) AS f WHERE f.texts IS NOT NULL")
    theirs = id3.frames(elements(route(files))).where("shape IN ('text', 'described')").select("path", "version", "n", "frameid", "texts")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mine) == rows(theirs) and mine.count() > 20


def test_table_functions_of_nothing_and_nonsense(spark):
    table_functions(spark)
    spark.createDataFrame([("mp3", None), (None, bytearray(b"ID3")), ("png", bytearray(b"\x89PNG\r\n\x1a\nxxxx")), ("mp3", bytearray(b""))], "parser string, content binary").createOrReplaceTempView("odd_files")
    got = spark.sql("SELECT parser, count(*) AS n, max(e.size) AS size FROM odd_files, LATERAL media_elements(parser, content) AS e GROUP BY parser").collect()
    assert {r.parser for r in got} == {"png", "mp3"}
    assert spark.sql("SELECT * FROM odd_files, LATERAL id3_frames(content)").count() == 0


def test_makers_arrays_with_names_of_ones_own(spark):
    def note(data):
        entry = X.ifd([(0x1, 3, F.length(data) / 2, to_be(300, 4)), (0x99, 3, F.lit(3), to_be(300, 4))])
        pad = lambda b, n: F.substring(F.concat(b, X.zeros(n)), 1, n)
        head = join(b"MM\0*", to_be(8, 4), X.ifd([(0x10F, 2, F.lit(6), to_be(60, 4)), (0x8769, 4, F.lit(1), to_be(90, 4))]))
        exif = X.all_of(pad(head, 60), pad(join(b"Canon"), 30), pad(X.ifd([(0x927C, 7, F.lit(100), to_be(120, 4))]), 30), pad(entry, 180), data)
        return join(b"\xff\xd8", X.segment(0xE1, join(b"Exif\0\0", exif)), b"\xff\xda")

    lengths = {"long": b"\0\x08\0\x01\0\x05\0\x09", "short": b"\0\x04\0\x02\0\x00", "none": b"\0\x02\0\0\0\0"[:6]}
    files = spark.createDataFrame([(f"{k}.jpg", bytearray(v)) for k, v in lengths.items()], "path string, data binary").select("path", note(F.col("data")).alias("content"))
    e = elements(route(files)).persist()
    got = {(r.path, r.tag, r.position): (r.name, r.value) for r in image.maker_arrays(e).collect()}
    assert got["long.jpg", "0001", 1] == ("Macromode", "Macro") and got["long.jpg", "0001", 3] == ("Quality", "Unknown") and got["short.jpg", "0001", 1] == ("Macromode", "Normal")
    assert ("long.jpg", "0001", 0) not in got and not any(tag == "0099" for _, tag, _ in got)
    names, codes = image.array_names(spark)
    more = spark.createDataFrame([("CANON", "0099", 2, "Mine")], names.schema), spark.createDataFrame([("CANON", "0099", 2, 5, "five")], codes.schema)
    own = {(r.path, r.position): (r.name, r.value) for r in image.maker_arrays(e, names.unionByName(more[0]), codes.unionByName(more[1])).where("tag = '0099'").collect()}
    assert own["long.jpg", 2] == ("Mine", "five") and own["short.jpg", 2] == ("Mine", "Unknown") and own["long.jpg", 1] == (None, "1")
