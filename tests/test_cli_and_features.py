"""The command line, what readers may switch on, and whole tags."""

import os

import pytest
from pyspark.sql import functions as F

from reelbase import cli
from reelbase.functions import text as T
from reelbase.functions.codes import codec_table, languages
from reelbase.operators import id3, id3_edit
from reelbase.operators import relations as R
from reelbase.operators.walk import elements
from reelbase.plans import fixtures as X
from reelbase.sources.media_files import NAME, media_source
from reelbase.sources.registry import route


@pytest.fixture(scope="module")
def songs(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("songs"))
    c = X.table(spark, sf, "customer").orderBy("c_custkey").limit(6)
    media_source(spark)
    for m in (2, 3, 4):
        X.mp3(c.where(F.col("c_custkey") % 3 == m - 2), m).write.format(NAME).mode("append").save(root)
    return root


def read(folder):
    out = {}
    for at, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".mp3"):
                with open(os.path.join(at, n), "rb") as f:
                    out[os.path.relpath(os.path.join(at, n), folder)] = f.read()
    return out


def titles(spark, contents):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")
    return {r.path: r for r in id3.friendly(id3.frames(elements(route(df)))).collect()}


def test_set_and_remove_by_everyday_names(spark, songs, tmp_path):
    out = str(tmp_path / "new")
    before = read(songs)
    cli.main(["id3", "set", songs, "--out", out, "--set", "title", "Ünnamed ✓", "--set", "date", "1999-12-31", "--remove", "artist"])
    after = read(out)
    assert sorted(after) == sorted(before) and len(after) == 6
    for path, row in titles(spark, after).items():
        assert row.title == "Ünnamed ✓" and not row.artist
        assert row.date == ("1999-12-31" if before[path][3] == 4 else "1999")
    assert read(songs) == before


def test_set_frames_by_their_names(spark, songs, tmp_path, capsys):
    out = str(tmp_path / "new")
    cli.main(["id3", "set", songs, "--out", out, "--set", "TALB", "An album", "--set", "WOAR", "http://x/y", "--remove", "TPE1"])
    capsys.readouterr()
    cli.main(["id3", "print", out, "--frameids"])
    said = capsys.readouterr().out
    assert said.count("TALB=An album") + said.count("TAL=An album") == 6
    assert said.count("WOAR=http://x/y") + said.count("WAR=http://x/y") == 6
    assert "TPE1" not in said and "TP1" not in said
    cli.main(["id3", "print", out])
    assert capsys.readouterr().out.count("album=An album") == 6


def test_dump_delete_and_load_give_the_same_files(spark, songs, tmp_path):
    before = read(songs)
    dump, bare, again = (str(tmp_path / x) for x in ("dump", "bare", "again"))
    cli.main(["id3", "dump", songs, "--out", dump])
    cli.main(["id3", "delete", songs, "--out", bare])
    assert all(not v.startswith(b"ID3") and before[k].endswith(v) for k, v in read(bare).items())
    cli.main(["id3", "load", bare, "--tags", dump, "--out", again])
    assert read(again) == before


def test_wrong_calls_are_refused(spark, songs, tmp_path):
    out = str(tmp_path / "none")
    for wrong in (["set", songs, "--out", out], ["load", songs, "--out", out], ["delete", songs]):
        with pytest.raises(SystemExit):
            cli.main(["id3", *wrong])
    for wrong in (["--set", "titel", "x"], ["--set", "title", "x", "--set", "TIT2", "y"], ["--set", "APIC", "x"]):
        with pytest.raises(ValueError):
            cli.main(["id3", "set", songs, "--out", out, *wrong])
    assert not os.path.exists(out)


def test_loaded_tags_null_missing_repeated_and_files_without_tag(spark):
    tag = lambda t: b"ID3\4\0\0\0\0\0" + bytes([len(t)]) + t
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in {"a": b"sound", "b": tag(b"12") + b"sound", "c": tag(b"3"), "d": b"", "e": tag(b"5") + b"x"}.items()], "path string, content binary")
    dumps = spark.createDataFrame([("a", bytearray(tag(b"7"))), ("b", None), ("c", bytearray(b"")), ("e", bytearray(tag(b"8"))), ("e", bytearray(tag(b"9"))), ("z", bytearray(b"?"))], "path string, tag binary")
    assert {r.path: bytes(r.content) for r in id3_edit.loaded(files, dumps).collect()} == {"a": tag(b"7") + b"sound", "b": b"sound", "c": b"", "d": b"", "e": tag(b"9") + b"x"}
    assert {r.path: r.tag and bytes(r.tag) for r in id3_edit.dumped(files).collect()} == {"a": None, "b": tag(b"12"), "c": tag(b"3"), "d": None, "e": tag(b"5")}


def test_a_registry_names_what_the_built_in_tables_do_not(spark):
    codecs = spark.createDataFrame([("0x0999", "House tag"), ("zz99", "House code"), ("ZZ99", "A house code"), ("DIVX", "not this"), (None, "x"), ("yy", None)], "code string, codec string")
    df = spark.createDataFrame([(c,) for c in ("0x999", "0x0999", "zz99", "divx", "0x55", None, "????", "V_X")], "code string")
    got = {r.code: (r.fourcc, r.codec) for r in T.with_codec(df, "code", codecs).collect()}
    assert got == {
        "0x999": ("0x999", "House tag"), "0x0999": ("0x0999", "House tag"), "zz99": ("ZZ99", "A house code"), "divx": ("DIVX", "DivX"), "0x55": ("0x55", "MPEG Layer-3"),
        None: (None, "Unknown"), "????": (None, "Unknown"), "V_X": (None, "V_X"),
    }
    table = {r.code: r.codec for r in codec_table(spark, codecs).collect()}
    assert table["0x999"] == "House tag" and table["DIVX"] == "not this" and table["0x55"] == "MPEG Layer-3"
    names = languages(spark, spark.createDataFrame([("ENG", "Anglais"), ("qaa", "Own"), ("ger", None)], "code string, language string"))
    named = {r.code: r.language for r in names.collect()}
    assert named["eng"] == "Anglais" and named["qaa"] == "Own" and named["ger"] == "German" and named["en"] == "English"


def test_features(spark, sf):
    with pytest.raises(ValueError):
        R.Features(series="([a-z]+)-([0-9]+)")
    o = X.table(spark, sf, "orders").limit(2)
    e = elements(route(X.avi(o).withColumn("path", F.concat(F.lit("x/A show 2x05 The end"), F.monotonically_increasing_id().cast("string"), F.lit(".avi")))))
    plain, split = R.media(e, ("riff",)).collect(), R.media(e, ("riff",), features=R.Features(series=T.SERIES)).collect()
    assert {r.series for r in plain} == {None}
    assert {(r.series, r.season, r.episode) for r in split} == {("A show", 2, 5)} and all(r.title.startswith("The end") for r in split)
