"""Media files from the command line.

    python -m reelbase.cli PATH ... [--out FOLDER] [--no-force] [--ranged] [--series [PATTERN]] [--codecs FILE] [--languages FILE]
        scan files, and show or write their relations
    python -m reelbase.cli id3 print PATH ... [--frameids]
    python -m reelbase.cli id3 set|remove|delete|dump|load PATH ... --out FOLDER [--set NAME VALUE] [--remove NAME] [--tags FOLDER]
        ID3 tags. Files aren't changed where they are: new ones are written below FOLDER, under the names that they have below PATH
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import SERIES
from .operators import id3, id3_edit
from .operators.relations import Features, collect, rendered, stage
from .operators.walk import elements
from .sources.files import configure, list_files, read_elements, unidentified
from .sources.media_files import NAME, media_source
from .sources.registry import route


def scan(spark: SparkSession, args: list[str]) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("paths", nargs="+")
    p.add_argument("--out", help="write media, tracks, tags, tables, artifacts and warnings as Parquet below this folder")
    p.add_argument("--no-force", action="store_true", help="trust suffixes only")
    p.add_argument("--ranged", action="store_true", help="read by offset at paths that all executors have mounted")
    p.add_argument("--series", nargs="?", const=SERIES, help="split names of videos into series, season, episode and title, by a pattern with these four groups")
    p.add_argument("--codecs", help="CSV file with the columns code, codec: names for codes that aren't built in")
    p.add_argument("--languages", help="CSV file with the columns code, language: names that go before the built-in ones")
    a = p.parse_args(args)
    table = lambda path: spark.read.option("header", True).csv(path) if path else None
    features = Features(a.series, table(a.codecs), table(a.languages))
    found = collect(spark, read_elements(spark, a.paths, force=not a.no_force, ranged=a.ranged), features)
    if a.out:
        for name, df in found.items():
            df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
        return
    for row in rendered(found["media"]).toLocalIterator():
        print(f"{row.path}\n{row.text}\n")
    for row in unidentified(spark, a.paths, not a.no_force).toLocalIterator():
        print(f"{row.path}: unable to identify file")


def edited(files: DataFrame, sets: list[list[str]], removed: list[str]) -> DataFrame:
    """Files with these frames or everyday names set and removed; names of four capitals and digits are frames."""
    e = stage(files.sparkSession, elements(route(files), kinds=("mp3",)))
    values = {n: F.lit(v) for n, v in sets} | dict.fromkeys(removed)
    frame = lambda n: len(n) == 4 and n.upper() == n
    if any(map(frame, values)) and not all(map(frame, values)):
        raise ValueError("either names of frames or everyday names")
    if not any(map(frame, values)):
        return id3_edit.renamed(files, e, values)
    if wrong := [n for n, v in values.items() if v is not None and n[0] not in "TW"]:
        raise ValueError(f"only frames of texts and links are set by name: {wrong}")
    return id3_edit.changed(files, e, {n: None if v is None else id3.url_body(v) if n[0] == "W" else id3.text_body(v, 1) for n, v in values.items()})


def tags(spark: SparkSession, args: list[str]) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("print", "set", "remove", "delete", "dump", "load"))
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--set", nargs=2, action="append", default=[], metavar=("NAME", "VALUE"))
    p.add_argument("--remove", action="append", default=[], metavar="NAME")
    p.add_argument("--tags", help="load: the folder that dump wrote")
    p.add_argument("--frameids", action="store_true", help="print frames instead of everyday names")
    a = p.parse_args(args)
    if a.command != "print" and not a.out or a.command == "load" and not a.tags or a.command in ("set", "remove") and not a.set + a.remove:
        p.error("--out, --tags, --set or --remove is missing")
    root = a.path.rstrip("/")
    files = list_files(spark, a.path, suffixes=("mp3",), content=True).select("path", "content")
    # names below the given folder; a single file has its own
    below = F.when(F.instr("path", f"{root}/") > 0, F.substring_index("path", f"{root}/", -1)).otherwise(F.substring_index("path", "/", -1))
    files = files.withColumn("path", below)
    if a.command == "print":
        f = id3.frames(elements(route(files), kinds=("mp3",)))
        shown = f.select("path", "n", F.concat_ws("", "frameid", F.lit("="), F.coalesce(F.array_join("texts", " / "), "url", F.concat(F.length("data").cast("string"), F.lit(" bytes")))).alias("line"))
        if not a.frameids:
            m = id3.friendly(f)
            lines = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in m.columns if c != "path"])
            shown = m.select("path", F.posexplode(F.array_compact(lines)).alias("n", "line"))
        for row in shown.orderBy("path", "n").toLocalIterator():
            print(f"{row.path}: {row.line}")
    elif a.command == "dump":
        id3_edit.dumped(files).where("tag IS NOT NULL").write.mode("errorifexists").parquet(a.out)
    else:
        if a.command == "load":
            files = id3_edit.loaded(files, spark.read.parquet(a.tags))
        elif a.command == "delete":
            files = files.withColumn("content", id3.without_tag(F.col("content")))
        else:
            files = edited(files, a.set, a.remove)
        media_source(spark)
        files.select("path", "content").write.format(NAME).mode("append").save(a.out)


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    spark = configure(SparkSession.builder.appName("reelbase").getOrCreate())
    if args[:1] == ["id3"]:
        tags(spark, args[1:])
    else:
        scan(spark, args)


if __name__ == "__main__":
    main()
