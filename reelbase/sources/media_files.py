"""A data source of files, ``reel_files``, for the DataFrame API, SQL and Structured Streaming.

    media_source(spark)                                                     # once a session
    spark.read.format("reel_files").load("/data/media").where("suffix = 'mkv' AND length < 1000000000")
    spark.sql("CREATE TEMPORARY VIEW files USING reel_files OPTIONS (path '/data/media')")
    spark.readStream.format("reel_files").load("/data/incoming")
    files.write.format("reel_files").mode("append").save("/data/copies")    # (path, content) rows become files

Rows are (path, suffix, length, modified, head): what routing needs, so ``elements(route(files))`` follows, which reads on by offset.

* Filters on path, suffix, length and modified are pushed: they are applied to the listing, before files are planned or opened.
* Partitions are planned by the bytes that reading needs of files of their kinds, not by their number or length. As with Spark's own file
  sources, the listing (a path, a length and a time for each file) is the driver's; heads are read in tasks. On mounted paths the driver goes
  through it file by file and keeps what passes the filters packed, some ten bytes a file; stores are listed by Arrow, which holds the list.
* A stream goes by modification time: a batch has the files changed after the last one, up to ``settle`` seconds ago (5 by default), as
  times of files that are still being written may come out of order. Files that are put there with older times than that are not seen.
* A written file appears whole, under a name that a repeated task writes again with the same bytes. Hidden names (``_`` or ``.``) aren't listed.

Options: ``path``; ``head``, bytes of each file to read (0: none, the column is null); ``settle``.
"""

from __future__ import annotations

import operator
import os
import stat
import time
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from ..operators.walk import located, opened
from .files import NEED, NEEDS, TASK
from .registry import HEAD

NAME = "reel_files"
FILES = "path string, suffix string, length bigint, modified timestamp, head binary"
#: Files of a task at most, however small; bytes of heads that are held at a time.
MANY, HELD = 2000, 8 << 20
COMPARE = {
    EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
    StringContains: operator.contains,
}


class Files(InputPartition):
    """(path, length, modification time in ns) of a task's files, packed: the driver holds those of all tasks."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        paths, *numbers = zip(*sorted(files), strict=True) if files else ((), (), ())
        self.n = len(paths)
        self.packed = [zlib.compress(x) for x in ("\0".join(paths).encode("utf-8", "surrogateescape"), *(array("q", x).tobytes() for x in numbers))]

    @property
    def files(self) -> list[tuple[str, int, int]]:
        paths, *numbers = map(zlib.decompress, self.packed)
        return list(zip(paths.decode("utf-8", "surrogateescape").split("\0"), *(array("q", x) for x in numbers), strict=True)) if self.n else []


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def below(folder: str) -> Iterator[tuple[str, int, int]]:
    """Path, length and modification time of the files at or below a folder of this machine, one after the other; without hidden ones."""
    folders = [folder]
    while folders:
        with os.scandir(top := folders.pop()) as found:
            for x in found:
                if x.name[:1] in ("_", "."):
                    continue
                try:
                    told = x.stat()
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
                if stat.S_ISDIR(told.st_mode):
                    folders.append(x.path)
                elif stat.S_ISREG(told.st_mode):
                    yield f"{top.rstrip('/')}/{x.name}", told.st_size, told.st_mtime_ns


def listing(root: str) -> Iterator[tuple[str, int, int]]:
    """Path, length and modification time of the files at or below a path; hidden ones and those below hidden folders are left out."""
    store, name = located(root)
    scheme = "file:" if root.startswith(("file:", "/")) else root.split("://", 1)[0] + "://"
    found = store.get_file_info(name)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if found.is_file:
        yield scheme + found.path, found.size, found.mtime_ns or 0
    elif isinstance(store, fs.LocalFileSystem):
        yield from ((scheme + path, size, ns) for path, size, ns in below(name))
    else:
        for f in store.get_file_info(fs.FileSelector(name, recursive=True)):
            if f.is_file and not any(x[:1] in ("_", ".") for x in f.path[len(name) :].strip("/").split("/")):
                yield scheme + f.path, f.size, f.mtime_ns or 0


def moment(ns: int) -> datetime:
    return datetime.fromtimestamp(ns // 1000 / 1e6, timezone.utc)


#: What filters may be on, of a file as it is listed.
COLUMNS = {("path",): lambda f: f[0], ("suffix",): lambda f: suffix_of(f[0]), ("length",): lambda f: f[1], ("modified",): lambda f: moment(f[2])}


def fits(wanted: Filter, file: tuple[str, int, int]) -> bool | None:
    """Whether a file passes; None if the filter is of another kind or on another column."""
    if isinstance(wanted, Not):
        inner = fits(wanted.child, file)
        return None if inner is None else not inner
    if getattr(wanted, "attribute", None) not in COLUMNS:
        return None
    value = COLUMNS[wanted.attribute](file)
    if isinstance(wanted, IsNotNull):
        return True
    if isinstance(wanted, In):
        return value in wanted.value
    return COMPARE[type(wanted)](value, wanted.value) if type(wanted) in COMPARE and wanted.value is not None else None


def plan(files: Iterable[tuple[str, int, int]]) -> list[Files]:
    """Files as they are listed, dealt so that a task has about TASK bytes to read, its files in the order of their paths."""
    tasks, held, bytes_ = [], [], 0
    for f in files:
        held.append(f)
        bytes_ += min(f[1], NEEDS.get(suffix_of(f[0]), NEED))
        if bytes_ >= TASK or len(held) >= MANY:
            tasks.append(Files(held))
            held, bytes_ = [], 0
    return [*tasks, Files(held)] if held or not tasks else tasks


def batches(files: list[tuple[str, int, int]], head: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task's files. A file that can't be opened has no head: splitting meets the same and says so."""
    held, weight = [], 0
    for path, length, ns in files:
        start = None
        if head:
            try:
                with opened(path) as read:
                    start = read(0, head)
            except (OSError, pa.ArrowException):
                pass
        held.append((path, suffix_of(path), length, ns // 1000, start))
        weight += 200 + len(start or b"")
        if weight > HELD:
            yield batch(held)
            held, weight = [], 0
    if held:
        yield batch(held)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "suffix": pa.string(), "length": pa.int64(), "modified": pa.timestamp("us", tz="UTC"), "head": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class MediaFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError(f"{NAME} only appends: use mode('append')")
        if not {"path", "content"} <= set(schema.fieldNames()):
            raise ValueError(f"{NAME} writes the columns path and content")
        return Writer(self.options)


class Batch(DataSourceReader):
    def __init__(self, options):
        self.root, self.head, self.pushed = options["path"], int(options.get("head", HEAD)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if fits(f, ("", 0, 0)) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> Sequence[InputPartition]:
        return plan(f for f in listing(self.root) if all(fits(w, f) for w in self.pushed))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(partition.files, self.head)


class Stream(DataSourceStreamReader):
    """Offsets are modification times in ns."""

    def __init__(self, options):
        self.root, self.head, self.settle = options["path"], int(options.get("head", HEAD)), float(options.get("settle", 5))
        self.latest = -1

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        self.latest = max((ns for _, _, ns in listing(self.root) if ns <= until), default=self.latest)
        return {"ns": self.latest}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return plan(f for f in listing(self.root) if start["ns"] < f[2] <= end["ns"])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(partition.files, self.head)


class Writer(DataSourceArrowWriter):
    """Each row's content goes to a hidden file first and takes its name when it is whole."""

    def __init__(self, options):
        self.root, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = located(self.root)
        hidden, made = f"{root}/_writing-{self.job}", set()
        for rows in iterator:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                name = path.as_py()
                if not name or not content.is_valid or name.startswith("/") or any(x in ("", ".", "..") for x in name.split("/")):
                    raise ValueError(f"not a file below the folder: {name!r}")
                target, part = f"{root}/{name}", f"{hidden}/{uuid.uuid4().hex}"
                for folder in {hidden, target.rsplit("/", 1)[0]} - made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, target)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        self.abort(messages)

    def abort(self, messages) -> None:
        """Remove what lost tasks left half written; whole files stay."""
        store, root = located(self.root)
        if store.get_file_info(f"{root}/_writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_writing-{self.job}")


def media_source(spark: SparkSession) -> SparkSession:
    """Make ``reel_files`` known to the session, its filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaFiles)
    return spark


def media_files(spark: SparkSession, path: str, **options) -> DataFrame:
    return media_source(spark).read.format(NAME).options(**options).load(path)
