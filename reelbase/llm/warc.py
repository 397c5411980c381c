"""WARC archives without repeated payloads.

Only headers (id, address, digest) are shuffled by payload digest: of payloads that occur more than once the largest id's
is the original, and each other page's reference to it is joined back by page id and digest, which no hot payload skews.
Records are written by Spark's text writer, so archives are committed like any other table and land on any file
system Spark can write. A record is a gzip member of its own; the last byte of a member (the highest of its length, zero
below 16 MiB) is what the writer puts between rows. Pages over LARGE bytes are written as they are, a file each, so
that files are bounded in bytes. Files are read back whole, record by record, and parsed by their Content-Length.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, new_path, staged

#: Uncompressed bytes that an archive file is meant to have; payload bytes over which a page has a file of its own.
FILE_BYTES, LARGE = 32 << 20, 1 << 20
#: A payload that more than one in so many pages have is hot: there are fewer of them than that. Addresses up to HOT_URL bytes are broadcast.
HOT_SHARE, HOT_URL = 1000, 4096
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def heads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, digest, bytes, p) of every page; a null html is empty."""
    x = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), F.coalesce(col(html_col).cast("string"), F.lit("")).alias("p"))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("about:blank"))
    return x.select("id", url.alias("url"), F.sha1("p").alias("digest"), F.octet_length("p").cast("long").alias("bytes"), "p")


def references(x: DataFrame, least_bytes: int) -> DataFrame:
    """(r_id, r_digest, original, original_url): of heads the pages that repeat a payload of at least least_bytes, with the largest id that has it.

    Of rows that share the original's id the greatest address counts. Payloads that only pages without id have, have no original.
    A payload that more than one in HOT_SHARE of these pages have is one of fewer than HOT_SHARE: their originals are broadcast, so that no
    task gets all pages of one payload; the others, and those whose original has an address of over HOT_URL bytes, meet theirs by a join on the digest.
    """
    thin = x.where(F.col("bytes") >= least_bytes).groupBy("digest", "id").agg(F.max("url").alias("url"))
    thin = staged(thin, "warc-heads")
    first = thin.groupBy("digest").agg(F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("o"), F.count("*").alias("n")).where("n > 1 AND o IS NOT NULL")
    hot = (F.col("n") * HOT_SHARE > thin.count()) & (F.coalesce(F.octet_length("o.url"), F.lit(0)) <= HOT_URL)
    first = staged(first.select("digest", "o", hot.alias("hot")), "warc-originals")
    known = thin.join(F.broadcast(first.where("hot").select("digest", F.col("o").alias("h"))), "digest", "left")
    found = known.where("h IS NOT NULL").select("id", "digest", F.col("h").alias("o")).unionByName(
        known.where("h IS NULL").select("id", "digest").join(first.where("NOT hot").select("digest", "o"), "digest")
    )
    found = found.where(~F.col("id").eqNullSafe(F.col("o.id")))
    return found.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("o.id").alias("original"), F.col("o.url").alias("original_url"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record, bytes): each page as one WARC record without the blank line that ends it, and its payload's size."""
    x = heads(pages, id_col, url_col, html_col)
    refs = staged(references(x.drop("p"), least_bytes), "warc-references")
    x = x.join(refs, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("original").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("p")))
    back = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("original"))), line("WARC-Refers-To-Target-URI", F.col("original_url")), line("WARC-Refers-To-Date", F.lit(date))
    )
    return x.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.0\r\n"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", name(F.col("id"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(revisit, back).otherwise(""),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("record"),
        F.when(revisit, 0).otherwise(F.col("bytes")).alias("bytes"),
    )


END = "\r\n\r\n"


def members(found: DataFrame) -> DataFrame:
    """(value): records as gzip members without the last byte, which is zero."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.column(0).to_pylist():
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append((pack.compress(r.encode() + END.encode()) + pack.flush())[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return found.select("record").mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Write the pages' records below path: gzipped WARC files of about FILE_BYTES (before compression), and large pages in plain ones."""
    html = col(options.get("html_col", "html"))
    row = pages.agg(F.avg(F.octet_length(html)), F.max(F.octet_length(html))).first()
    most = max(1, min(int(FILE_BYTES / ((row[0] or 0) + 500)), (1 << 30) // (LARGE + 500)))  # a GiB at most, were all pages of LARGE bytes
    found = records(pages, **options)
    small = members(found.where(F.col("bytes") <= LARGE))
    small.write.option("encoding", "ISO-8859-1").option("lineSep", "\0").option("maxRecordsPerFile", most).text(f"{path}/members")
    if (row[1] or 0) > LARGE:
        found.where(F.col("bytes") > LARGE).select("record").write.option("lineSep", END).option("maxRecordsPerFile", 1).text(f"{path}/plain")


def unpacked(data: bytes):
    """The bytes of each gzip member; a plain file is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("a record is cut off")
            piece = data[at : at + 65536]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parse_records(data: bytes):
    """(page id, type, digest, payload bytes, refers to) for each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"record at byte {at} is damaged")
        yield _page(head["WARC-Record-ID"]), head["WARC-Type"], digest, size, _page(head.get("WARC-Refers-To"))
        at = end + 4 + len(block) + 4


def _page(name: str | None) -> int | None:
    return None if name in (None, "<urn:page:none>") else int(name.removeprefix("<urn:page:").removesuffix(">"))


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record below path."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                rows = [r for part in unpacked(b.column(0)[k].as_py()) for r in parse_records(part)]
                cols = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (3, pa.int64()), (2, pa.string()), (1, pa.string()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back.

    A null html is empty; a null url is about:blank; pages without an id revisit the original if their payload has
    one; rows that repeat the original's id are responses too; an empty table gives no rows; other columns are ignored.
    """
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
o AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN o.original IS NOT NULL AND d.page_id IS DISTINCT FROM o.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM o.original THEN o.original END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)
"""
