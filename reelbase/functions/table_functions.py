"""Table functions for SQL: a file's elements and an ID3 tag's frames, for use beside a BINARY column.

    table_functions(spark)                                                   # once a session
    SELECT path, e.place, e.size FROM files, LATERAL media_elements(parser, content) AS e
    SELECT path, f.frameid, f.texts FROM files, LATERAL id3_frames(content) AS f

``media_elements`` splits in Python, with rows sent by Arrow in batches (functions that take whole Arrow batches can't stand in a lateral join).
What bodies mean is SQL: ``id3_frames`` is a table function of SQL over it, decoded by ``id3_texts``, so the planner sees through both.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.walk import Budget, file_elements

ELEMENTS = "n int, up array<int>, id string, place string, at bigint, size bigint, body binary"


class MediaElements:
    """Elements of a content by the parser named; none without a parser or content. See ``operators.walk`` for what they say."""

    def eval(self, parser: str, content: bytes) -> Iterator[tuple]:
        if parser is not None and content is not None:
            for n, (up, ident, place, at, size, body) in enumerate(file_elements("", parser, bytes(content), Budget(), {})):
                yield n, up, ident, place, at, min(size, 2**62), body


#: The text values of a body: after the byte that names the encoding, without marks, between NULs, those at the end left out.
TEXTS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION id3_texts(body BINARY) RETURNS ARRAY<STRING> RETURN split(regexp_replace(replace(
  CASE hex(substring(body, 1, 1))
    WHEN '00' THEN decode(substring(body, 2), 'ISO-8859-1')
    WHEN '01' THEN decode(substring(body, 2, (length(body) - 1) DIV 2 * 2), 'UTF-16')
    WHEN '02' THEN decode(substring(body, 2, (length(body) - 1) DIV 2 * 2), 'UTF-16BE')
    WHEN '03' THEN decode(substring(body, 2), 'UTF-8') END,
  '﻿', ''), '\0+$', ''), '\0')
"""
#: Frames in their order, under the names that they have; described texts give their value, and their description apart.
FRAMES = r"""
CREATE OR REPLACE TEMPORARY FUNCTION id3_frames(content BINARY)
RETURNS TABLE (n INT, version STRING, frameid STRING, description STRING, texts ARRAY<STRING>, url STRING, body BINARY)
RETURN SELECT n, regexp_extract(place, '^ID3v(2.[234])/', 1), id,
  CASE WHEN id IN ('TXXX', 'TXX') THEN id3_texts(body)[0] END,
  CASE WHEN id IN ('TXXX', 'TXX') THEN slice(id3_texts(body), 2, 1) WHEN startswith(id, 'T') THEN id3_texts(body) END,
  CASE WHEN startswith(id, 'W') AND id NOT IN ('WXXX', 'WXX') THEN substring_index(decode(body, 'ISO-8859-1'), '\0', 1) END,
  body
FROM media_elements('mp3', id3_frames.content) WHERE place RLIKE '^ID3v2[.][234]/'
"""


def table_functions(spark: SparkSession) -> SparkSession:
    """Make the functions known to the session."""
    spark.udtf.register("media_elements", F.udtf(MediaElements, returnType=ELEMENTS, useArrow=True).asDeterministic())
    spark.sql(TEXTS)
    spark.sql(FRAMES)
    return spark
