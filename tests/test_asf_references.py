"""ASF streams with properties and languages in any order, repeated, missing or without a counterpart."""

import struct

from reelbase.operators import video as V
from reelbase.operators.walk import SCHEMA


def stream(kind, number):
    return bytes.fromhex(kind) + bytes(32) + struct.pack("<H", number) + bytes(40)


def properties(number, rate, lang, time):
    return bytes(16) + struct.pack("<I", rate) + bytes(28) + struct.pack("<HHQ", number, lang, time)


def test_references_in_any_order(spark):
    lang = f"{V.ASF}/{V.LANGUAGES}/language"
    rows = [
        ("a", V.EXTENDED, "p", 0, properties(2, 100, 1, 400_000)), ("a", V.STREAM, "s", 0, stream(V.AUDIO, 2)), ("a", V.STREAM, "s", 0, stream(V.VIDEO, 1)), ("a", V.EXTENDED, "p", 0, properties(2, 200, 0, 0)), ("a", V.STREAM, "s", 0, stream(V.AUDIO, 3)),
        ("a", V.STREAM, "s", 0, stream("00" * 16, 4)), ("a", V.EXTENDED, "p", 0, properties(9, 1, 0, 1)), ("a", "language", lang, 1, b"de"), ("a", "language", lang, 0, b"en"), ("b", V.STREAM, "s", 0, b""), ("c", V.EXTENDED, "p", 0, properties(1, 1, 5, 1)), ("c", V.STREAM, "s", 0, stream(V.VIDEO, 1)),
    ]
    e = spark.createDataFrame([(p, "asf", n, [], i, place, at, 0, bytearray(b)) for n, (p, i, place, at, b) in enumerate(rows)], SCHEMA)
    got = sorted((r.path, r.kind, r.ordinal, r.id, r.bitrate, r.fps, r.language_raw) for r in V.asf_tracks(e).collect())
    # of two properties of stream 2 the later counts; stream 3 has none; an unknown kind and a cut stream are left out; language 5 doesn't exist
    assert got == [("a", "audio", 0, "2", 200.0, 1000.0, "en"), ("a", "audio", 1, "3", 0.0, None, None), ("a", "video", 0, "1", None, None, None), ("c", "video", 0, "1", 1.0, 1e7, None)]
    plan = V.asf_tracks(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
