"""Fill-in-middle transformation by a table-driven byte automaton.

A text's units are its runs of ASCII letters and its other code points. One scan over the UTF-8 bytes runs an automaton whose
tables say for each state and byte class the next state and what the transition emits: the start of a unit, the start of a code
point, a whole sentinel. Continuation bytes emit nothing. The automaton remembers two bytes at most, so a buffer is cut into
lanes that are stepped side by side, each beginning in the state that the two bytes before it lead to; byte 0xFF, which UTF-8
never has, stands between texts. The emitted transitions are counted by text. A second pass finds the bytes at which the two
cuts fall, by the counts of blocks and then within one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table

#: What a transition emits, as bits.
UNIT, CHAR, SENTINEL = 1, 2, 4
BETWEEN, LETTER, MARK, OPEN, CLOSE, CONTINUES, OTHER = range(7)
PLAIN, LETTERS, OPENED, MARKED = range(4)
#: Bytes of a buffer of short texts; a longer text has a buffer of its own.
BUFFER = 1 << 20
#: Bytes whose units are counted together for the second pass.
BLOCK = 1 << 16


def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    for b in range(26):
        out[65 + b] = out[97 + b] = LETTER
    for b, k in ((b"<", OPEN), (b">", CLOSE), (b"P", MARK), (b"S", MARK), (b"M", MARK), (b"\xff", BETWEEN)):
        out[b[0]] = k
    out[0x80:0xC0] = CONTINUES
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is emitted) for state * 7 + class."""
    after, out = np.zeros((4, 7), dtype=np.uint8), np.zeros((4, 7), dtype=np.uint8)
    for state in range(4):
        inside = state in (LETTERS, MARKED)
        after[state] = (PLAIN, LETTERS, MARKED if state == OPENED else LETTERS, OPENED, PLAIN, PLAIN, PLAIN)
        letter = CHAR if inside else CHAR | UNIT
        out[state] = (0, letter, letter, CHAR | UNIT, CHAR | UNIT | (SENTINEL if state == MARKED else 0), 0, CHAR | UNIT)
    return after.ravel(), out.ravel()


CLASS, (NEXT, EMIT) = byte_classes(), transitions()


def scan(buffer: bytes) -> np.ndarray:
    """What the automaton emits at each byte; 0xFF parts texts."""
    size = len(buffer)
    width = max(64, -(-size // 8192))
    lanes = -(-size // width)
    cls = np.full(lanes * width, BETWEEN, dtype=np.uint8)
    cls[:size] = CLASS[np.frombuffer(buffer, dtype=np.uint8)]
    steps = np.ascontiguousarray(cls.reshape(lanes, width).T)
    state = np.zeros(lanes, dtype=np.uint8)
    for t in (-2, -1):  # the two bytes before each lane
        state[1:] = NEXT[state[1:] * 7 + steps[t, :-1]]
    out = np.empty_like(steps)
    for t in range(width):
        at = state * 7 + steps[t]
        out[t], state = EMIT[at], NEXT[at]
    return out.T.ravel()[:size]


class Scanned:
    """A text's emitted transitions: their counts, and the second pass."""

    def __init__(self, emitted: np.ndarray):
        self.emitted = emitted
        starts = np.arange(0, len(emitted), BLOCK)
        self.before = np.append(0, np.cumsum(np.add.reduceat(emitted & UNIT, starts, dtype=np.int64))) if len(emitted) else np.zeros(1, dtype=np.int64)
        self.units = int(self.before[-1])

    def has_sentinel(self) -> bool:
        return bool((self.emitted & SENTINEL).any())

    def cut(self, k: int) -> int:
        """The byte behind the first k units."""
        if k >= self.units:
            return len(self.emitted)
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        part = self.emitted[block * BLOCK : (block + 1) * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part & UNIT)[k - self.before[block]])

    def chars(self, a: int, b: int) -> int:
        return int(np.count_nonzero(self.emitted[a:b] & CHAR))


def draws(ident, seed: int) -> list[int]:
    """h1 to h4 of a document's id; a null id counts as empty."""
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(b: bytes, s: Scanned, h: list[int], plain: int, spm: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, prefix_chars, middle_chars, output) of a text's bytes."""
    if not b or h[2] % 100 >= 100 - plain or s.has_sentinel():
        return "plain", None, None, b
    one, two = h[0] % (s.units + 1), h[1] % (s.units + 1)
    p, m = s.cut(min(one, two)), s.cut(max(one, two))
    prefix, middle, suffix = b[:p], b[p:m], b[m:]
    chars = s.chars(0, p), s.chars(p, m)
    if h[3] % 100 < spm:
        return "spm", *chars, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
    return "psm", *chars, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle


def buffers(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of these sizes that are scanned together."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > BUFFER:
            yield start, k
            start, held = k, 0
        held += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """(<id>, n, form, prefix_chars, middle_chars, output) for every row of docs.

    ``plain`` per cent of the texts stay as they are, ``spm`` per cent of the others put the suffix first. Cases: null counts as
    empty, empty texts and those that contain a sentinel stay plain; equal rows come back as often, with equal results; a null id
    draws like an empty one; an empty table gives no rows; other columns are ignored, whatever their names. A text of any length
    is scanned as a whole in about five times its bytes of memory. Of a batch only one buffer's texts are taken out at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(1).cast(pa.binary())
            for i, j in buffers(pc.fill_null(pc.binary_length(whole), 0).to_pylist()):
                ids, texts = b.column(0).slice(i, j - i).to_pylist(), [t or b"" for t in whole.slice(i, j - i).to_pylist()]
                emitted, at, rows = scan(b"\xff".join(texts)), 0, []
                for ident, t in zip(ids, texts, strict=True):
                    s = Scanned(emitted[at : at + len(t)])
                    rows.append((s.units, *rearranged(t, s, draws(ident, seed), plain, spm)))
                    at += len(t) + 1
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(col(id_col).alias("id"), col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), formed AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM cut
"""
