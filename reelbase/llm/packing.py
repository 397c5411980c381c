"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised where they lie and cut into pieces of at most ``capacity`` tokens. Only the number of
pieces of each length reaches the driver (at most ``capacity`` numbers). Best-fit decreasing runs over these
counts: bins with the same free space are one interval, so the plan's size depends on the capacity alone. Pieces
then take the planned slots by a join on their rank within their length. Ranks are made in two steps (a count for
each length and hash bucket, then row numbers within a bucket), and slots are joined on length and a stretch of
RANKS ranks, so a hot length is never in one task and one plan serves every size.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, staged

#: Entries of a worker's table of known words, and the longest word (in bytes) that it keeps.
CACHE_WORDS, CACHE_BYTES = 300_000, 48
#: Closing marks that the tokenizer always sets apart from a letter or digit before them.
MARKS = b".,!?%&*#$;:)]}"
#: Lower-case words that normalisation and splitting leave as they are, and the letters that stand for their bytes.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b if b in _shown else 256 + sum(x not in _shown for x in range(b)) for b in range(256)}
#: Rows of one rank bucket, on average.
BUCKET_ROWS = 20_000
#: Ranks of a length that a slot and a piece are joined under.
RANKS = 4096


class WordTokens(dict):
    """Maps a white-space-free chunk to its token ids as little-endian 32-bit words.

    The tokenizer drops white space and no merge crosses it, so a text's ids are its chunks' ids in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize

    def ids(self, texts: list[str | None], end: bytes) -> list[bytes]:
        chunks = [(t or "").encode().split() for t in texts]
        extra = self.learn(set().union(*chunks).difference(self))
        look = self.__getitem__ if not extra else lambda w: self[w] if w in self else extra[w]
        found = [b"".join(map(look, c)) + end for c in chunks]
        if len(self) > CACHE_WORDS:
            self.clear()
        return found

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Encode new chunks; those too long to keep are returned.

        The tokenizer lower-cases, and marks after an ASCII letter or digit are pieces of their own, so chunks that
        differ in case or closing marks only are encoded once. Chunks that may hold special tokens are left whole.
        """
        extra, one = {}, self.one
        for w in new:
            low = w.lower() if b"<|" not in w else w
            core = low.rstrip(MARKS)
            if len(core) < len(low) and core[-1:].isalnum() and b"<|" not in w:
                ids = (self.get(core) or one(core)) + (self.get(low[len(core) :]) or one(low[len(core) :]))
            else:
                ids = self.get(low) or one(low)
            if len(w) <= CACHE_BYTES:
                self[w] = ids
            else:
                extra[w] = ids
        return extra

    def one(self, chunk: bytes) -> bytes:
        """Ids of a chunk. Plain Latin words need no splitting and go straight to the merges."""
        word = chunk.decode()
        low = word.lower()
        if LATIN.fullmatch(low):
            found = [t.id for t in self.merge(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS))]
        else:
            found = self.encode(word, add_special_tokens=False).ids
        ids = array("I", found).tobytes()
        if len(chunk) <= CACHE_BYTES:
            self[chunk] = ids
        return ids


_known: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token pieces of each row; a null text is empty and has the end id only."""
    end, step = np.array([end_id], dtype="<u4").tobytes(), capacity * 4

    def run(batches):
        tokens = _known.get(tokenizer) or _known.setdefault(tokenizer, WordTokens(tokenizer))
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                at, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(tokens.ids(part.column(1).to_pylist(), end)):
                    for j, a in enumerate(range(0, len(ids), step)):
                        x = ids[a : a + step]
                        at.append(k)
                        piece.append(j)
                        start.append(a // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col).alias("id"), col(text_col).alias("t")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset).

    Ranks first..first+ranks-1 of that length go to as many consecutive sequences, each at the offset.
    """
    free: list[int] = []  # distinct free spaces of open bins, sorted
    bins: dict[int, list[tuple[int, int]]] = {}  # free space -> intervals (first sequence, number)
    slots, sequences = [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if room:
            if room not in bins:
                bins[room] = []
                insort(free, room)
            bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room], free[at]
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            deep = room // length
            full = min(n, left // deep)  # bins that take as many as fit; one more may take the rest
            some = min(n - full, 1) and min(left - full * deep, deep - 1)
            for layer in range(deep if full else 0):
                slots.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            for layer in range(some):
                slots.append((length, rank, 1, first + full, capacity - room + layer * length))
                rank += 1
            left -= full * deep + some
            if full:
                put_back(room - deep * length, first, full)
            if some:
                put_back(room - some * length, first + full, 1)
            if (rest := n - full - (some > 0)) > 0:
                put_back(room, first + full + (some > 0), rest)
    return slots


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(<id>, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each row of docs.

    Cases: null and empty texts are one piece, the end id; only documents longer than the capacity are cut;
    repeated rows and null ids are packed like others (pieces of equal length are interchangeable, ties are
    ordered by id, piece and checksum); an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = staged(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "packing-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = min(max(16, sum(counts.values()) // BUCKET_ROWS), 65_536)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(
        rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-base"
    )
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("rn", F.row_number().over(within)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("rn") - 1)
    slots = plan(counts, capacity)
    planned = spark.createDataFrame(slots, "slot_length long, first_rank long, ranks long, first_sequence long, offset long")
    planned = planned.withColumn("slot_stretch", F.explode(F.expr(f"sequence(first_rank div {RANKS}, (first_rank + ranks - 1) div {RANKS})")))
    hit = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    ranked = ranked.withColumn("stretch", F.expr(f"rank div {RANKS}"))
    placed = ranked.join(planned, (F.col("length") == F.col("slot_length")) & (F.col("stretch") == F.col("slot_stretch")) & hit)
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
