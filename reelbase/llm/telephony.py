"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV containers.

Companded samples are expanded by 256-entry lookup tables that are built from G.711's rule. ADPCM is a recurrence
along a block but blocks are independent, so numpy steps through the nibbles of all blocks of many files at once.
Decoded audio is resampled and stored as 16-bit PCM WAV; features are read from what is stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, staged

#: WAVE format tags (fixed values of the format).
PCM, ALAW, MULAW, IMA_ADPCM = 0x0001, 0x0006, 0x0007, 0x0011

#: IMA ADPCM step sizes and index changes (fixed values of the format).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
     337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
     5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, low = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    magnitude = np.where(step == 0, low, (low + 0x100) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: all blocks at once, one nibble after the other; a cut last block is zero-padded."""
    if not data or block < 5:
        return np.zeros(0, dtype=np.int16)
    n = -(-len(data) // block)
    x = np.frombuffer(data.ljust(n * block, b"\0"), dtype=np.uint8).reshape(n, block)
    value = x[:, :2].copy().view("<i2").ravel().astype(np.int32)
    at = np.minimum(x[:, 2], 88).astype(np.int32)
    out = np.empty((n, 1 + 2 * (block - 4)), dtype=np.int16)
    out[:, 0] = value
    for k in range(2 * (block - 4)):
        nibble = (x[:, 4 + k // 2] >> (4 * (k & 1))) & 15
        step = STEPS[at]
        change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        at = np.clip(at + INDEX[nibble & 7], 0, 88)
        out[:, 1 + k] = value
    return out.ravel()


def wav(data: bytes, tag: int, rate: int, block: int = 1) -> bytes:
    """A mono WAV file around coded data; ``block`` is the block size of ADPCM."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(tag, 8)
    align = {PCM: 2, IMA_ADPCM: block}.get(tag, 1)
    per_block = 1 + 2 * (block - 4) if tag == IMA_ADPCM else 1
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per_block, align, bits)
    if tag == IMA_ADPCM:
        fmt += struct.pack("<HH", 2, per_block)
    elif tag != PCM:
        fmt += struct.pack("<H", 0)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != PCM:
        body += b"fact" + struct.pack("<II", 4, -(-len(data) // block) * per_block if tag == IMA_ADPCM else len(data))
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block size, coded data) of a mono WAV file; raises ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1:
                raise ValueError(f"{channels} channels, not one")
            if not rate:
                raise ValueError("a sample rate of zero")
            head = (tag, rate, align)
        elif kind == b"data" and head:
            return (*head, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def expand_all(coded: list[tuple[int, int, bytes] | None]) -> list[np.ndarray | None]:
    """Samples of (tag, block size, data) each; ADPCM blocks of one size are decoded together, across files."""
    out = [expand(*x) if x and x[0] != IMA_ADPCM else None for x in coded]
    sizes = {x[1] for x in coded if x and x[0] == IMA_ADPCM}
    for block in sizes:
        which = [k for k, x in enumerate(coded) if x and x[:2] == (IMA_ADPCM, block)]
        if block < 5:
            for k in which:
                out[k] = np.zeros(0, dtype=np.int16)
            continue
        n = [-(-len(coded[k][2]) // block) for k in which]
        flat = decode_adpcm(b"".join(coded[k][2].ljust(m * block, b"\0") for k, m in zip(which, n)), block)
        ends = np.cumsum([0, *n]) * (1 + 2 * (block - 4))
        for k, a, b in zip(which, ends, ends[1:]):
            out[k] = flat[a:b]
    return out


def expand(tag: int, block: int, data: bytes) -> np.ndarray:
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(data, dtype=np.uint8)]
    if tag == IMA_ADPCM:
        return decode_adpcm(data, block)
    if tag == PCM:
        return np.frombuffer(data[: len(data) & ~1], dtype="<i2").astype(np.int16)
    raise ValueError(f"format tag {tag} is not a telephony format")


def chosen_coding(payload: bytes) -> int:
    """One of the three codings by the payload's checksum: equal payloads are coded alike."""
    return (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]


def resampled(pcm: np.ndarray, rate: int, to: int):
    """Linear interpolation to another rate, in chunks of bounded size."""
    n = len(pcm) * to // rate
    for a in range(0, n, 1 << 18):
        at = np.arange(a, min(n, a + (1 << 18))) * rate
        i, part = at // to, at % to
        left, right = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
        yield ((left * (to - part) + right * part) // to).astype(np.int16)


def features(pcm_parts) -> str:
    """samples:energy:peak:zero crossings, in whole numbers."""
    n = energy = peak = crossings = 0
    last = None
    for x in pcm_parts:
        wide = x.astype(np.int64)
        n, energy, peak = n + len(x), energy + int((wide * wide).sum()), max(peak, int(np.abs(wide).max(initial=0)))
        sign = x < 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + (last is not None and len(x) > 0 and bool(sign[0]) != last)
        last = bool(sign[-1]) if len(x) else last
    return f"{n}:{energy}:{peak}:{crossings}"


def encode_payload(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: int | None = None, rate: int = 16000, block: int = 64) -> DataFrame:
    """(<id>, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as coded samples of a WAV file.

    Without a tag the coding follows from the payload.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                payloads = [x + b"\0" * ((-len(x)) % 64 if x else 64) for x in raw]
                media = [wav(x, chosen_coding(x) if tag is None else tag, rate, block) for x in payloads]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col).alias("id"), col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


#: Files and bytes of files that are decoded together.
GROUP_FILES, GROUP_BYTES = 64, 1 << 20


def groups(column: pa.Array):
    """(start, end) of runs of rows of bounded number and size; a larger file is alone."""
    start = size = 0
    for k, x in enumerate(column):
        n = len(x.as_buffer()) if x.is_valid else 0
        if k > start and (k - start >= GROUP_FILES or size + n > GROUP_BYTES):
            yield start, k
            start, size = k, 0
        size += n
    if len(column):
        yield start, len(column)


def to_pcm(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", rate: int = 8000, digests: bool = False) -> DataFrame:
    """(<id>, pcm, error): mono telephony WAV files as resampled 16-bit PCM WAV; what can't be decoded (or is null) has a null pcm and an error.

    With digests also payload_bytes, payload_sha256, tail_crc32, media_bytes and media_sha256 of what was read.
    """
    more = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"] if digests else []

    def run(batches):
        for b in batches:
            for s, e in groups(b.column(1)):
                part, coded, heads, error, rows = b.slice(s, e - s), [], [], [], []
                files = part.column(1).to_pylist()
                for m in files:
                    try:
                        tag, own, block, data = parse_wav(m or b"")
                        if tag not in (PCM, IMA_ADPCM, *TABLES):
                            raise ValueError(f"format tag {tag} is not a telephony format")
                        coded.append((tag, block, data))
                        heads.append(own)
                        error.append(None)
                    except (ValueError, struct.error) as x:
                        coded.append(None)
                        heads.append(0)
                        error.append(str(x))
                pcm = [None if x is None else wav(b"".join(p.astype("<i2").tobytes() for p in resampled(x, own, rate)), PCM, rate) for x, own in zip(expand_all(coded), heads)]
                out = [part.column(0), pa.array(pcm, pa.binary()), pa.array(error, pa.string())]
                if digests:
                    for m, c in zip(files, coded):
                        data = c[2] if c else b""
                        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m or b""), hashlib.sha256(m or b"").hexdigest()))
                    out += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                out += [part.column(k) for k in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays(out, names=["id", "pcm", "error", *more, *part.schema.names[2:]])

    types = dict(media.dtypes)
    rest = [c for c in ("n_bytes",) if digests]
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string"}
    out = ", ".join([f"id {types[id_col]}, pcm binary, error string", *(f"{c} {kinds[c]}" for c in more), *(f"{c} {types[c]}" for c in rest)])
    return media.select(col(id_col).alias("id"), col(media_col).alias("m"), *rest).mapInArrow(run, out).withColumnRenamed("id", id_col)


def with_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Stored PCM (to_pcm with digests) with the audio's features in place of the PCM."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                feature = []
                for m in part.column(0).to_pylist():
                    _, _, block, data = parse_wav(m)
                    feature.append(features(np.split(x, range(1 << 18, len(x), 1 << 18)) if len(x := expand(PCM, block, data)) else []))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(feature, pa.string())], names=[*part.schema.names[1:], "feature"])

    kept = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    types = dict(stored.dtypes)
    x = stored.select("pcm", col(id_col).alias("id"), *kept)
    return x.mapInArrow(run, ", ".join([f"id {types[id_col]}", *(f"{c} {types[c]}" for c in kept), "feature string"])).withColumnRenamed("id", id_col)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: int | None = None) -> DataFrame:
    """Texts as coded media in the shared folder, these reread and stored as resampled PCM, features read from that."""
    media = staged(encode_payload(docs, id_col, text_col, tag), "telephony-media")
    pcm = staged(to_pcm(media, id_col, digests=True).drop("error"), "telephony-pcm")
    discard(media)
    return with_features(pcm, id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Every text stored as telephony audio, a third each mu-law, A-law and ADPCM, in the shared folder and read back.

    Null texts are empty and, like empty ones, 64 zero bytes; repeated rows, ties and null ids come back as they
    came in; an empty table gives no rows; other columns are ignored.
    """
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
