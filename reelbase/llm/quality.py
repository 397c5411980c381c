"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is
half of |sum v_i x_i|^2 - sum |v_i x_i|^2, so a text is scored in time linear in its inputs. Inputs are a text's
distinct words (hashed, each of weight 1 / sqrt(number of them)), its structure statistics and given metadata
columns (both in bins, of weight 1). It is trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, held_out, staged, table

WORDS = 1 << 15
BINS = 12
UPPER, DIGITS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>!?=_~^@+/\\{}[]"
STATS = ("words", "distinct", "adjacent", "dup_lines", "symbols", "upper", "digits", "word_length", "line_length", "top_word")
FACTORS = 6
#: Labelled rows that the classifier is trained on, at most.
SAMPLE_ROWS = 6000
#: Distinct words of all these rows together, at most; a row with over a hundredth of that many is left out of training.
SAMPLE_WORDS = 12_000_000


def bin_of(share: float) -> int:
    """Bins of a share in [0, 1]: 0, then doubling from 1/512."""
    return 0 if share <= 0 else min(BINS - 1, max(1, int(math.log2(share * 1024)) + 1))


def inputs(text: str | None, metadata=()) -> tuple[np.ndarray, list[int]]:
    """(hashed distinct words, active bins) of a text; bins lie above WORDS. Metadata that isn't finite counts as null."""
    raw = (text or "").encode()
    words = raw.split()
    distinct = Counter(words)
    n, size = len(words), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x]
    without = lambda chars: 1 - len(raw.translate(None, chars)) / size if raw else 0.0
    top = max(distinct.values(), default=0)
    values = (
        min(BINS - 1, n.bit_length()),
        bin_of(1 - len(distinct) / n) if n else 0,
        bin_of(sum(map(eq, words, words[1:])) / n) if n else 0,
        bin_of(1 - len(set(lines)) / len(lines)) if lines else 0,
        bin_of(without(SYMBOLS)),
        bin_of(without(UPPER)),
        bin_of(without(DIGITS)),
        min(BINS - 1, int(size / max(n, 1))),
        min(BINS - 1, (size // max(len(lines), 1)).bit_length()),
        bin_of(top / n) if n else 0,
    )
    bins = [WORDS + k * BINS + v for k, v in enumerate(values)]
    at = WORDS + len(STATS) * BINS
    for k, v in enumerate(metadata):
        v = 0 if v is None or isinstance(v, float) and not math.isfinite(v) else min(BINS - 1, 1 + int(abs(v)).bit_length() // 2) if isinstance(v, (int, float)) else 1 + zlib.crc32(str(v).encode()) % (BINS - 1)
        bins.append(at + k * BINS + v)
    hashed = np.fromiter(map(zlib.crc32, distinct), dtype=np.uint32, count=len(distinct)) % WORDS
    return hashed.astype(np.int32), bins


class Machine:
    def __init__(self, metadata: int = 0, factors: int = FACTORS, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = WORDS + (len(STATS) + metadata) * BINS
        self.bias, self.w = 0.0, np.zeros(n, dtype=np.float32)
        self.v = (0.02 * rng.standard_normal((n, factors))).astype(np.float32)
        self.scale, self.cut = 1.0, 0.0

    def raw(self, rows: list[tuple[np.ndarray, list[int]]]) -> tuple[np.ndarray, ...]:
        """Raw outputs, and the flat inputs that they came from."""
        at = np.concatenate([np.concatenate((a, b)) for a, b in rows]).astype(np.int64)
        lengths = np.array([len(a) + len(b) for a, b in rows])
        x = np.concatenate([np.concatenate((np.full(len(a), 1 / math.sqrt(max(len(a), 1))), np.ones(len(b)))) for a, b in rows]).astype(np.float32)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        z = self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return z, at, x, np.repeat(np.arange(len(rows)), lengths), sums

    def fit(self, rows, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        gw, gv, gb = np.full_like(self.w, 1e-4), np.full_like(self.v, 1e-4), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                z, at, x, of, sums = self.raw([rows[i] for i in part])
                g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                gx = g[of] * x
                used, inv = np.unique(at, return_inverse=True)
                dw = np.bincount(inv, gx, len(used)) + decay * self.w[used]
                inner = gx[:, None] * (sums[of] - self.v[at] * x[:, None])
                dv = np.stack([np.bincount(inv, inner[:, f], len(used)) for f in range(inner.shape[1])], axis=1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                gb += g.sum() ** 2
                self.w[used] -= (rate * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (0.5 * rate * dv / np.sqrt(gv[used])).astype(np.float32)
                self.bias -= rate * g.sum() / math.sqrt(gb)

    def score(self, rows) -> np.ndarray:
        z = self.raw(rows)[0] if rows else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * (z - self.cut) + math.log(0.3 / 0.7), -30, 30)))


def best_cut(z: np.ndarray, y: np.ndarray, balanced: bool = True) -> float:
    """The raw output with the best balanced accuracy (or F1 of label 1) as a threshold, halfway to its neighbour."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    below = np.cumsum(y == 0), np.cumsum(y == 1)  # rows up to and with each, all called 0
    n = (y == 0).sum(), (y == 1).sum()
    hits = n[1] - below[1]
    gain = below[0] / max(n[0], 1) + hits / max(n[1], 1) if balanced else 2 * hits / np.maximum(hits + n[0] - below[0] + n[1], 1)
    k = np.flatnonzero(gain >= gain.max() - 1e-9)
    k = int(k[len(k) // 2])
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def labelled(labels: DataFrame, label: str, held: tuple[int, int], rows: int, id_col: str = "doc_id") -> DataFrame:
    """(y_id, y): a bounded sample of the labelled rows that aren't held out, in hashed order; an id's largest label counts."""
    x = labels.where(col(label).isNotNull() & col(id_col).isNotNull() & ~held_out(id_col, *held))
    return x.groupBy(col(id_col).alias("y_id")).agg(F.max(col(label)).cast("int").alias("y")).orderBy(F.xxhash64("y_id"), "y_id").limit(rows)


def last_within(marks: np.ndarray, sizes: np.ndarray, most: int) -> int:
    """The largest mark up to which, in the order of marks, the sizes add up to at most ``most``."""
    order = np.argsort(marks)
    fits = int(np.searchsorted(np.cumsum(sizes[order]), most, side="right"))
    return int(marks[order][fits - 1]) if fits else -(2**63)


def sample(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(y, id, t, m0...): the chosen (y_id, y) rows of docs; of rows that share an id the first in the order of text and metadata."""
    x = docs.select(col(id_col).alias("id"), F.struct(col(text_col).alias("t"), *[col(c).alias(f"m{k}") for k, c in enumerate(metadata)]).alias("row"))
    x = x.join(F.broadcast(chosen), F.col("id") == F.col("y_id"))  # chosen has a bounded number of rows
    return x.groupBy("y", "id").agg(F.min("row").alias("row")).select("y", "id", "row.*")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), held: tuple[int, int] = (5, 0), sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> Machine:
    """Train on at most sample_rows labelled rows of at most sample_words distinct words together, in hashed order.

    Without labels of both kinds the machine gives the same score to all.
    """
    x = sample(docs, labelled(labels, "quality", held, sample_rows, id_col), id_col, text_col, metadata).drop("id")

    def run(batches):
        for b in batches:
            rows = [inputs(t, m) for t, *m in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.tolist() for a, _ in rows], pa.list_(pa.int32())), pa.array([c for _, c in rows], pa.list_(pa.int32()))], names=["y", "words", "bins"])

    features = staged(x.mapInArrow(run, "y int, words array<int>, bins array<int>"), "quality-sample")
    size, mark = F.size("words"), F.xxhash64("y", "words", "bins")
    sizes = features.groupBy(mark.alias("mark")).agg(F.sum(size).alias("n"), F.max(size).alias("most")).where(F.col("most") <= sample_words // 100).select("mark", "n").toArrow()  # at most sample_rows
    last = last_within(sizes["mark"].to_numpy(), sizes["n"].to_numpy(), sample_words)
    found = features.where((size <= sample_words // 100) & (mark <= last)).toArrow()
    discard(features)
    words = pa.concat_arrays(found["words"].chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
    at, flat = words.offsets.to_numpy(), words.values.to_numpy()
    rows = [(flat[at[k] : at[k + 1]], b) for k, b in enumerate(found["bins"].to_pylist())]
    y = np.array(found["y"].to_pylist(), dtype=np.float64)
    # the sample comes back in any order: sort it, so that equal tables train equal machines
    order = sorted(range(len(rows)), key=lambda i: (y[i], len(rows[i][0]), zlib.crc32(rows[i][0][np.argsort(rows[i][0])].tobytes()), rows[i][1]))
    rows, y = [(np.sort(rows[i][0]), rows[i][1]) for i in order], y[order]
    m = Machine(len(metadata))
    if len(set(y)) < 2:
        return m
    for_cut = np.arange(len(y)) % 5 == 0
    m.fit([r for r, c in zip(rows, for_cut) if not c], y[~for_cut])
    z = m.raw(rows)[0]
    m.cut = best_cut(z[for_cut], y[for_cut]) if len(set(y[for_cut])) == 2 else best_cut(z, y)
    m.scale = 3.0 / max(float(np.std(z)), 1e-3)
    return m


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), held: tuple[int, int] = (5, 0), threshold: float = 0.3) -> DataFrame:
    """(<id>, held_out, score, predicted) for every row of docs.

    Cases: null and empty texts are scored as texts without words; null metadata has a bin of its own; repeated
    rows and null ids (never held out) are scored like others, equal inputs alike; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows = [inputs(t, m) for t, *m in zip(*(c.to_pylist() for c in part.columns[2:]))]
                p = machine.score(rows).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    x = docs.select(col(id_col).alias("id"), held_out(id_col, *held).alias("held_out"), col(text_col).alias("t"), *[col(c).alias(f"m{k}") for k, c in enumerate(metadata)])
    return x.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",)), metadata=("n_chars",))
