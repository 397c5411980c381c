"""Embedding whitening from an exact scatter matrix, computed in residues.

Each entry c becomes the whole number x = floor(64 c) + 1,000,000. With n vectors and the sums S of their entries, y = n x - S
is centred and whole, and the scatter matrix of y is n^3 times the covariance. It is computed exactly: every partition
multiplies its y modulo several primes below 2^20 (products of blocks of 4,096 rows stay below 2^53, so double-precision matrix
products have no rounding), Spark adds the residues by cell, and the Chinese remainder theorem gives the whole numbers. The
number of primes follows from a bound on the sums, so it grows with the logarithm of n. The driver handles d (d + 1) / 2 cells
for d dimensions, whatever the rows. The covariance's eigenvectors are found twice, the second time in the basis of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, table

SCALE, SHIFT = 64, 1_000_000
#: Size of entries from which x couldn't be told exactly; they count as not finite.
LIMIT = 2.0**46
ROWS = 4096


def primes(product: int, below: int = 1 << 20) -> list[int]:
    """The largest primes under ``below``, as many as make the product."""
    sieve = np.ones(below, dtype=bool)
    sieve[:2] = False
    for k in range(2, int(below**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    out, so_far = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if so_far > product:
            return out
        out.append(p)
        so_far *= p
    raise ValueError("the scatter matrix's entries are too large")


def whole_numbers(lists: pa.Array, d: int) -> np.ndarray:
    c = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.column(0).slice(at, ROWS), b.column(1).slice(at, ROWS)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows whose vector has entries, all of them finite."""
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LIMIT), F.lit(False)))
    return vectors.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def sums_of(rows: DataFrame) -> DataFrame:
    """(d, j, n, hi, lo, least, most) by length and dimension: x summed in two halves, so that no sum overflows."""

    def run(batches):
        held: dict[int, list] = {}
        for _, v in blocks(batches):
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                x = whole_numbers(v.filter(pa.array(sizes == d)), d)
                now = [len(x), (x >> 26).sum(0), (x & (1 << 26) - 1).sum(0), x.min(0), x.max(0)]
                if d in held:
                    was = held[d]
                    now = [was[0] + now[0], was[1] + now[1], was[2] + now[2], np.minimum(was[3], now[3]), np.maximum(was[4], now[4])]
                held[d] = now
        for d, (n, *rest) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), *map(pa.array, rest)], names=["d", "j", "n", "hi", "lo", "least", "most"])

    parts = rows.mapInArrow(run, "d long, j long, n long, hi long, lo long, least long, most long")
    return parts.groupBy("d", "j").agg(*[F.sum(c).alias(c) for c in ("n", "hi", "lo")], F.min("least").alias("least"), F.max("most").alias("most"))


def scatter(rows: DataFrame, d: int, n: int, s: list[int], spread: int) -> list[list[int]]:
    """The exact sums of (n x - S)_i (n x - S)_j over all rows."""
    ps = primes(2 * n * (n * spread) ** 2)
    residue = [(p, n % p, np.array([k % p for k in s])) for p in ps]
    upper = np.triu_indices(d)

    def run(batches):
        total = [np.zeros(len(upper[0]), dtype=np.int64) for _ in ps]
        for _, v in blocks(batches):
            x = whole_numbers(v, d)
            for k, (p, n_p, s_p) in enumerate(residue):
                r = ((x % p) * n_p - s_p) % p
                r = np.where(r > p // 2, r - p, r).astype(np.float64)
                total[k] = (total[k] + (r.T @ r)[upper].astype(np.int64)) % p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), *map(pa.array, total)], names=["cell", *[f"r{k}" for k in range(len(ps))]])

    names = [f"r{k}" for k in range(len(ps))]
    parts = rows.select("id", "v").mapInArrow(run, ", ".join(f"{c} long" for c in ("cell", *names)))
    cells = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).toArrow().to_pydict()  # d (d + 1) / 2 rows
    whole = 1
    for p in ps:
        whole *= p
    lift = [whole // p * pow(whole // p, -1, p) for p in ps]
    out = [[0] * d for _ in range(d)]
    for c, *rs in zip(cells["cell"], *[cells[k] for k in names], strict=True):
        t = sum(int(r) * f for r, f in zip(rs, lift, strict=True)) % whole
        i, j = int(upper[0][c]), int(upper[1][c])
        out[i][j] = out[j][i] = t - whole if 2 * t > whole else t
    return out


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; found again in their own basis, each with its largest entry positive."""
    _, q = np.linalg.eigh(v)
    again = (q.T.astype(np.longdouble) @ v.astype(np.longdouble) @ q.astype(np.longdouble)).astype(np.float64)
    e, r = np.linalg.eigh((again + again.T) / 2)
    q = (q @ r)[:, ::-1]
    return e[::-1], q * np.sign(q[np.abs(q).argmax(0), np.arange(len(q))])


class Whitener:
    """What the rows of a fitted table need: sums, and the map to whitened components."""

    def __init__(self, d: int, n: int, s: list[int], e: np.ndarray, q: np.ndarray, top: int):
        self.d, self.n = d, n
        self.mean = np.array([k // n for k in s], dtype=np.int64)
        self.rest = np.array([k % n for k in s], dtype=np.int64)
        enough = e > max(float(e.sum()), 0.0) * d * 2.0**-50  # components without variance can't be scaled
        self.count = int(min(top, enough.sum()))
        self.map = q[:, : self.count] / np.sqrt(e[: self.count])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.mean - self.rest / self.n

    def components(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.map

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2, exact; null where they exceed a long."""
        about = ((self.centred(x) * self.n) ** 2).sum(1)
        with np.errstate(over="ignore"):
            y = self.n * (x - self.mean) - self.rest
            exact = (y * y).view(np.uint64).sum(1, dtype=np.uint64)  # the true sum is below 2^64 where it counts
        fits = (about < 2.0**63 * 1.5) & (exact < 2**63)
        return pa.array(exact.view(np.int64), mask=~fits)


def fit(rows: DataFrame, top: int) -> tuple[Whitener, np.ndarray] | None:
    """The whitener of (id, v) and the components' shares of the variance; None for a table without usable vectors."""
    found = sums_of(rows).groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "hi", "lo", "least", "most"))).alias("x")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not found:
        return None
    (d, n, of), = found
    s = [(r.hi << 26) + r.lo for r in of]
    spread = max(1, *(r.most - r.least for r in of))
    t = scatter(rows.where(F.size("v") == d), d, n, s, spread)
    cube = n**3
    e, q = eigen(np.array([[c / cube for c in r] for r in t]))
    trace = sum(t[k][k] for k in range(d)) / cube
    w = Whitener(d, n, s, e, q, top)
    return w, e[: w.count] / (trace or 1.0)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    upper = np.triu_indices(w.count)

    def run(batches):
        total, sums = np.zeros((w.count, w.count)), np.zeros(w.count)
        for _, v in blocks(batches):
            z = w.components(whole_numbers(v, w.d))
            total += z.T @ z
            sums += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + w.count)), pa.array(np.append(total[upper], sums))], names=["cell", "x"])

    cells = rows.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").toArrow()["x"].to_numpy() / w.n
    got, mean = np.zeros((w.count, w.count)), cells[len(upper[0]) :]
    got[upper] = cells[: len(upper[0])]
    return float(np.abs(got[upper] - (np.outer(mean, mean) + np.eye(w.count))[upper]).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 32) -> DataFrame:
    """(<id>, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and each of the first components.

    Cases: rows whose vector is null, empty or has null or non-finite entries (or entries of 2^46 or more) are left out; if lengths
    differ, the commonest is used (of equally common ones the longest) and other vectors are left out, too; repeated rows and null ids
    stay and count; components without variance, as of equal vectors, are left out; an empty table gives no rows; ``deviation`` is
    null where it exceeds a long; other columns are ignored, whatever their names.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, id_col, vec_col)
    fitted = fit(rows, top)
    if not fitted or not fitted[0].count:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    w, explained = fitted
    rows = rows.where(F.size("v") == w.d)
    error = identity_error(rows, w)

    def run(batches):
        for ids, v in blocks(batches):
            x = whole_numbers(v, w.d)
            size, row = len(x) * w.count, pa.array(np.repeat(np.arange(len(x)), w.count))
            columns = [
                ids.take(row), pa.array(np.tile(np.arange(1, w.count + 1, dtype=np.int32), len(x))), pa.array(np.full(size, w.n)), w.deviations(x).take(row),
                pa.array(w.components(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
