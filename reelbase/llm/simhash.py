"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints within
``max_bits`` of each other are linked, and documents reachable over links form a component.

The 64 bits are grouped into m partitions, correlated bits together. If every pair of partitions' distances
exceeded its thresholds T_p with sum(T_p) = max_bits - m + 1, the total would exceed max_bits; so each pair of
near fingerprints is within T_p in some partition p. m and the unequal T_p come from dynamic programming over
candidate counts that are estimated from the joint bit frequencies of all fingerprints. Each fingerprint is stored under its own partition
values and probes all values within T_p of them; what meets under a value is verified on all 64 bits.

Only distinct fingerprints are compared: copies join their class by equality. A value under which more than
``block`` fingerprints meet is split into a grid of block pairs, so no task holds a whole hot value, and every
task passes on a spanning forest of the links it found, never the pairs. Components are found by min-label
propagation with pointer jumping over staged tables; nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, staged

BITS = 64
#: Relative costs for the plan: a probe row that is shuffled, against one comparison of two fingerprints.
PROBE_COST = 300.0


# --------------------------------------------------------------------------- fingerprints
def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text; no word (or null) gives zero.

    A-Z are lower-cased and words are runs of characters other than ASCII white space; a text of fewer
    than ``words`` words is one shingle. Bit i is set if it is set in over half of the shingles' hashes.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row per input row; fp holds the fingerprint's 64 bits as a signed BIGINT."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_of(t, words, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col).alias("id"), col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


# --------------------------------------------------------------------------- the plan
def group_bits(joint: np.ndarray, n: float, m: int) -> list[list[int]]:
    """Group 64 bits into m parts of nearly equal size, strongly correlated bits together (greedy)."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        first = max(left, key=lambda i: (corr[i, sorted(left)].sum(), -i))
        part = [first]
        left.discard(first)
        while len(part) < size:
            best = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def distance_law(joint: np.ndarray, n: float, bits: list[int]) -> np.ndarray:
    """P(distance = d) over the bits for two fingerprints drawn alike.

    The distance's mean and variance follow from the joint frequencies; bits that go together spread it, so that
    more pairs agree in all of them. A beta-binomial law has that mean and variance, the binomial law if nothing is spread.
    """
    w, p = len(bits), np.diag(joint)[bits] / max(n, 1)
    both = joint[np.ix_(bits, bits)] / max(n, 1)
    differ = 2 * p * (1 - p)
    one = p[:, None] - both
    pair = 2 * both * np.maximum(1 - p[:, None] - p[None, :] + both, 0) + 2 * one * one.T  # both bits differ
    np.fill_diagonal(pair, differ)
    mean = differ.sum()
    variance = pair.sum() - mean**2
    rate = min(max(mean / w, 1e-6), 1 - 1e-6)
    spread = (variance / (w * rate * (1 - rate)) - 1) / max(w - 1, 1)
    if spread < 1e-3:
        return np.array([comb(w, d) * rate**d * (1 - rate) ** (w - d) for d in range(w + 1)])
    a, b = (x * (1 / min(spread, 0.999) - 1) for x in (rate, 1 - rate))
    beta = lambda u, v: lgamma(u) + lgamma(v) - lgamma(u + v)
    return np.array([exp(log(comb(w, d)) + beta(d + a, w - d + b) - beta(a, b)) for d in range(w + 1)])


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds T_p >= -1 with sum(T_p) = total and least summed costs; costs[p][t + 1] is the cost of T_p = t."""
    m = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for j, x in enumerate(row):
                if (k := used + j) not in new or c + x < new[k][0]:
                    new[k] = (c + x, [*ts, j - 1])
        best = new
    return best.get(total + m, (float("inf"), []))


def plan_partitions(joint: np.ndarray, n: int, max_bits: int, counts=(2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest allocation; partitions with threshold -1 are left out."""
    pairs = n * (n - 1) / 2.0
    best: tuple[float, list] = (float("inf"), [])
    for m in [c for c in counts if c <= max_bits + 1] or [1]:
        parts = group_bits(joint, n, m)
        total = max_bits - m + 1
        costs = []
        for bits in parts:
            law, row, ball = distance_law(joint, n, bits), [0.0], 0
            for t in range(total + m):
                ball += comb(len(bits), t)
                near = min(1.0, law[: t + 1].sum()) if t < len(law) else 1.0
                row.append(pairs * near + PROBE_COST * n * ball)
            costs.append(row)
        cost, ts = allocate(costs, total)
        if cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(parts, ts) if t >= 0])
    return best[1]


def bit_counts(classes: DataFrame) -> tuple[np.ndarray, int]:
    """Joint bit frequencies (64 x 64) and the number of distinct fingerprints, over all of them."""

    def run(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for b in batches:
            x = _unpack(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(total[i, j], n))], names=["cell", "n"]
        )

    rows = classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 2,081 rows
    joint, n = np.zeros((BITS, BITS)), 0
    for cell, x in rows:
        if cell < 0:
            n = x
        else:
            joint[cell // BITS, cell % BITS] = joint[cell % BITS, cell // BITS] = x
    return joint, n


def _unpack(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


# --------------------------------------------------------------------------- probing and verifying
def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n nodes over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(fp: np.ndarray, role: np.ndarray, group: np.ndarray, diagonal: np.ndarray, max_bits: int):
    """Index pairs of near fingerprints within runs of equal ``group``.

    Roles: 0 row, 1 column. Rows meet columns; in a cell on the diagonal rows also meet rows.
    """
    size = len(fp)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lengths = np.diff(np.append(starts, size))
    left, right = [], []
    small = lengths <= 48
    run = np.repeat(np.arange(len(starts)), lengths)
    is_small = small[run]
    for d in range(1, int(lengths[small].max(initial=1))):
        i = np.flatnonzero(is_small[:-d] & (run[:-d] == run[d:]))
        if not len(i):
            break
        j = i + d
        ok = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_bits) & ((role[i] + role[j] == 1) | (diagonal[i] & (role[i] + role[j] == 0)))
        left.append(i[ok])
        right.append(j[ok])
    for s, k in zip(starts[~small], lengths[~small]):
        rows = s + np.flatnonzero(role[s : s + k] == 0)
        cols = s + np.flatnonzero(role[s : s + k] == 1)
        others = np.concatenate((cols, rows)) if diagonal[s] else cols
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            near = np.bitwise_count((fp[part][:, None] ^ fp[others][None, :]).view(np.uint64)) <= max_bits
            i, j = np.nonzero(near)
            left.append(part[i])
            right.append(others[j])
            if len(i) > 65536:  # keep a spanning forest only
                a, b = part[i], others[j]
                nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
                root = _local_roots(inv[: len(a)], inv[len(a) :], len(nodes))
                left[-1], right[-1] = nodes, nodes[root]
    return np.concatenate(left or [np.array([], dtype=int)]), np.concatenate(right or [np.array([], dtype=int)])


def links(classes: DataFrame, max_bits: int = 4, block: int = 512) -> DataFrame:
    """(u, v): links between distinct fingerprints whose reachability equals that of all links within max_bits."""
    spark = classes.sparkSession
    joint, n = bit_counts(classes)
    if n < 2:
        return spark.createDataFrame([], "u long, v long")
    parts = plan_partitions(joint, n, max_bits)
    shifts = []
    for bits, t in parts:
        at = np.array([1 << k for k in range(len(bits))], dtype=np.uint64)
        flips = [0] + [sum(1 << k for k in c) for d in range(1, t + 1) for c in combinations(range(len(bits)), d)]
        shifts.append((bits, t, at, np.array(flips, dtype=np.uint64)))

    def emit(batches):
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, len(whole), 4096):
                fps = whole[s : s + 4096]
                x = _unpack(fps).astype(np.uint64)
                for p, (bits, _, at, flips) in enumerate(shifts):
                    own = x[:, bits] @ at
                    values = (own[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    probe = np.tile(np.arange(len(flips)) > 0, len(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), p)), pa.array(values), pa.array(np.repeat(fps, len(flips))), pa.array(probe)],
                        names=["part", "value", "fp", "probe"],
                    )

    keys = staged(classes.select("fp").mapInArrow(emit, "part long, value long, fp long, probe boolean"), "simhash-keys")
    hot = staged(
        keys.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > block).select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("nb")),
        "simhash-hot",
    )
    asym = [p for p, (_, t, _, _) in enumerate(shifts) if t > 0]
    b, nb = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb")).cast("int"), F.col("nb")
    every = F.sequence(F.lit(0), nb - 1)
    cell = lambda r, c, role: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), F.lit(role).alias("role"))
    as_row = F.transform(F.filter(every, lambda c: F.col("part").isin(asym) | (c >= F.col("b"))) if asym else F.filter(every, lambda c: c >= F.col("b")), lambda c: cell(F.col("b"), c, 0))
    as_col = F.transform(F.filter(every, lambda r: F.col("probe") | (r < F.col("b"))), lambda r: cell(r, F.col("b"), 1))
    cells = F.when(F.col("probe"), as_col).otherwise(F.concat(as_row, as_col))
    plain = keys.join(hot, ["part", "value"], "left_anti").select("part", "value", "fp", F.lit(0).alias("r"), F.lit(0).alias("c"), F.col("probe").cast("int").alias("role"))
    split = keys.join(hot, ["part", "value"]).withColumn("b", b).select("part", "value", "fp", F.explode(cells).alias("x")).select("part", "value", "fp", "x.r", "x.c", "x.role")
    met = plain.unionByName(split)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = met.repartition(width, "part", "value", "r", "c").sortWithinPartitions("part", "value", "r", "c")

    def verify(batches):
        rest = None
        for b in _until_end(batches):
            if b is None:
                now, rest = rest, None
            else:
                now = b if rest is None else [np.concatenate((x, y)) for x, y in zip(rest, b)]
                same = np.ones(len(now[0]), dtype=bool)
                for c in (0, 1, 3, 4):
                    same &= now[c] == now[c][-1]
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                now, rest = [x[:cut] for x in now], [x[cut:] for x in now]
            if now is None or len(now[0]) < 2:
                continue
            part, value, fp, r, c, role = now
            change = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])
            group = np.append(0, np.cumsum(change))
            i, j = _linked(fp, role, group, r == c, max_bits)
            u, v = fp[i], fp[j]
            if (apart := u != v).any():
                u, v = u[apart], v[apart]
                nodes, inv = np.unique(np.concatenate((u, v)), return_inverse=True)
                root = _local_roots(inv[: len(u)], inv[len(u) :], len(nodes))
                keep = root != np.arange(len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])

    return dealt.mapInArrow(verify, "u long, v long")


def _until_end(batches):
    for b in batches:
        if b.num_rows:
            yield [c.to_numpy(zero_copy_only=False) for c in b.columns]
    yield None


# --------------------------------------------------------------------------- components
def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the edges with the least node that it reaches. Tables of past rounds are removed."""
    both = staged(edges.union(edges.select("v", "u")).toDF("u", "v").distinct(), "simhash-edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")), "simhash-labels")
    while True:
        near = both.join(labels.select("node", "label"), both.v == labels.node).groupBy("u").agg(F.min("label").alias("low"))
        mixed = staged(
            labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label")), "simhash-mixed"
        )
        up = mixed.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = staged(mixed.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), "old"), "simhash-labels")
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        discard(labels, mixed)
        labels = new
        if not changed:
            discard(both)
            return labels.select("node", "label")


def class_labels(fps: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(fp, rep, label): each distinct fingerprint of (id, fp) with its least id and the least fingerprint that it reaches."""
    classes = staged(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    labels = component_labels(staged(links(classes, max_bits, block), "simhash-links"))
    of = classes.join(labels, classes.fp == labels.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    return staged(of, "simhash-of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, block: int = 512, seed: int = 42) -> DataFrame:
    """(<id>, fingerprint, component_id) for every row of docs.

    component_id is the smallest id among documents reachable over links of at most ``max_bits`` differing
    bits, the document itself included. Cases: null and empty texts (and white space) have fingerprint zero
    and link like any other; repeated rows come back as often as they came in; null ids are ignored by the
    minimum, and a component of null ids only has a null component_id; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    fps = staged(fingerprints(docs, id_col, text_col, words, seed), "simhash-fps")
    of = class_labels(fps, max_bits, block)
    least = staged(of.groupBy("label").agg(F.min("rep").alias("component_id")), "simhash-least")
    final = staged(of.join(least, "label").select("fp", "component_id"), "simhash-final")
    return fps.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, block: int = 512, seed: int = 42) -> DataFrame:
    """Docs with one document of each near-duplicate component; same columns.

    The row with the smallest id stays; of rows that share it the one with the smallest fingerprint, then the first
    read. Rows with null ids come last, so one stays only where its component has no id. Cases otherwise as above.
    """
    rows = numbered(docs, id_col, text_col)
    fps = staged(fingerprints(rows.withColumn("key", F.struct("id", "uid")), "key", "t", words, seed).select("id.*", "fp"), "simhash-fps")
    of = class_labels(fps, max_bits, block)
    return one_of_labels(docs, rows, fps.join(of.select("fp", "label"), "fp"), "fp", id_col, text_col)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, rest, uid): docs staged with a number for each row; rest is a struct of the columns besides id and text."""
    rest = [col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    x = docs.select(col(id_col).alias("id"), col(text_col).alias("t"), F.struct(*rest or [F.lit(0).alias("none")]).alias("rest"))
    return staged(x.withColumn("uid", F.monotonically_increasing_id()), "numbered-rows")


def one_of_labels(docs: DataFrame, rows: DataFrame, labels: DataFrame, text_key: str, id_col: str, text_col: str) -> DataFrame:
    """Of rows (docs, numbered) the first of each label of (id, uid, label, <text_key>), with docs' columns."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", text_key, "uid")).alias("first")
    keep = staged(labels.groupBy("label").agg(first).select("first.uid"), "numbered-keep")
    # a merge join at every size: were small tables broadcast, cost would jump where they outgrow that
    kept = rows.join(keep.hint("merge"), "uid", "left_semi")
    of = {c: f"rest.c{k}" for k, c in enumerate(docs.columns)} | {id_col: "id", text_col: "t"}
    return kept.select(*[F.col(of[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
