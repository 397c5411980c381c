"""Exact Jaccard join of texts' sets of word n-grams, by partitioning the universe of n-grams.

Sets of a size band (an octave) are cut into m segments by a hash of the n-gram. Two sets of sizes a and b with a similarity of t or
more differ in at most H = (1 - t)(a + b) / (1 + t) n-grams, so if segments get allowances v with sum(v) > H, then in some segment
they differ in fewer than v. The index holds each set's segment subsets (for v = 1: equal) and their one-deletion neighbourhoods
(for v = 2: at most one n-gram apart); v = 0 skips a segment. A set whose partners may be of the next band is in that band's index, too;
the larger of two sets probes. The allowances are a set's own: dynamic programming finds those with the fewest candidates, from counts of
who else is in the index under each key. Candidates are verified on whole sets.

At scale it goes like this; each table is written to the shared folder:

1. texts with equal sets are one class (by 63 bits of a hash of the whole set);
2. all keys of segment subsets are dealt by key, and a task counts for each set how many of its keys another set has, too. A map task
   settles what meets within it and passes on two sets of a key at most, so a key that everyone has stays small. A set with more than H
   keys of its own has no partner. The rest, a few per cent besides real copies, goes on;
3. each of these is compared with one other: of its keys' most shared holders the one that it meets most often. The links found join most
   copies, and a key whose holders are all joined counts as nobody else's from then on;
4. for sets that may still have partners outside their component: one-deletion neighbourhoods, counts, allowances, candidates from
   different components. Sketches of which bits are hit by an odd number of n-grams bound the difference of two sets from below, so most pairs
   end where they meet; the rest is checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, discard, staged, table
from .simhash import component_labels

#: Keys that a map task settles among themselves before it passes them on, and keys that a task of the exchange should get.
SETTLED, DEALT = 1 << 20, 1 << 21
#: Bytes of texts that are hashed together, and of words that are hashed together with others.
TOGETHER, LONG = 1 << 19, 64
#: Keys for each n-gram, about.
RATE = 0.5
SEGMENT, TOKEN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x27D4EB2F165667C5)
SHIFTS, TIMES = [np.uint64(k) for k in (31, 29, 32)], [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]
NEVER = 1 << 60
#: Bytes of words, and the first so many bytes of eight.
WORD, KEPT = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> SHIFTS[0])
    x *= TIMES[0]
    x ^= x >> SHIFTS[1]
    x *= TIMES[1]
    x ^= x >> SHIFTS[2]
    return x


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begins, hashes) of the words of raw, which has white space in front and eight bytes of it behind."""
    inside = WORD[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, dtype=np.uint8), 8)
    out, rest, at, left = sizes.astype(np.uint64) * TOKEN, slice(None), starts, sizes
    for _ in range(LONG // 8):
        out[rest] = mixed(out[rest] ^ (eights[at].view("<u8")[:, 0] & KEPT[np.minimum(left, 8)]))
        rest = np.flatnonzero(left > 8) if isinstance(rest, slice) else rest[left > 8]
        at, left = at[left > 8] + 8, left[left > 8] - 8
        if not len(rest):
            return starts, out
    for k in rest.tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    return starts, out


class Grams:
    """For each of some texts the sorted distinct 64-bit hashes of its n-grams, from its words' hashes."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts are hashed together, up to some bytes; a longer one by itself."""
        out, held, size = [], [], 0
        for t in texts.cast(pa.binary()).to_pylist():
            if held and size + len(t or b"") > TOGETHER:
                out += self.of(held)
                held, size = [], 0
            held.append(t or b"")
            size += len(held[-1])
        return out + self.of(held) if held else out

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        starts, codes = word_hashes(b" %b        " % b" ".join(texts).lower())
        cuts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])).tolist()
        whole, out = self.joined(codes, self.words) if len(codes) >= self.words else None, []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j == i:
                out.append(np.zeros(0, dtype=np.uint64))
                continue
            found = np.sort(whole[i : j - self.words + 1] if j - i >= self.words else self.joined(codes[i:j], j - i))
            out.append(found[begins(found)])
        return out

    @staticmethod
    def joined(codes: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(codes) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9FB21C651E98DF25) + codes[i : len(codes) - k + 1 + i]
        return mixed(out)


def begins(*columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        out[1:] |= c[1:] != c[:-1]
    return out


def of_band(band: int) -> np.uint64:
    return np.uint64(0x165667B19E3779F9 * (band + 1) % 2**64)


# --------------------------------------------------------------------------- bands, segments, keys
def difference(a: int, b: int, percent: int) -> int:
    """H: n-grams in which sets of these sizes may differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, segments, H to the largest partner in it) of the bands that a set of n n-grams is indexed in: its own, and perhaps the next."""
    own, most = n.bit_length() - 1, 100 * n // percent
    out = [(own, min(most, (2 << own) - 1))] + ([(own + 1, most)] if most >= 2 << own else [])
    return [(g, difference((2 << g) - 1, (2 << g) - 1, percent) + 1, h) for g, b in out if (h := difference(n, b, percent))]


def segment_of(found: np.ndarray, band: int, count: int) -> np.ndarray:
    return (mixed(found + of_band(band)) % np.uint64(count)).astype(np.int64)


class Segments:
    """A set's n-grams by segment of a band: the segments that have any, their sums, and each n-gram's share of its sum."""

    def __init__(self, found: np.ndarray, band: int, count: int):
        at = segment_of(found, band, count)
        order = np.argsort(at.astype(np.uint16) if count <= 1 << 16 else at, kind="stable")  # numbers of 16 bits are sorted by radix
        self.token, at = mixed(found * TOKEN)[order], at[order]
        self.starts = np.flatnonzero(begins(at))
        self.at, self.band, self.count = at[self.starts], band, count
        self.sums = np.add.reduceat(self.token, self.starts)

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.token)))

    def keys(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mixed(sums + (at.astype(np.uint64) + np.uint64(1)) * SEGMENT + of_band(self.band))

    def subsets(self) -> np.ndarray:
        return self.keys(self.sums, self.at)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, key) of the subsets less one n-gram each."""
        at, sums = np.repeat(self.at, self.sizes), np.repeat(self.sums, self.sizes)
        return at, self.keys(sums - self.token, at)

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.setdiff1d(np.arange(self.count), self.at)
        return at, self.keys(np.zeros(len(at), dtype=np.uint64), at)


def digest_of(found: np.ndarray) -> int:
    """63 bits of a set's hash, the lowest of 64 left free (for the band)."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes()) & ~1)))


# --------------------------------------------------------------------------- classes
def set_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, k, digest, n, filled, most) of (id, t): k is a hash of the text; for each band, segments with n-grams and H to the largest partner."""

    def run(batches):
        grams = Grams(words)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part, rows = b.slice(s, 512), []
                for x in grams(part.column(2)):
                    of = bands(len(x), percent) if len(x) else []
                    rows.append((digest_of(x) if len(x) else None, len(x), [int(np.count_nonzero(np.bincount(segment_of(x, g, m)))) for g, m, _ in of], [h for _, _, h in of]))
                digest, n, filled, most = zip(*rows, strict=True)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digest, pa.int64()), pa.array(n, pa.int64()), pa.array(filled, ints), pa.array(most, ints)], names=["id", "k", "digest", "n", "filled", "most"]
                )

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", F.xxhash64("t").alias("k"), "t").mapInArrow(run, f"id {kind}, k long, digest long, n long, filled array<int>, most array<int>")


# --------------------------------------------------------------------------- keys that others have, too
def settled(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, who) in order, and for each how many of its key come before it."""
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    new = begins(keys)
    several = np.flatnonzero(~new | ~np.append(new[1:], True))  # most keys come once
    who[several] = who[several][np.lexsort((who[several], keys[several]))]
    new = begins(keys, who)
    keys, who = keys[new], who[new]
    starts = np.flatnonzero(begins(keys))
    return keys, who, np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))


def shared_counts(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """(who, n): for each set (digest + band's place) at least the number of its keys that another set has, too; none for no such key."""

    def passed_on(keys: list, who: list):
        keys, who, place = settled(np.concatenate(keys), np.concatenate(who))
        done, times = np.unique(who[place >= 2], return_counts=True)
        keys, who = keys[place < 2], who[place < 2]
        to, done_to = keys % np.uint64(parts), done.view(np.uint64) // np.uint64(2) % np.uint64(parts)
        order, done_order = np.argsort(to, kind="stable"), np.argsort(done_to, kind="stable")
        cuts, done_cuts = (np.searchsorted(x[o], np.arange(parts + 1, dtype=np.uint64)) for x, o in ((to, order), (done_to, done_order)))
        keys, who, done, times = keys[order], who[order], done[done_order], times[done_order]
        rows = [
            (p, keys[i:j].tobytes() + who[i:j].tobytes(), done[a:b].tobytes() + times[a:b].tobytes())
            for p, (i, j, a, b) in enumerate(zip(cuts[:-1], cuts[1:], done_cuts[:-1], done_cuts[1:], strict=True))
            if j > i or b > a
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("done", pa.binary())]))

    def emit(batches):
        grams, keys, who, held = Grams(words), [], [], 0
        for b in batches:
            for x in (x for s in range(0, b.num_rows, 512) for x in grams(b.column(0).slice(s, 512))):
                digest = digest_of(x) if len(x) else 0
                for place, (g, m, _) in enumerate(bands(len(x), percent) if len(x) else ()):
                    keys.append(Segments(x, g, m).subsets())
                    who.append(np.full(len(keys[-1]), digest + place, dtype=np.int64))
                    held += len(keys[-1])
                if held > SETTLED:
                    yield from passed_on(keys, who)
                    keys, who, held = [], [], 0
        if held:
            yield from passed_on(keys, who)

    def count(batches):
        keys, who, done, times = ([np.zeros(0, dtype=k)] for k in (np.uint64, np.int64, np.int64, np.int64))
        for b in batches:
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keys.append(np.frombuffer(x, dtype=np.uint64, count=len(x) // 16))
                who.append(np.frombuffer(x, dtype=np.int64, offset=len(x) // 2))
                done.append(np.frombuffer(y, dtype=np.int64, count=len(y) // 16))
                times.append(np.frombuffer(y, dtype=np.int64, offset=len(y) // 2))
        keys, who, place = settled(np.concatenate(keys), np.concatenate(who))
        alone = (place == 0) & np.roll(place == 0, -1)  # the next key begins right behind it
        done.append(who[~alone])
        times.append(np.ones(len(done[-1]), dtype=np.int64))
        done, times = np.concatenate(done), np.concatenate(times)
        whose, at = np.unique(done, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(whose), pa.array(np.bincount(at, times, len(whose)).astype(np.int64))], names=["who", "n"])

    dealt = docs.select("t").mapInArrow(emit, "part long, keys binary, done binary").repartition(parts, "part")
    return dealt.mapInArrow(count, "who long, n long").groupBy("who").agg(F.sum("n").alias("n"))


def contenders(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(digest, n, places, filled, most, weight, shingles) of the sets that may have a partner, one row a class."""
    classes = sets.where(F.size("filled") > 0).groupBy("digest").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("filled").alias("filled"), F.first("most").alias("most"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * RATE) // DEALT, 1)
    shared = shared_counts(docs, words, percent, parts)
    by_band = classes.select("digest", "k", "n", F.posexplode(F.arrays_zip("filled", "most")).alias("place", "x")).select("digest", "k", "n", "place", "x.*", (F.col("digest") + F.col("place")).alias("who"))
    open_ = by_band.join(shared.withColumnRenamed("n", "shared"), "who", "left").withColumn("shared", F.least(F.coalesce("shared", F.lit(0)), F.col("filled").cast("long"))).where("filled - shared <= most")
    open_ = open_.groupBy("digest").agg(F.first("k").alias("k"), F.first("n").alias("n"), F.collect_list(F.struct("place", "filled", "most")).alias("bands"), F.max(F.col("shared") / F.col("filled")).alias("weight"))
    open_ = staged(open_, "join-open")
    texts = docs.select(F.xxhash64("t").alias("k"), "t").groupBy("k").agg(F.first("t").alias("t"))

    def run(batches):
        grams = Grams(words)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                found = [x.view(np.int64) for x in grams(part.column(4))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(found, pa.list_(pa.int64()))], names=["digest", "n", "bands", "weight", "shingles"])

    bands_ = "array<struct<place:int,filled:int,most:int>>"
    of = texts.hint("merge").join(open_, "k").select("digest", "n", F.col("bands").cast(bands_).alias("bands"), "weight", "t")
    return staged(of.mapInArrow(run, f"digest long, n long, bands {bands_}, weight double, shingles array<long>"), "join-sets")


def segments_of(part: pa.RecordBatch, percent: int, names: list[str]) -> Iterator[tuple[dict, np.ndarray, int, Segments]]:
    """(row without its n-grams, n-grams, band's place, segments) of rows with shingles and places."""
    rows = part.select([n for n in names if n != "shingles"]).to_pylist()
    lists = part.column(part.schema.get_field_index("shingles"))
    for row, found in zip(rows, lists, strict=True):
        x = found.values.to_numpy(zero_copy_only=False).view(np.uint64)
        of = bands(len(x), percent)
        for place in row["places"]:
            yield row, x, place, Segments(x, *of[place][:2])


# --------------------------------------------------------------------------- verifying
def verified(pairs: DataFrame, of: DataFrame, percent: int, salts: int = 64) -> DataFrame:
    """Those pairs (u, v) whose sets, in of (digest, shingles), are similar enough. Many pairs may have the same u or v."""
    dealt = pairs.withColumns({"su": F.pmod(F.xxhash64("v"), F.lit(salts)), "sv": F.pmod(F.xxhash64("u"), F.lit(salts))})
    left = dealt.select("u", "su").distinct().join(of.select(F.col("digest").alias("u"), F.col("shingles").alias("x")), "u")
    right = dealt.select("v", "sv").distinct().join(of.select(F.col("digest").alias("v"), F.col("shingles").alias("y")), "v")
    met = dealt.join(right, ["v", "sv"]).join(left, ["u", "su"])
    both = met.select("u", "v", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(F.col("same") * (100 + percent) >= F.col("total") * percent).select("u", "v")


def alike_in_size(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def subset_keys(of: DataFrame, percent: int) -> DataFrame:
    """(digest, weight, place, key) of all segment subsets."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                out = [(r["digest"], r["weight"], place, x.subsets().view(np.int64)) for r, _, place, x in segments_of(b.slice(s, 256), percent, b.schema.names)]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:2]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int64()))], names=["digest", "weight", "place", "keys"])

    placed = of.select("digest", "weight", F.col("bands.place").alias("places"), "shingles")
    return placed.mapInArrow(run, "digest long, weight double, place int, keys array<long>").select("digest", "weight", "place", F.explode("keys").alias("key"))


def outlines(of: DataFrame, percent: int) -> DataFrame:
    """(digest, place, size, odd, several, singles) of sets: segments with several n-grams and with one, and an odd sketch.

    Its bits are those that an odd number of n-grams hit; two sets' sketches differ in no more bits than the sets in n-grams.
    """

    def run(batches):
        for b in batches:
            rows = []
            for row, x, place, of in segments_of(b, percent, b.schema.names):
                width = max(64, 2 << of.band)
                hit = np.bincount((mixed(x ^ TOKEN) % np.uint64(width)).astype(np.int64), minlength=width) & 1
                rows.append((row["digest"], place, len(x), np.packbits(hit.astype(np.uint8)).view(np.int64), int((of.sizes > 1).sum()), int((of.sizes == 1).sum())))
            if rows:
                digest, place, size, odd, several, singles = zip(*rows, strict=True)
                columns = [pa.array(digest), pa.array(place, pa.int32()), pa.array(size), pa.array(odd, pa.list_(pa.int64())), pa.array(several), pa.array(singles)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "place", "size", "odd", "several", "singles"])

    return of.select("digest", F.col("bands.place").alias("places"), "shingles").mapInArrow(run, "digest long, place int, size long, odd array<long>, several long, singles long")


def may_be_alike(percent: int) -> Column:
    """Not told apart by sizes (n, m) and sketches (odd, odd_)."""
    differ = F.aggregate(F.zip_with("odd", "odd_", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return alike_in_size("n", "m", percent) & (differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))


def star(keys: DataFrame, outlined: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame:
    """(u, v): each set v with one that is central for it, namely of its keys' most shared holders the one that it meets most often.

    Pairs with equal labels (digest, label) are left out.
    """
    top = keys.groupBy("key").agg(F.max(F.struct("weight", "digest", "place")).alias("top"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high")
    met = keys.join(top.select("key", F.col("top.digest").alias("hub"), F.col("top.place").alias("hub_place")), "key").where(F.col("digest") != F.col("hub"))
    best = met.groupBy("digest", "place", "hub", "hub_place").agg(F.count("*").alias("times")).groupBy("digest").agg(F.max(F.struct("times", "hub", "hub_place", "place")).alias("x"))
    mine = outlined.select("digest", "place", F.col("size").alias("n"), "odd")
    pairs = best.select("digest", "x.*").join(mine, ["digest", "place"]).join(mine.toDF("hub", "hub_place", "m", "odd_"), ["hub", "hub_place"])
    pairs = pairs.where(may_be_alike(percent)).select(F.col("hub").alias("u"), F.col("digest").alias("v"))
    if labels is None:
        return pairs
    known = pairs.join(labels.toDF("u", "of_u"), "u", "left").join(labels.toDF("v", "of_v"), "v", "left")
    return known.where("of_u is null or of_v is null or of_u != of_v").select("u", "v")


# --------------------------------------------------------------------------- allowances and candidates
def allowances(one: np.ndarray, two: np.ndarray, total: int) -> np.ndarray | None:
    """v of 0, 1 or 2 for each segment with sum(v) >= total and the least summed costs; None where the most that they allow is too little."""
    if np.where(two < NEVER, 2, 1).sum() < total:
        return None
    best = np.full(total + 2, NEVER, dtype=np.int64)  # by the sum of v, which needn't go over the total by more than one
    best[0] = 0
    chosen = np.zeros((len(one), total + 2), dtype=np.int8)
    for k, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        tries = np.full((3, total + 2), NEVER, dtype=np.int64)
        tries[0], tries[1, 1:], tries[2, 2:] = best, best[:-1] + a, best[:-2] + b
        chosen[k], best = tries.argmin(0), np.minimum(tries.min(0), NEVER)
    at, out = total + int(best[total + 1] < best[total]), np.zeros(len(one), dtype=np.int64)
    for k in range(len(one) - 1, -1, -1):
        out[k] = chosen[k, at]
        at -= int(out[k])
    return out


def involved(of: DataFrame, keys: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(digest, label, places, probes): sets that may have a partner with another label, in which of their bands, and whether in their own
    they may be the larger of the two."""
    known = keys.select("digest", "place", "key").join(labels.toDF("digest", "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    apart = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    shared = known.join(apart, "key").groupBy("digest", "place").agg(F.count("*").alias("shared"))
    by_band = of.select("digest", "n", F.explode("bands").alias("x")).select("digest", "n", "x.*")
    alone = by_band.join(shared, ["digest", "place"], "left").withColumn("alone", F.col("filled") - F.coalesce("shared", F.lit(0))).where("alone <= most")
    larger = (F.col("place") == 0) & (F.col("alone") * (100 + percent) <= F.col("n") * 2 * (100 - percent))
    still = alone.groupBy("digest").agg(F.sort_array(F.collect_list("place")).alias("places"), F.max(larger).alias("probes"))
    return still.join(labels.toDF("digest", "label"), "digest", "left").select("digest", F.coalesce("label", "digest").alias("label"), "places", "probes")


SUBSET, DELETION = 0, 1


def index_rows(sets: DataFrame, percent: int, empty: bool = False) -> DataFrame:
    """(digest, label, place, probes, segment, single, kind, key) of sets: subsets and deletions, or the keys of segments without n-grams."""
    schema = "digest long, label long, place int, probes boolean, segment int, single boolean, kind int, key long"

    def run(batches):
        for b in batches:
            for row, _, place, of in segments_of(b, percent, b.schema.names):
                if empty:
                    at, keys = of.empty()
                    kind, single = np.zeros(len(at), dtype=np.int32), np.ones(len(at), dtype=bool)
                else:
                    (more, deletions), keys = of.deletions(), of.subsets()
                    at, keys = np.concatenate((of.at, more)), np.concatenate((keys, deletions))
                    kind, single = np.repeat(np.array([SUBSET, DELETION], dtype=np.int32), (len(of.at), len(more))), np.concatenate((of.sizes, np.repeat(of.sizes, of.sizes))) == 1
                size = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, row["digest"])), pa.array(np.full(size, row["label"])), pa.array(np.full(size, place, dtype=np.int32)), pa.array(np.full(size, row["probes"] and place == 0)),
                        pa.array(at.astype(np.int32)), pa.array(single), pa.array(kind), pa.array(keys.view(np.int64)),
                    ],
                    names=["digest", "label", "place", "probes", "segment", "single", "kind", "key"],
                )

    return sets.select("digest", "label", "places", "probes", "shingles").mapInArrow(run, schema)


def allotted(costs: DataFrame, percent: int) -> DataFrame:
    """(digest, segment, v) of (digest, size, several, singles, segment, one, two), the last three arrays of the segments that cost anything.

    The others are used for free and left out, as nobody else is there. Segment -1 means that those without n-grams are needed, too.
    """

    def run(batches):
        for b in batches:
            digest, size, several, singles = (b.column(k).to_pylist() for k in range(4))
            arrays = zip(*(b.column(k) for k in (4, 5, 6)), strict=True)
            for d, n, many, ones, of in zip(digest, size, several, singles, arrays, strict=True):
                at, one, two = (x.values.to_numpy(zero_copy_only=False) for x in of)
                paid = two == NEVER
                left = difference(n, n, percent) + 1 - 2 * (many - int((~paid).sum())) - (ones - int(paid.sum()))
                if left <= 0:
                    continue
                v = allowances(one, two, left)
                if v is None:
                    at, one, two, v = np.append(at, -1), np.append(one, 1), np.append(two, 1), np.append(np.where(paid, 1, 2), 1)
                asks = np.where(v == 2, two, np.where(v == 1, one, 0)) > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(asks.sum(), d)), pa.array(at[asks].astype(np.int32)), pa.array(v[asks].astype(np.int32))], names=["digest", "segment", "v"])

    return costs.select("digest", "size", "several", "singles", "of.segment", "of.one", "of.two").mapInArrow(run, "digest long, segment int, v int")


def candidates(sets: DataFrame, outlined: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs with different labels, among them all that are similar enough, of sets (digest, label, places, probes, shingles)."""
    index = staged(index_rows(sets, percent), "join-index")
    # a probing set's subset meets subsets and others' deletions, its deletions meet subsets
    targets = F.when(F.col("kind") == SUBSET, F.array(F.lit(SUBSET), F.lit(DELETION))).otherwise(F.array(F.lit(SUBSET)))
    plain = (F.col("kind") == SUBSET) & (F.col("target") == SUBSET)
    others = (F.col("low") != F.col("high")) | (F.col("low") != F.col("label"))
    probes = index.where("probes").select("digest", "label", "segment", "single", "kind", "key", F.explode(targets).alias("target")).where(~F.col("single") | plain)
    counts = index.groupBy("key", F.col("kind").alias("target")).agg(F.count("*").alias("holders"), F.min("label").alias("low"), F.max("label").alias("high"))
    costs = staged(probes.join(counts, ["key", "target"]).where(others).drop("low", "high"), "join-costs")
    by_segment = costs.groupBy("digest", "segment").agg(F.sum(F.when(plain, F.col("holders")).otherwise(0)).alias("one"), F.when(F.max("single"), F.lit(NEVER)).otherwise(F.sum("holders")).alias("two"))
    by_set = by_segment.groupBy("digest").agg(F.collect_list(F.struct("segment", "one", "two")).alias("of"))
    chosen = staged(allotted(outlined.where("place = 0").join(by_set, "digest"), percent), "join-allotted")
    asked, held = costs.join(chosen, ["digest", "segment"]).where((F.col("v") == 2) | plain).select("digest", "label", "key", "target"), index
    if chosen.where("segment < 0").limit(1).count():  # the n-grams of some small set all fall into so few segments
        none = index_rows(sets, percent, empty=True)
        asked = asked.unionByName(none.where("probes").join(chosen.where("segment < 0").select("digest"), "digest").select("digest", "label", "key", F.lit(SUBSET).alias("target")))
        held = index.unionByName(none)
    asked = staged(asked, "join-asked")
    odd = outlined.select("digest", "place", "size", "odd")
    other = held.withColumnRenamed("kind", "target").join(asked.select("key", "target").distinct(), ["key", "target"], "left_semi").join(odd, ["digest", "place"])
    other = other.select(F.col("digest").alias("other"), F.col("label").alias("label_"), F.col("size").alias("m"), "key", "target", F.col("odd").alias("odd_"))
    mine = asked.join(odd.where("place = 0").drop("place").withColumnRenamed("size", "n"), "digest")
    met = mine.join(other, (mine.key == other.key) & (mine.target == other.target) & (F.col("label") != F.col("label_")) & (F.col("m") <= F.col("n")) & may_be_alike(percent))
    out = staged(met.select(F.least("digest", "other").alias("u"), F.greatest("digest", "other").alias("v")).distinct(), "join-pairs")
    discard(index, costs, chosen, asked)
    return out


# --------------------------------------------------------------------------- the join
def class_labels(docs: DataFrame, words: int, percent: int, proposed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of (id, t): (id, k, digest, n, ...) for every row, and (digest, label) of the sets that have links: the least digest that they reach.

    ``proposed`` may give pairs (u, v) of digests, from the table of all rows' sets, which are checked first; the rest of the join finds
    the links between what they leave apart.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the similarity must be between 50 and 100 per cent")
    sets = staged(set_rows(docs, words, percent), "join-rows")
    of = contenders(docs, sets, words, percent)
    keys, outlined = staged(subset_keys(of, percent), "join-keys"), staged(outlines(of, percent), "join-outlines")
    links, known = None, None
    if proposed:
        links = staged(verified(proposed(sets), of, percent), "join-links")
        known = component_labels(links)
    central = staged(verified(staged(star(keys, outlined, percent, known), "join-star"), of, percent), "join-links")
    links = links.unionByName(central) if proposed else central
    still = staged(involved(of, keys, component_labels(links), percent), "join-involved")
    discard(keys)
    pairs = candidates(of.join(still, "digest").select("digest", "label", "places", "probes", "shingles"), outlined, percent)
    more = staged(verified(pairs, of, percent), "join-links")
    labels = component_labels(links.unionByName(more))
    discard(of, outlined, pairs, still)
    return sets, labels


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(<id>, n_shingles, component_id) for every row of docs: the smallest id reachable over pairs of similarity percent / 100 or more.

    The table is read three times. Cases: null and empty texts (and white space) have empty sets, which are linked with nothing; a text
    of fewer words than a shingle is one; repeated rows come back as often as they came in, and link as texts with equal sets; null ids
    are ignored by the minimum; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    sets, labels = class_labels(docs.select(col(id_col).alias("id"), col(text_col).alias("t")), words, percent)
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")).join(labels.toDF("digest", "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    classes = staged(classes, "join-classes")
    final = classes.join(classes.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("digest", "component_id")
    found = sets.select("id", "n", "digest").join(staged(final, "join-final"), "digest", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
