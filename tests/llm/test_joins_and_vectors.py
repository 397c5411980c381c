"""Exact n-gram join, embedding whitening and fill-in-middle against brute force."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelbase.llm import infill, ngram_join, whitening


def words_of(t):
    return (t or "").encode().lower().split()


def slow_components(rows, words=5, percent=80):
    """(id, set size, least id reachable) in the order of rows."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            above[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


class Mapped:
    """Stands for a table and keeps the function that an operator maps over its batches."""

    dtypes = [("id", "bigint"), ("doc_id", "bigint"), ("text", "string")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def withColumnRenamed(self, *names):
        return self


def joined(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "digest": F.lit(1), "a.b": F.lit(None).cast("string")})
    return sorted(map(tuple, ngram_join.components(docs, **how).collect()), key=str)


def test_join_of_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join.query(spark, sf).collect()), key=str) == sorted(slow_components(rows), key=str)


def edited(r, words, share):
    return [w if r.random() > share else f"x{r.randrange(10**6)}" for w in words]


def test_join_of_texts_near_the_limit(spark):
    """Chains, single edits, all small sizes, common passages, sizes at the ends of bands, awkward rows."""
    r = random.Random(5)
    texts = [None, "", " \t\n", "one", "ONE", "one two three four five", "word " * 3000]
    for n in (5, 6, 7, 8, 9, 10, 12, 13, 16, 20, 36, 68, 130):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base, "end"]), " ".join(base[1:]), " ".join(base[: n // 2] + ["mid"] + base[n // 2 :])]
        texts += [" ".join(edited(r, base, s)) for s in (0.01, 0.02, 0.03, 0.05, 0.1)]
    common = [f"c{k}" for k in range(60)]
    texts += [" ".join(common + [f"o{k}x{i}" for i in range(r.randrange(5, 30))]) for k in range(40)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[8])] * 2
    assert joined(spark, rows) == sorted(slow_components(rows), key=str)
    assert joined(spark, rows, percent=60, words=2) == sorted(slow_components(rows, 2, 60), key=str)


def test_join_of_nothing(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(3, None), (3, "")]) == [(3, 0, 3)] * 2


def test_common_passages_make_no_candidates(spark, monkeypatch):
    """Documents of 120 common and 60 own words: as many pairs as rows squared share keys, none becomes a candidate."""
    found = []
    kept = ngram_join.staged

    def counted(df, name):
        out = kept(df, name)
        found.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    rows = [(k, " ".join([f"c{i}" for i in range(120)] + [f"o{k}x{i}" for i in range(60)])) for k in range(400)]
    got = joined(spark, rows)
    assert [x[2] for x in sorted(got)] == list(range(400))
    assert dict(found)["join-pairs"] == 0 and dict(found)["join-star"] <= 400


def test_sets_whose_grams_share_a_segment(spark, monkeypatch):
    """Where even two for each filled segment are too little, segments without n-grams count, too."""

    def all_of_them(costs, percent):
        each = costs.select("digest", F.explode("of.segment").alias("segment"), F.lit(1).alias("v"))
        return each.unionByName(costs.select("digest", F.lit(-1).alias("segment"), F.lit(1).alias("v")))

    monkeypatch.setattr(ngram_join, "allotted", all_of_them)
    rows = [(k, " ".join(f"w{i}" for i in range(k % 3, 14 + k % 4))) for k in range(12)]
    assert joined(spark, rows) == sorted(slow_components(rows), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9) | st.just(ngram_join.NEVER)), min_size=1, max_size=6), st.integers(1, 9))
def test_allowances_are_the_cheapest(costs, total):
    one = np.array([a for a, _ in costs])
    two = np.array([max(a, b) for a, b in costs])
    price = lambda v: sum((0, a, b)[x] for x, a, b in zip(v, one.tolist(), two.tolist(), strict=True))
    fine = [v for v in itertools.product((0, 1, 2), repeat=len(one)) if sum(v) >= total and all(x < 2 or b < ngram_join.NEVER for x, b in zip(v, two.tolist(), strict=True))]
    got = ngram_join.allowances(one, two, total)
    if not fine:
        assert got is None
    else:
        assert got.sum() >= total and price(got.tolist()) == min(map(price, fine))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.sampled_from([50, 60, 80, 95, 100]))
def test_bands_hold_all_partners(a, b, percent):
    a, b = sorted((a, b))
    if 100 * a < percent * b:
        return
    most = (100 - percent) * (a + b) // (100 + percent)
    shared = {g: h for g, _, h in ngram_join.bands(a, percent)}
    own = b.bit_length() - 1
    assert most == 0 or (own in shared and shared[own] >= most)
    for g, m, _ in ngram_join.bands(b, percent)[:1]:
        assert m >= ngram_join.difference(b, b, percent) + 1 or most == 0


# --------------------------------------------------------------------------- whitening
def check_whitening(got, vectors):
    """Rows of (vec_id, component, ...) against whole numbers, fractions and numpy's own decomposition."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(32, int((e > v.trace() * d * 2.0**-50).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n}
    w = (np.array(y, dtype=np.float64) / n) @ q[:, :k] / np.sqrt(e[:k])
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.explained == pytest.approx(e[r.component - 1] / v.trace(), rel=1e-6) and r.identity_error < 1e-4
    order = {i: z for i, (i_, _) in enumerate(vectors) for z in [i_]}
    dev = sorted((order[i], sum(c * c for c in r)) for i, r in enumerate(y))
    gap = np.abs(np.diff(np.append(e, 0)))
    for c in range(1, k + 1):
        assert sorted((r.vec_id, r.deviation) for r in by[c]) == dev
        if min(gap[c - 1], gap[c - 2] if c > 1 else 1e9) > 1e-6 * e[0]:
            ours = {r.vec_id: r.whitened for r in by[c]}
            mine = np.array([ours[i] for i, _ in vectors])
            assert min(np.abs(mine - w[:, c - 1]).max(), np.abs(mine + w[:, c - 1]).max()) < 1e-6
    cov = np.cov(np.array([[r.whitened for r in sorted(by[c], key=lambda r: r.vec_id)] for c in by]), bias=True)
    assert np.abs(np.atleast_2d(cov) - np.eye(k)).max() < 1e-4


def test_whitening_of_the_whole_table(spark, sf):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(whitening.query(spark, sf).collect(), vectors)


def test_whitening_of_awkward_rows(spark):
    r = np.random.default_rng(3)
    fine = [(k, (r.normal(size=3) * [1, 5, 100]).tolist()) for k in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [1.0, float("inf"), 2.0]), (95, [1e300, 0.0, 0.0]), (96, [1.0, 2.0])]
    docs = spark.createDataFrame(fine + odd, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "id": F.lit("x"), "component": F.lit(2)})
    check_whitening(whitening.whitened(docs).collect(), fine)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).collect() == [] and whitening.whitened(empty).columns[0] == "vec_id"
    same = spark.createDataFrame([(None, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")
    assert whitening.whitened(same).collect() == []
    flat = [(k, [float(k), 2.0 * k, 1.0]) for k in range(10)]  # one component has all the variance
    check_whitening(whitening.whitened(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), flat)


def test_scatter_is_exact_for_any_size(spark):
    """Entries so far apart that the sums need many primes, and deviations beyond a long."""
    r = np.random.default_rng(4)
    vectors = [(k, (r.normal(size=2) * 2.0**40).tolist()) for k in range(30)]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors]
    n, s = 30, [sum(c) for c in zip(*x, strict=True)]
    got = whitening.scatter(df, 2, n, s, max(max(c) - min(c) for c in zip(*x, strict=True)))
    y = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    assert got == [[sum(row[i] * row[j] for row in y) for j in range(2)] for i in range(2)]
    assert {r.deviation for r in whitening.whitened(df, "id", "v").collect()} == {None}


def test_sets_of_words_of_any_length_and_kind():
    long = [b"x" * n + e for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 200) for e in (b"", b"y", b"z", b"\0", b"\x1c")]
    texts = [None, b"", b" \t\n\x0b\x0c\r ", b"a", b"A b", b"a b c d e", b"a b c d e f", b"d e f", "é É 日本\xa0語".encode(), *long, b" ".join(long), b"  ".join(reversed(long)), b"a b c d e " * 9]
    texts += [b" ".join(random.Random(k).choices(long, k=k)) for k in range(40)] + [b"w " * 300_000]
    got = [len(x) for x in ngram_join.Grams(5)(pa.array(texts, pa.binary()))]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or b"").lower().split()) else set() for t in texts]
    assert got == [len(x) for x in sets]
    assert len(np.unique(np.concatenate(ngram_join.Grams(5)(pa.array(texts, pa.binary()))))) == len(set().union(*sets))


def test_sets_cost_little_more_than_splitting_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(200_000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(range(2000), pa.int64()), pa.array(texts)], names=["id", "k", "t"])
    run = ngram_join.set_rows(Mapped(), 5, 80).run

    def least(work):
        times = []
        for _ in range(3):
            start = time.process_time()
            work()
            times.append(time.process_time() - start)
        return min(times)

    assert least(lambda: list(run(iter([batch])))) < 5 * least(lambda: [t.encode().lower().split() for t in texts])


# --------------------------------------------------------------------------- fill-in-middle
def slow_infill(ident, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return ident, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return ident, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def infilled(df):
    made = infill.fill_in_middle(df)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return sorted(map(tuple, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")), digest(infill.restored(F.col("form"), F.col("output")))).collect()), key=str)


def test_infill_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = infill.query(spark, sf)
    want = con.execute(infill.SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_infill_of_awkward_rows(spark):
    texts = [None, "", " ", "a", "é", "<P>", "<P", "x<S>y", "a<M>", "<<P>", "<P<S>", "<p>", "< P>", "<PP>", "日本 abc\n\t\0 déjà<", "word " * 60_000, "\U0001f600" * 3000, "P<P" * 9, "M>" * 40]
    rows = [(k, t) for k in range(12) for t in texts] + [(None, "some text"), (None, "some text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "a.b": F.lit(2)})
    assert infilled(df) == sorted((slow_infill(i, t) for i, t in rows), key=str)
    assert infilled(df.limit(0)) == []


def test_infill_takes_a_batch_by_buffers(spark):
    texts = [f"{k} some words <P " * 250 for k in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array(texts, pa.string())], names=["id", "t"])
    del texts
    run = infill.fill_in_middle(Mapped()).run
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 0.4 * batch.nbytes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aPSM<>é日\U0001f600 \n1", max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_automaton_emits_what_the_pattern_says(texts, times):
    raw = [t.encode() * times for t in texts]
    emitted, at = infill.scan(b"\xff".join(raw)), 0
    for b in raw:
        s, t = infill.Scanned(emitted[at : at + len(b)]), b.decode()
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        assert s.units == len(units) and s.has_sentinel() == bool(re.search("<[PSM]>", t)) and s.chars(0, len(b)) == len(t)
        assert [s.cut(k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]
        at += len(b) + 1
