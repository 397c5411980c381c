"""Operators with exact contracts against brute force over whole small tables and over awkward rows."""

import gzip
import hashlib
import zlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from reelbase.llm import near_copies, ngram_join, packing, simhash, telephony, warc

AWKWARD = [
    (1, "one two three four five six", "a"),
    (2, None, "b"),
    (3, "", "c"),
    (4, " \t\n ", "d"),
    (5, "One TWO three four five six", "e"),
    (5, "One TWO three four five six", "e"),
    (None, "one two three four five six", "f"),
    (7, "été naïve \U0001f600 x", "g"),
    (8, "word " * 6000, "h"),
    (9, "two words", "i"),
]
SCHEMA = "doc_id long, text string, fp string"


def awkward(spark):
    return spark.createDataFrame([(*r,) for r in AWKWARD], SCHEMA)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def slow_components(rows, bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.query(spark, sf).collect()), key=str)
    assert got == slow_components(rows)


def test_simhash_awkward_rows(spark):
    got = sorted((tuple(r) for r in simhash.near_duplicates(awkward(spark)).collect()), key=str)
    assert got == slow_components([(d, t) for d, t, _ in AWKWARD])
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0
    exact = {r.doc_id: r for r in simhash.near_duplicates(awkward(spark), max_bits=0).collect()}
    assert exact[5].component_id == exact[1].component_id == 1 and exact[9].component_id == 9
    kept = simhash.one_of_each(awkward(spark))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in got})


LONG = " ".join(f"w{i}" for i in range(400))


@pytest.mark.parametrize("one_of_each", [simhash.one_of_each, near_copies.one_of_each])
def test_one_row_of_each_component(spark, one_of_each):
    a, b, c = "alpha beta gamma delta epsilon zeta", LONG, "one two three four five six seven"
    rows = [(1, a), (None, a), (None, b), (None, b + " end"), (5, c), (5, a), (5, "quite another text with words of its own"), (7, c), (7, c), (8, None), (9, "")]
    docs = spark.createDataFrame([(t, "x", i, 1.5) for i, t in rows], "text string, id string, doc_id long, `a.b` double")
    got = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (5, c), (5, rows[6][1]), (8, None)], key=str) or got == sorted([(1, a), (None, b + " end"), (5, c), (5, rows[6][1]), (8, None)], key=str)
    assert one_of_each(docs).columns == docs.columns and one_of_each(docs.limit(0)).count() == 0


def test_near_copies_go_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(900)]
    edited = [" ".join([*base, end]) for end in ("one", "two", "three")]
    alike = [" ".join(["x"] * 100 + [f"{c}{k}" for k in range(10)]) for c in "pqr"]  # equal fingerprints, as one shingle prevails
    assert len({simhash.fingerprint_of(t, 5) for t in alike}) == 1
    assert all((simhash.fingerprint_of(t, 5) ^ simhash.fingerprint_of(edited[0], 5)).bit_count() <= 4 for t in edited)
    docs = spark.createDataFrame(list(enumerate([*edited, *alike, None, ""])), "doc_id long, text string")
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    found = lambda: {r.doc_id: r.component_id for r in near_copies.components(docs).collect()}
    assert found() == want
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(ngram_join, "star", lambda *args: none)  # without the exact join's own pairs
    monkeypatch.setattr(ngram_join, "candidates", lambda *args: none)
    assert found() == want


def test_law_of_distances_follows_correlation():
    rng = np.random.default_rng(2)
    shared = rng.random((4000, 1)) < 0.5
    x = ((rng.random((4000, 64)) < 0.5) ^ False).astype(float)
    x[:, :16] = np.where(rng.random((4000, 16)) < 0.7, shared, x[:, :16])
    joint = x.T @ x
    i, j = rng.integers(0, 4000, (2, 200_000))
    for bits in (list(range(16)), list(range(20, 36))):
        law = simhash.distance_law(joint, 4000, bits)
        seen = np.bincount((x[i][:, bits] != x[j][:, bits]).sum(1), minlength=17) / len(i)
        assert abs(law.sum() - 1) < 1e-6 and np.abs(np.cumsum(law) - np.cumsum(seen)).max() < 0.1


@pytest.mark.parametrize("spread", [1, 3, 6])
def test_hot_values_are_split_without_losing_links(spark, spread):
    rng = np.random.default_rng(spread)
    centre = rng.integers(0, 2**63)
    fps = {int(centre) ^ int(np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 62, spread))) for _ in range(700)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(fps)
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    labels = {r.node: r.label for r in simhash.component_labels(simhash.links(classes, 4, block=64)).collect()}
    x = np.array(fps, dtype=np.int64)
    near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 4
    i, j = np.nonzero(np.triu(near, 1))
    root = simhash._local_roots(i, j, len(x))
    assert [labels.get(f, f) for f in fps] == [fps[r] for r in root]


@pytest.mark.parametrize("counts", [(2,), (3,), (4,), (5,)])
def test_every_partitioning_finds_all_pairs(spark, counts, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40)
    fps = sorted({int(b) ^ int(sum(1 << int(k) for k in set(rng.integers(0, 63, d)))) for b in base for d in (0, 1, 2, 3, 4)})
    real = simhash.plan_partitions
    monkeypatch.setattr(simhash, "plan_partitions", lambda *a: real(*a, counts=counts))
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    labels = {r.node: r.label for r in simhash.component_labels(simhash.links(classes, 4)).collect()}
    x = np.array(fps, dtype=np.int64)
    i, j = np.nonzero(np.triu(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 4, 1))
    assert [labels.get(f, f) for f in fps] == [fps[r] for r in simhash._local_roots(i, j, len(x))]


def test_allocation_is_the_cheapest():
    cost, ts = simhash.allocate([[0, 5, 50, 500], [0, 1, 10, 100], [0, 2, 3, 4]], 2)
    assert (cost, sum(ts)) == (min(a + b + c for i, a in enumerate([0, 5, 50, 500]) for j, b in enumerate([0, 1, 10, 100]) for k, c in enumerate([0, 2, 3, 4]) if i + j + k == 5), 2)


# --------------------------------------------------------------------------- packing
def slow_ids(text, tok):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def check_packed(rows, docs, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for d, t in docs:
        ids = slow_ids(t, tok)
        for j, a in enumerate(range(0, len(ids), capacity)):
            x = ids[a : a + capacity]
            want.append((d, j, a, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(w[3] for w in want) // capacity)


def test_packing_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packed(packing.query(spark, sf).collect(), docs)
    assert used <= least * 1.02 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBzéÀžÿ÷\u0301ß.,!'-9%<|>ΣİſK \n\u3000\x1c", max_size=12), max_size=6))
def test_chunked_ids_equal_the_tokenizers(texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = texts + ["It's <|endoftext|>X <|ENDOFTEXT|> y", "a<|endoftext|>.", "ΑΣ. ΑΣ\u0301, don't. 's!", "Éöøß àÿ ɏ İx ŉ ǰ Ǆ þ÷ ﬁ"]
    got = packing.WordTokens(path).ids(texts, b"")
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_awkward_rows(spark):
    check_packed(packing.pack(awkward(spark), packing.default_tokenizer()).collect(), [(d, t) for d, t, _ in AWKWARD])
    assert packing.pack(awkward(spark).limit(0), packing.default_tokenizer()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_fills_bins_like_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, seen = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(counts, 40):
        for k in range(n):
            bins[first + k].append((offset, length))
            seen[length].append(rank + k)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in counts.items()}
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 40
    room = []  # best-fit decreasing, one by one
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= x), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((40 if fit is None else fit) - x)
    assert len(bins) == len(room)


# --------------------------------------------------------------------------- telephony
def test_companding_tables():
    assert (telephony.TABLES[telephony.MULAW][[0x00, 0x7F, 0x80, 0xFF]] == [-32124, 0, 32124, 0]).all()
    assert (telephony.TABLES[telephony.ALAW][[0xD5, 0x55, 0xAA, 0x2A]] == [8, -8, 32256, -32256]).all()


def slow_adpcm(block):
    value, at = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[at])
            change = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                if nibble & bit:
                    change += step >> shift
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            at = max(0, min(88, at + int(telephony.INDEX[nibble & 7])))
            out.append(value)
    return out


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=700))
def test_adpcm_blocks(data):
    padded = data.ljust(-(-len(data) // 64) * 64, b"\0")
    assert telephony.decode_adpcm(data, 64).tolist() == [x for a in range(0, len(padded), 64) for x in slow_adpcm(padded[a : a + 64])]


def slow_audio(text, tag):
    """The contract's columns and the feature of one text, decoded sample by sample."""
    raw = (text or "").encode()
    x = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
    tag = telephony.chosen_coding(x) if tag is None else tag
    if tag == telephony.IMA_ADPCM:
        samples = [v for a in range(0, len(x), 64) for v in slow_adpcm(x[a : a + 64])]
    else:
        samples = [int(telephony.TABLES[tag][c]) for c in x]
    low = samples[: 2 * (len(samples) // 2) : 2]  # 16000 to 8000 samples a second
    crossings = sum((p < 0) != (q < 0) for p, q in zip(low, low[1:]))
    return len(raw), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), f"{len(low)}:{sum(v * v for v in low)}:{max(map(abs, low))}:{crossings}"


def check_audio(df, docs, tag=None):
    rows = df.collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in rows), key=str)
    assert got == sorted(((d, *slow_audio(t, tag)) for d, t in docs), key=str)
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in rows}) == len({r.payload_sha256 for r in rows})


@pytest.mark.parametrize("tag", [telephony.MULAW, telephony.ALAW, telephony.IMA_ADPCM, None])
def test_media_round_trip(spark, tag):
    check_audio(telephony.store_and_read(awkward(spark), tag=tag), [(d, t) for d, t, _ in AWKWARD], tag)


def test_audio_whole_table(spark, sf):
    check_audio(telephony.query(spark, sf), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_pcm_store(spark):
    stereo = bytearray(telephony.wav(b"\xff" * 64, telephony.MULAW, 8000))
    stereo[22] = 2
    extra = [(99, 0, b"junk"), (98, 0, None), (97, 0, bytes(stereo)), (96, 0, telephony.wav(b"ab", 0x55, 8000))]
    media = telephony.encode_payload(awkward(spark), tag=telephony.MULAW, rate=8000).unionByName(spark.createDataFrame(extra, "doc_id long, n_bytes long, media binary"))
    got = {r.doc_id: r for r in telephony.to_pcm(media, rate=16000).collect()}
    tag, rate, align, data = telephony.parse_wav(got[9].pcm)
    assert (tag, rate, align, len(data)) == (telephony.PCM, 16000, 2, 64 * 2 * 2)
    assert all(got[k].pcm is None and got[k].error for k in (96, 97, 98, 99)) and "2 channels" in got[97].error
    assert telephony.to_pcm(media.limit(0)).count() == 0


# --------------------------------------------------------------------------- WARC
PAGES = [(1, "http://a/ b", "x" * 1000), (2, None, "x" * 1000), (3, "http://c", "x" * 999), (4, "http://d", "x" * 999), (5, "u", None), (6, "u", ""), (None, "u", "x" * 1000), (2, "again", "x" * 1000), (9, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\né" * 60)]


def test_warc_awkward_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = sorted((tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()), key=str)
    want = []
    for i, _, h in PAGES:
        x = (h or "").encode()
        same = [p for p, _, g in PAGES if (g or "").encode() == x and p is not None]
        back = len(x) >= 1000 and len([1 for _, _, g in PAGES if (g or "").encode() == x]) > 1 and i != max(same)
        want.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if back else "response", max(same) if back else None))
    assert got == sorted(want, key=str)
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_hot_payloads_meet_the_same_originals(spark, monkeypatch):
    """Payloads shared by many, by two and by none; whichever of them count as hot, and however long addresses are."""
    rows = [(k, "http://x/" + "u" * (5000 * (k == 298)) + str(k), "h" * 2000 if k % 2 else f"{k // 4:04d}" * 400) for k in range(300)] + [(None, "http://n", "h" * 2000), (299, "http://z", "h" * 2000), (5, None, None)]
    heads = warc.heads(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").drop("p")
    found = []
    for share in (0, 3, 1000):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        found.append(sorted(warc.references(heads, 1000).collect(), key=str))
    assert found[0] == found[1] == found[2]
    assert {r.original for r in found[0] if r.r_id is not None and r.r_id % 2} == {299} and {r.original_url for r in found[0] if r.original == 299} == {"http://z"}
    assert {(r.r_id, r.original) for r in found[0] if r.r_id is not None and r.r_id % 2 == 0} == {(4 * k, 4 * k + 2) for k in range(75)}
    assert sum(r.r_id is None for r in found[0]) == 1 and len(found[0]) == 149 + 75 + 1


def test_warc_files_and_members(spark, tmp_path):
    big = "y" * (warc.LARGE + 1)
    rows = [(k, f"u{k}", f"page {k} " * 300) for k in range(20)] + [(50, "u", big), (51, "v", big), (52, "w", big + "z")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert len(got) == 23 and (got[50].record_type, got[50].refers_to, got[51].record_type) == ("revisit", 51, "response")
    plain = [*tmp_path.glob("w/plain/*.txt")]
    assert len(plain) == 2 and all(f.read_bytes().startswith(b"WARC/1.0") for f in plain)
    seen = []
    for f in tmp_path.glob("w/members/*.txt"):
        data = f.read_bytes()
        assert gzip.decompress(data).decode().count("WARC/1.0") == len([*warc.unpacked(data)])
        seen += [*warc.unpacked(data)]
    assert len(seen) == 21 and all(x.startswith(b"WARC/1.0") and x.endswith(b"\r\n\r\n") for x in seen)
    back = next(x for x in seen if b"WARC-Type: revisit" in x)
    assert b"WARC-Refers-To-Target-URI: v\r\n" in back and b"WARC-Refers-To-Date: " in back


def test_warc_whole_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(warc.SQL)
    got = warc.query(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
