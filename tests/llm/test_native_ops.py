"""Mixing, quality rules and personal data: against their SQL in DuckDB or brute force, over whole small tables and awkward rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelbase.llm import mixing, pii, queries, rules

ROWS = [
    (1, "a b c d e f g h " * 3 + "tail", "en", "s0"),
    (2, None, "en", "s0"),
    (3, "", None, None),
    (4, " \t\n\x0b ", "de", None),
    (5, "x y\nx y\nx y\n\n\nz " * 30, "en", "s1"),
    (5, "x y\nx y\nx y\n\n\nz " * 30, "en", "s1"),
    (None, "### $$$ | < > & * %" * 10, "en", "s1"),
    (7, "é ü \U0001f600 " * 12, None, "s0"),
    (8, "w%d " * 4000 % tuple(range(4000)), "en", "s2"),
    (9, "LOUD TEXT " * 15 + " ".join(f"q{i}" for i in range(40)), "en", "s0"),
]
SCHEMA = "doc_id long, text string, lang string, source string, id string, block long, bucket string, words string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], SCHEMA)


def oracle(sql, rows=None, sf=None):
    c = duckdb.connect()
    if sf:
        c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    else:
        docs = pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))})
        c.register("documents", docs)
    found = c.sql(sql)
    return Counter(tuple(sorted(zip(found.columns, r), key=lambda x: x[0])) for r in found.fetchall())


def rows_of(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_quality_rules"])
def test_whole_table(spark, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == oracle(queries.ORACLE_SQL[name], sf=sf)


@pytest.mark.parametrize("name,run", [("op2_mix_sources", mixing.mix_plan), ("op3_quality_rules", rules.apply_rules)])
def test_awkward_rows(spark, name, run):
    assert rows_of(run(frame(spark))) == oracle(queries.ORACLE_SQL[name], ROWS)
    assert run(frame(spark).limit(0)).count() == 0


def slow_repeats(text, k=8):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(k)})


def test_repeated_words(spark):
    got = {(r.id, r.n_repeat_words) for r in rules.statistics(frame(spark)).collect()}
    assert got == {(d, slow_repeats(t)) for d, t, *_ in ROWS}


def test_cutoffs_follow_their_group(spark):
    word = lambda k, j: ("w" if j % 3 else "W") + chr(97 + (k * 7 + j) % 26) + str(k * 40 + j)
    lines = lambda k: [" ".join(word(k, j).lower() for j in range(i, i + 4)) for i in range(0, 36, 4)]
    plain = [(k, "\n".join([*lines(k), lines(k)[0]]), "en", "plain") for k in range(300)]  # a tenth of the lines twice
    loud = [(1000 + k, " ".join(word(k, j).upper() if j % 2 else word(k, j) for j in range(40)), "en", "loud") for k in range(300)]
    text = " ".join(f"{'Q' if k % 3 else 'q'}r{k}" for k in range(60))
    marks = " ".join(f"#{k}$" for k in range(60))
    rows = plain + loud + [(i, t, "en", s) for i, (t, s) in enumerate([(text, "plain"), (text, "loud"), (marks, "plain"), ("a b c d e f g h i j\n" * 3 + " ".join(f"z{i}" for i in range(70)), "plain")], 5000)]
    got = {r.doc_id: r for r in rules.apply_rules(frame(spark, rows)).collect()}
    assert (got[5000].kept, got[5000].failed_rules, got[5001].kept) == (False, "upper", True)
    assert (got[5002].failed_rules, got[5003].failed_rules) == ("symbols", "dup_lines")
    assert all(sum(got[i].kept for i, *_ in group) > 0.9 * len(group) for group in (plain, loud))


def test_buckets_are_mergeable_and_ordered(spark):
    xs = [*range(300), 1000, 12345, 10**9, 10**15]
    rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", rules.bucket(F.col("x")).alias("b"), rules.bucket_floor(rules.bucket(F.col("x"))).alias("low")).collect()
    for r in rows:
        assert r.low <= r.x and r.x - r.low <= r.x / 32 and (r.x >= 64 or r.low == r.x)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_mixture_realises_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(docs, repetition_limit=2.0).collect()}
    mixed = mixing.mix(docs, repetition_limit=2.0)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter(copies)
    assert min(copies.values()) >= 1
    by = mixing.mix_plan(docs, repetition_limit=2.0).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("m"), F.max("weight").alias("w")).collect()
    total = sum(r.m for r in by)
    for r in by:
        assert r.m <= 2.01 * r.t and abs(r.m / total - r.w) < 0.03


def test_entropy_target_and_budget(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix_plan(docs, target_entropy=2.98).collect()
    weights = {r.source: r.weight for r in plan}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - 2.98) < 1e-3
    budget = sum(r.n_tokens for r in plan) // 2
    half = mixing.mix_plan(docs, budget_tokens=budget).collect()
    used = sum(r.n_tokens * r.copies for r in half)
    assert 0.7 * budget < used <= budget + 20
    sharp = mixing.mix_plan(docs, target_entropy=2.6).collect()  # below the sources' own: alpha over 1
    weights = {r.source: r.weight for r in sharp}
    assert sharp[0].alpha > 1 and min(r.copies for r in sharp) >= 1
    assert abs(-sum(w * math.log(w) for w in weights.values() if w) - 2.6) < 1e-3
    with pytest.raises(ValueError, match="entropy can be"):
        mixing.mix_plan(docs, target_entropy=9.0)
    mixed = mixing.mix(frame(spark))
    assert mixed.columns == frame(spark).columns and mixing.mix_plan(frame(spark).limit(0), target_entropy=1.0).count() == 0


# --------------------------------------------------------------------------- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PRIVATE = [
    "mail a.b@c.de, x@y.z_q@r.st and é\U0001f600 a@b @c.d u@v.w.x@y.z",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 001.002.003.0000255 1.2.3 9.9.9.9",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 1234567890123456789012 0000000000000000",
    "+1 (767) 555-5699 +12 +1234567890123456 +49-30-1234567.",
    "visa 4111111111111111 4111111111111111 " * 300,
    "1" * 5000,
    "a.b" * 3000 + "@" + "c.d" * 3000,
    "write to jane.doe (at) example.com or call 555-123-4567; iban DE89 3704 0044 0532 0130 00 today",
    None,
    "",
]


def check_private(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    want = Counter((i, hashlib.sha256(",".join(slow_base(t)).encode()).hexdigest(), *[sum(s.startswith(k) for s in slow_base(t)) for k in BASE]) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert set(spans) >= set(slow_base(texts[r.doc_id]))
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    return {r.doc_id: r.spans for r in got}


def test_private_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_private(pii.query(spark, sf), [(r.doc_id, r.text) for r in docs.collect()])


def test_private_awkward_rows(spark):
    rows = [*enumerate(PRIVATE), (None, PRIVATE[0]), (2, PRIVATE[2])]
    docs = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], "doc_id long, text string, t string, spans_ string, k string")
    check_private(pii.find(docs), rows)
    assert pii.find(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = "".join(f"a{i}@b.de, {i:013d}; " for i in range(50_000))
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    began = time.time()
    row = pii.find(docs).first()
    assert row.n_email == 50_000 and row.base_sha256 == hashlib.sha256(",".join(slow_base(text)).encode()).hexdigest()
    out = pii.redact(docs).first()
    assert out.text == re.sub(r"a\d+@b\.de", "[EMAIL]", text) and out.n_chars == len(out.text)
    assert time.time() - began < 90


def test_redaction_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de now", "t", "s", 9, 1.0), (2, None, None, None, None, None)], "doc_id long, text string, t string, spans_ string, n_chars int, `x.y` double")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert tuple(out[1]) == (1, "mail [EMAIL] now", "t", "s", 16, 1.0) and tuple(out[2]) == (2, None, None, None, None, None)
    assert pii.redact(docs).dtypes == docs.dtypes and pii.redact(docs.limit(0)).count() == 0


def slow_free(base, more):
    """Of more the spans that touch no base span and no earlier one of more."""
    more = sorted(set(more), key=lambda x: (x[1], x[0], x[2]))
    hit = lambda a, b: a[1] < b[2] and b[1] < a[2]
    return sorted(base + [m for k, m in enumerate(more) if not any(hit(m, b) for b in base) and not any(hit(m, b) for b in more[:k])])


def test_added_spans_against_all_pairs(spark):
    rng = random.Random(4)
    votes = {j: 1 for j in pii.LABELERS}
    rows, want = [], []
    for i in range(60):
        spans = {(rng.randrange(5), a, a + rng.randrange(1, 9), rng.random() < 0.4) for a in (rng.randrange(80) for _ in range(rng.randrange(30)))}
        rows.append((i, [{"k": k, "start": a, "end": e, "base": b, **votes} for k, a, e, b in spans]))
        want.append(slow_free([s[:3] for s in spans if s[3]], [s[:3] for s in spans if not s[3]]))
    kind = "array<struct<k:int,start:bigint,end:bigint,base:boolean," + ",".join(f"{j}:int" for j in pii.LABELERS) + ">>"
    x = spark.createDataFrame(rows, f"keep int, spans {kind}")
    got = {r.keep: [tuple(s) for s in r["all"]] for r in pii.with_spans(x, [1.0] * pii.INPUTS).collect()}
    assert [got[i] for i in range(60)] == want


def slow_model(patterns, rounds=12):
    """Expectation maximisation over (votes, n) of one kind."""
    p = [0.9 if sum(v) > 0 else 0.1 for v, _ in patterns]
    for _ in range(rounds):
        n, y = sum(k for _, k in patterns), sum(k * q for (_, k), q in zip(patterns, p))
        share = lambda j, c, w, of: (sum(k * u for (v, k), u in zip(patterns, w) if v[j] == c) + 1) / (of + 3)
        no = [1 - q for q in p]
        p = [1 / (1 + math.exp(-(math.log((y + 1) / (n - y + 1)) + sum(math.log(share(j, c, p, y) / share(j, c, no, n - y)) for j, c in enumerate(v))))) for v, _ in patterns]
    return p


def test_label_model_against_plain_loops(spark):
    rng = random.Random(7)
    patterns = sorted({tuple(rng.choice((-1, 0, 1)) for _ in pii.LABELERS): rng.randrange(1, 90) for _ in range(25)}.items())
    pats = [{"hit": [3 * j + c + 1 for j, c in enumerate(v)], "n": float(n), "score": sum(v)} for v, n in patterns]
    x = spark.createDataFrame([(pats,)], "pats array<struct<hit:array<int>,n:double,score:int>>")
    got = x.select(F.expr(pii.label_model()).alias("p")).first().p
    assert max(abs(a - b) for a, b in zip(got, slow_model(patterns))) < 1e-9


def test_method_adds_spans_and_redaction_uses_all(spark):
    good = [f"please write to user{i}@example.com or contact user{i} (at) example.com; call +1 (767) 555-{1000 + i}, phone 767-555-{1000 + i}" for i in range(40)]
    bad = [f"part 123-456-{1000 + i}x and number 4111 1111 1111 {1000 + i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t, len(t), "keep") for i, t in enumerate(good + bad)], "doc_id long, text string, n_chars long, lang string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert sum("email" in s and s.count("email") == 2 for s in list(spans.values())[:40]) == 40
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert "@" not in out[0].text and "[EMAIL]" in out[0].text and "[PHONE]" in out[0].text and out[0].n_chars == len(out[0].text)
    clean = [i for i, s in spans.items() if not s]
    assert all(out[i].text == (good + bad)[i] for i in clean)
