"""Secret scan: base patterns, and a character convolutional network over every candidate and its context.

Candidates are the base patterns' spans, long mixed tokens and values of key-like names. The network (numpy) reads the
characters before, in and after a candidate; candidates longer than one view are read in several, and the highest score
counts. It is trained on findings labelled by the base patterns in a bounded sample of documents, together with drawn
findings of forms that the patterns miss; other tokens of the sample are examples of what is no secret only where their
form is that of a number, an address, a date or joined words, as secrets may be among the rest. Probabilities are
calibrated on findings set aside. Base spans stay whatever their score, so the threshold decides on the others alone: it
is the highest with which the required share of the set-aside secrets beyond the base patterns is found.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, table

KINDS = ("assign", "access", "hex", "other")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Without one of these (in lower case) a text has no match of ASSIGN.
NAMES = (b"passw", b"secret", b"token", b"api")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{16,}")
VALUE = re.compile(r"""(?:pwd|pass|auth|bearer|credential|private[_ ]?key|access[_ ]?key|client[_ ]?secret)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.A | re.I)

#: Forms that are no secret: numbers, addresses, dates and versions, and words joined by marks.
HARMLESS = re.compile(r"[0-9.,:/_=+-]+|(?:https?:)?/?/?(?:[A-Za-z0-9-]+\.)+[a-z]{2,4}(?:/[A-Za-z0-9._-]*)*|(?:[a-z]+|[0-9]{1,4})(?:[-_./][0-9]*[a-z]+[0-9]{0,2}|[-_./][0-9]{1,4})+", re.A)

BEFORE, INSIDE, AFTER = 24, 48, 8
VIEW = BEFORE + INSIDE + AFTER
EMBED, WIDTH, FILTERS = 8, 5, 16
#: Documents that training findings are taken from, at most; findings of each label; characters of a finding.
SAMPLE_DOCS, SAMPLE_FINDINGS, SAMPLE_LENGTH = 4000, 3000, 4096
#: Share of the secrets beyond the base patterns that the threshold keeps.
RECALL = 0.98


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' spans, sorted."""
    low = text.encode().lower() if low is None else low
    out = []
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of candidates that don't touch base spans, sorted and apart from each other."""
    found = {(m.start(), m.end()) for m in TOKEN.finditer(text)} if any(c.isdigit() for c in text) else set()
    if ":" in text or "=" in text:
        found |= {m.span(1) for m in VALUE.finditer(text)}
    out, at, spans = [], 0, [(a, b) for a, _, b in base]
    k = 0
    for a, b in sorted(found):
        while k < len(spans) and max(x for _, x in spans[max(0, k - 2) : k + 1]) <= a:
            k += 1
        if a >= at and not any(x < b and a < y for x, y in spans[max(0, k - 2) : k + 3]):
            out.append((a, b))
            at = b
    return out


def views(text: str, start: int, end: int) -> np.ndarray:
    """(n, VIEW) character codes around parts of text[start:end]; 0 is padding, 127 any other character."""
    out = []
    for a in range(start, end, INSIDE):
        b = min(end, a + INSIDE)
        before, after = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        out.append(before.rjust(BEFORE, "\0") + text[a:b].ljust(INSIDE, "\0") + after.ljust(AFTER, "\0"))
    return np.minimum(np.frombuffer("".join(out).encode("utf-32-le"), dtype=np.uint32).reshape(-1, VIEW), 127).astype(np.int64)


class Convolution:
    """Embedding, one convolution, maxima over the context's and the candidate's places, logistic output."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": 0.3 * rng.standard_normal((128, EMBED)), "k": rng.standard_normal((WIDTH * EMBED, FILTERS)) / math.sqrt(WIDTH * EMBED),
            "b": np.zeros(FILTERS), "o": 0.1 * rng.standard_normal(3 * FILTERS), "c": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def parts(self, x: np.ndarray):
        """Columns, activations and the pooled maxima of views."""
        emb = self.p["e"][x]
        emb[x == 0] = 0
        n = VIEW - WIDTH + 1
        cols = np.concatenate([emb[:, j : j + n] for j in range(WIDTH)], axis=2)
        act = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        cut = BEFORE - WIDTH // 2
        inside = act[:, cut : cut + INSIDE]
        filled = (x[:, cut + WIDTH // 2 : cut + WIDTH // 2 + INSIDE] != 0).astype(float)[:, : inside.shape[1]]
        mean = (inside * filled[:, :, None]).sum(1) / np.maximum(filled.sum(1), 1)[:, None]
        at = (act[:, :cut].argmax(1), cut + inside.argmax(1))
        top = [np.take_along_axis(act, a[:, None, :], 1)[:, 0] for a in at]
        return cols, act, at, filled, cut, np.concatenate((*top, mean), axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.parts(x[a : a + 512])[-1] @ self.p["o"] + self.p["c"][0] for a in range(0, len(x), 512)] or [np.zeros(0)])

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        cols, act, at, filled, cut, pool = self.parts(x)
        prob = 1 / (1 + np.exp(-np.clip(pool @ self.p["o"] + self.p["c"][0], -30, 30)))
        d = (prob - y) / len(y)
        g = {"o": pool.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * self.p["o"]
        dact = np.zeros_like(act)
        for k, a in enumerate(at):
            np.put_along_axis(dact, a[:, None, :], np.take_along_axis(dact, a[:, None, :], 1) + dpool[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
        dact[:, cut : cut + filled.shape[1]] += (filled / np.maximum(filled.sum(1), 1)[:, None])[:, :, None] * dpool[:, None, 2 * FILTERS :]
        dact *= act > 0
        flat = dact.reshape(-1, FILTERS)
        g["k"], g["b"] = cols.reshape(-1, WIDTH * EMBED).T @ flat, flat.sum(0)
        dcols = dact @ self.p["k"].T
        g["e"] = np.zeros_like(self.p["e"])
        n = dcols.shape[1]
        for j in range(WIDTH):
            np.add.at(g["e"], x[:, j : j + n], dcols[:, :, j * EMBED : (j + 1) * EMBED])
        g["e"][0] = 0
        loss = float(-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)).mean())
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first, second, n = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                _, g = self.step(x[order[a : a + batch]], y[order[a : a + batch]])
                n += 1
                for k, v in g.items():
                    first[k], second[k] = 0.9 * first[k] + 0.1 * v, 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, decided: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps over all, then the recall-constrained threshold over the decided ones."""
        z, a, b = self.logits(x), 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, r = p * (1 - p) + 1e-6, y - p
            h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
            da, db = np.linalg.solve(h, [(r * z).sum() - 1e-2 * (a - 1), r.sum()])
            a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
        self.slope, self.shift = max(a, 0.05), b
        kept = np.sort(self.scores(x)[(y == 1) & decided])
        self.threshold = float(kept[int((1 - recall) * len(kept))]) if len(kept) else 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -30, 30)))


def drawn(n: int, seed: int = 8) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Labelled findings made from a seed: secrets in forms beyond the base patterns, and look-alikes that are none."""
    rng = np.random.default_rng(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    pick = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    of = lambda xs: xs[int(rng.integers(len(xs)))]
    vowels, consonants = "aeiou", "bcdfglmnprstv"
    prose = lambda k: " ".join("".join(pick(consonants, 1) + pick(vowels, 1) for _ in range(rng.integers(1, 4))) for _ in range(k))
    out, y = [], []
    for i in range(n):
        head, tail = prose(int(rng.integers(1, 6))) + " ", " " + prose(3)
        size = int(rng.integers(16, 64))
        if i % 2:
            name = of(["pwd", "auth", "bearer", "credential", "private_key", "access_key", "client_secret"])
            value = pick(letters + "0123456789", size) if rng.random() < 0.5 else pick(letters + "0123456789+/", size) + of(["", "=", "=="])
            head += of([name + of([": ", "=", ' = "', ":"]), name + of([" = ", ': "', "="]), ""])
            value = of(["", "ghp_", "sk-", "xoxb-"]) + value if head.endswith(" ") else value
        else:
            value = of(
                [
                    f"mail{rng.integers(10)}.example.com", f"{prose(1)}.{rng.integers(100)}.{prose(1)}.{pick(vowels, 2)}-{rng.integers(9)}", f"{rng.integers(1000, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}.{rng.integers(10**5)}",
                    pick("0123456789", int(rng.integers(16, 24))), f"www.{prose(1)}.org/{prose(1)}/{rng.integers(1000)}.html", f"version-{rng.integers(20)}.{rng.integers(20)}.{rng.integers(99)}-{prose(1)}",
                    "-".join(prose(1) for _ in range(4)) + str(rng.integers(9)), f"{prose(1)}_{prose(1)}_{prose(1)}_{rng.integers(100)}",
                ]
            )
            head += of(["", "", "see: ", "at = ", "pass: "])
        out.append((head + value + tail, len(head), len(head) + len(value)))
        y.append(i % 2)
    return out, y


def trained(texts: list[str], recall: float = RECALL) -> Convolution:
    """Train on the base patterns' findings in texts and on drawn ones; a third of the drawn and a fifth of the others are set aside."""
    x, y = [], []
    for t in texts:
        base = base_spans(t)
        for a, kind, b in base:
            if kind == 0:  # the value, as other candidates are values
                a = ASSIGN.match(t, a).start(2)
            x.append(views(t, a, b)[:1])
            y.append(1)
        for a, b in other_candidates(t, base):
            # values of key-like names and free forms are left to the drawn labels
            if HARMLESS.fullmatch(t, a, b) and not VALUE.search(t, max(0, a - 32), b):
                x.append(views(t, a, b)[:1])
                y.append(0)
    rng = np.random.default_rng(9)
    order = rng.permutation(len(x))
    pos, neg = [i for i in order if y[i]][:SAMPLE_FINDINGS], [i for i in order if not y[i]][:SAMPLE_FINDINGS]
    findings, labels = drawn(3000)
    xs = np.concatenate([x[i] for i in (*pos, *neg)] + [views(*f)[:1] for f in findings])
    ys = np.array([1.0] * len(pos) + [0.0] * len(neg) + labels)
    own = np.arange(len(xs)) >= len(pos) + len(neg)
    aside = rng.random(len(xs)) < np.where(own, 1 / 3, 1 / 5)
    net = Convolution()
    net.fit(xs[~aside], ys[~aside])
    net.calibrate(xs[aside], ys[aside], own[aside], recall)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Convolution:
    """Train on at most sample_docs documents, in hashed order; findings of at most SAMPLE_LENGTH characters with their context, not whole texts, reach the driver."""
    chosen = docs.select(col(id_col).alias("c")).where("c IS NOT NULL").distinct().orderBy(F.xxhash64("c"), "c").limit(sample_docs)
    x = docs.select(col(id_col).alias("i"), col(text_col).alias("t")).join(F.broadcast(chosen), F.col("i") == F.col("c")).select("t")

    def run(batches):  # a snippet of each finding
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                base = base_spans(t or "")
                spans = [(a, e) for a, _, e in base] + other_candidates(t or "", base)
                out += [t[max(0, a - 48) : e + 16] for a, e in spans if e - a <= SAMPLE_LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["t"])

    snippets = x.mapInArrow(run, "t string").distinct().orderBy(F.xxhash64("t")).limit(4 * SAMPLE_FINDINGS)
    return trained([r["t"] for r in snippets.collect()])


def scan(docs: DataFrame, net: Convolution, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>, n_assign, n_access, n_hex, base_sha256, spans, scores) for every row of docs; scores are the spans' probabilities, in thousandths.

    Cases: null and empty texts have no spans (the digest is that of the empty string); repeated rows, ties and null
    ids are scanned row by row; an empty table gives no rows; other columns are ignored.
    """

    def spans_of(base: list, more: list[tuple[int, int]], p: np.ndarray) -> tuple:
        own, rest = p[: len(base)], p[len(base) :]
        every = sorted([(*s, x) for s, x in zip(base, own)] + [(a, 3, b, x) for (a, b), x in zip(more, rest) if x >= net.threshold])
        show = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in xs)
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        return (*n, hashlib.sha256(show(base).encode()).hexdigest(), show(every), ",".join(str(round(1000 * x)) for *_, x in every))

    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "scores": pa.string()}

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = [other_candidates(t, x) for t, x in zip(texts, base)]
                p = probabilities(net, texts, [[*((ASSIGN.match(t, a).start(2) if k == 0 else a, e) for a, k, e in x), *m] for t, x, m in zip(texts, base, more)])
                rows = [spans_of(*x) for x in zip(base, more, p)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values()))], names=["id", *kinds])

    kind = dict(docs.dtypes)[id_col]
    x = docs.select(col(id_col).alias("id"), col(text_col).alias("t"))
    return x.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string").withColumnRenamed("id", id_col)


#: Views that are scored at a time.
BATCH = 4096


def probabilities(net: Convolution, texts: list[str], spans: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """For each text: the highest probability among each span's views."""
    out = [np.zeros(len(s)) for s in spans]
    seen, owner, n = [], [], 0

    def flush() -> None:
        p = net.scores(np.concatenate(seen))
        at = 0
        for (i, k), v in zip(owner, seen):
            out[i][k] = max(out[i][k], p[at : at + len(v)].max())
            at += len(v)
        seen.clear()
        owner.clear()

    for i, (t, s) in enumerate(zip(texts, spans)):
        for k, (a, b) in enumerate(s):
            for c in range(a, b, BATCH * INSIDE):  # a very long span in parts, each with its context
                seen.append(views(t, c, min(b, c + BATCH * INSIDE)))
                owner.append((i, k))
                n += len(seen[-1])
                if n >= BATCH:
                    flush()
                    n = 0
    if seen:
        flush()
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
