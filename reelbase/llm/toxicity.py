"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input vector joins what its characters and the whole word say: class evidence of its character
n-grams (4 to 8 bytes) and of the word, counted on labelled rows, and trained embeddings of its character pairs and of the
hashed word. Texts are cut into overlapping windows of words; all are scored, and a text has its highest window's score.
As a word's vector doesn't depend on its place, its products with the input weights are kept for the words seen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, held_out, table
from .quality import best_cut, labelled, sample

WINDOW, STEP = 160, 120
GRAMS, TABLE = (4, 5, 6, 7, 8), 1 << 16
PAIRS, PAIR_DIM, WORDS, WORD_DIM = 1024, 4, 4096, 4
EVIDENCE = len(GRAMS) + 2
INPUT = EVIDENCE + PAIR_DIM + WORD_DIM
HIDDEN, ATTENTION = 10, 8
#: Labelled rows that the network is trained on, at most: of each class, and of text in all (characters).
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 12_000_000
#: Words whose products a worker keeps.
KEPT_WORDS = 120_000
#: Words after which a group of texts is scored, and windows of a longer text's piece; a group has fewer than KEPT_WORDS.
GROUP_WORDS, PIECE = 40_000, 600
#: Windows that go through the network at a time.
BATCH = 1024
EDGES = b".,;:!?\"'()[]{}<>*#%&$|-_"


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashes(words: list[bytes]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """For distinct words: n-gram hashes and the word each belongs to (by n; 2 are pairs), starts and word hashes.

    Words are laid out in one buffer between markers; a hash is a polynomial of its bytes.
    """
    cores = [b"\x01" + (w.strip(EDGES) or w) + b"\x02" for w in words]
    lengths = np.array([len(c) for c in cores])
    buffer = np.frombuffer(b"".join(cores), dtype=np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(cores)), lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(buffer)) - starts[of]
    grams, owner = {}, {}
    h = buffer.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + buffer[n - 1 :] + np.uint64(n) if len(h) > 1 else h[:0]
        if n == 2 or n in GRAMS:
            inside = place[: len(h)] + n <= lengths[of[: len(h)]]
            grams[n], owner[n] = (h[inside] >> np.uint64(20)).astype(np.int64), of[: len(h)][inside]
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), np.uint64(0x100000001B3), dtype=np.uint64))
    whole = np.add.reduceat(buffer * powers[place], starts) if len(cores) else np.zeros(0, dtype=np.uint64)
    return grams, owner, starts, (whole >> np.uint64(16)).astype(np.int64)


class Evidence:
    """Class evidence of hashed n-grams and words: smoothed log ratios of the shares of texts that have them."""

    def __init__(self, positive: dict[int, np.ndarray], negative: dict[int, np.ndarray], n_positive: int, n_negative: int):
        least = 2.0 / max(min(n_positive, n_negative), 1)
        share = lambda found, of: np.maximum(found - 1, 0) / max(of, 1) + least  # noqa: E731  what one text has says nothing
        self.tables = {n: np.log(share(positive[n], n_positive) / share(negative[n], n_negative)).astype(np.float32) for n in positive}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Evidence (words x EVIDENCE), and the words' pair hashes, owners and word hashes."""
        grams, owner, _, whole = hashes(words)
        out = np.zeros((len(words), EVIDENCE), dtype=np.float32)
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for k, n in enumerate(GRAMS):
            value = self.tables[n][grams[n] % TABLE]
            if len(value):
                first = np.flatnonzero(np.append(True, owner[n][1:] != owner[n][:-1]))
                out[owner[n][first], k] = np.maximum.reduceat(value, first)
            total += np.bincount(owner[n], value, len(words))
            count += np.bincount(owner[n], minlength=len(words))
        out[:, len(GRAMS)] = total / np.maximum(count, 1)
        out[:, len(GRAMS) + 1] = self.tables[0][whole % TABLE]
        return out, grams[2] % PAIRS, owner[2], whole % WORDS


def counted(texts: list[list[bytes]], y: np.ndarray) -> list[dict[int, np.ndarray]]:
    """For each class: in how many texts each hashed n-gram (and, under 0, word) occurs."""
    out = [{n: np.zeros(TABLE) for n in (0, *GRAMS)} for _ in range(2)]
    for words, label in zip(texts, y):
        if words:
            grams, _, _, whole = hashes(list(set(words)))
            for n in GRAMS:
                out[int(label)][n][np.unique(grams[n] % TABLE)] += 1
            out[int(label)][0][np.unique(whole % TABLE)] += 1
    return out


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STEP words until one reaches the end; one window if there is none."""
    return np.arange(0, max(n - WINDOW + STEP, STEP), STEP)


def pieces(words: list[bytes]):
    """A text's words in parts of at most PIECE windows; the parts' windows together are the text's."""
    for a in range(0, len(windows(len(words))), PIECE):
        yield words[a * STEP : (a + PIECE - 1) * STEP + WINDOW]


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights: projections of inputs to both directions' gates, recurrent weights, attention and output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.p = {
            "pair": 0.1 * init(PAIRS, PAIR_DIM) * math.sqrt(PAIRS), "word": 0.1 * init(WORDS, WORD_DIM) * math.sqrt(WORDS),
            "W": init(INPUT, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, dtype=np.float32), "Uf": init(HIDDEN, 3 * HIDDEN), "Ub": init(HIDDEN, 3 * HIDDEN),
            "A": init(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, dtype=np.float32), "q": init(ATTENTION), "o": init(2 * HIDDEN), "c": np.zeros(1, dtype=np.float32),
        }
        self.scale, self.cut = 1.0, 0.0

    def vectors(self, evidence, pairs, owner, whole) -> np.ndarray:
        n = len(evidence)
        mean = np.stack([np.bincount(owner, self.p["pair"][pairs, d], n) for d in range(PAIR_DIM)], axis=1) / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        return np.concatenate((evidence, mean, self.p["word"][whole]), axis=1).astype(np.float32)

    def products(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["W"] + self.p["b"]

    def direction(self, gates: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: bool = False):
        """Hidden states (T, n, H) over gate inputs (T, n, 3H)."""
        T, n, H = len(gates), gates.shape[1], HIDDEN
        out, h, saved = np.empty((T, n, H), dtype=np.float32), np.zeros((n, H), dtype=np.float32), {}
        for t in range(T - 1, -1, -1) if back else range(T):
            g = gates[t]
            r = h @ U
            zr = sigmoid(g[:, : 2 * H] + r[:, : 2 * H])
            z, reset = zr[:, :H], zr[:, H:]
            new = np.tanh(g[:, 2 * H :] + reset * r[:, 2 * H :])
            after = h + (z * mask[t][:, None]) * (new - h)
            if keep:
                saved[t] = (h, z, reset, new, r[:, 2 * H :])
            out[t] = h = after
        return out, saved

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, u @ self.p["q"], -1e9)
        w = np.exp(e - e.max(0)) * mask
        w /= np.maximum(w.sum(0), 1e-9)
        return (w[:, :, None] * states).sum(0), w, u

    def forward(self, products: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows: index (T, n) points into products, mask is 0 beyond a window's words."""
        H = 3 * HIDDEN
        f, _ = self.direction(products[:, :H][index], mask, self.p["Uf"], False)
        b, _ = self.direction(products[:, H:][index], mask, self.p["Ub"], True)
        return self.pooled(np.concatenate((f, b), axis=2), mask)[0] @ self.p["o"] + self.p["c"][0]

    def step(self, words, index, mask, y, weight) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch of windows over ``words`` (evidence, pairs, owner, whole)."""
        p, H = self.p, HIDDEN
        evidence, pairs, owner, whole = words
        x = self.vectors(*words)
        prod = self.products(x)
        sides = [self.direction(prod[:, k * 3 * H : (k + 1) * 3 * H][index], mask, p[u], bool(k), True) for k, u in enumerate(("Uf", "Ub"))]
        states = np.concatenate([s[0] for s in sides], axis=2)
        pool, att, u = self.pooled(states, mask)
        logit = pool @ p["o"] + p["c"][0]
        prob = sigmoid(logit)
        loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())
        d = (weight * (prob - y) / len(y)).astype(np.float32)
        g = {"o": pool.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * p["o"]
        dstates = att[:, :, None] * dpool
        de = (states * dpool).sum(2)
        de = att * (de - (att * de).sum(0))
        du = de[:, :, None] * p["q"] * (1 - u * u)
        g["q"] = np.einsum("tn,tna->a", de, u)
        g["A"], g["a"] = np.einsum("tnh,tna->ha", states, du), du.sum((0, 1))
        dstates = dstates + du @ p["A"].T
        dprod = np.zeros_like(prod)
        for k, name in enumerate(("Uf", "Ub")):
            U, saved, dh = p[name], sides[k][1], np.zeros((len(y), H), dtype=np.float32)
            g[name] = np.zeros_like(U)
            for t in range(len(index)) if k else range(len(index) - 1, -1, -1):
                h, z, reset, new, rn = saved[t]
                dh = dh + dstates[t][:, k * H : (k + 1) * H]
                m = mask[t][:, None]
                dn = dh * z * m * (1 - new * new)
                dz = dh * m * (new - h) * z * (1 - z)
                dr = dn * rn * reset * (1 - reset)
                dgate = np.concatenate((dz, dr, dn), axis=1)
                drec = np.concatenate((dz, dr, dn * reset), axis=1)
                g[name] += h.T @ drec
                dh = dh * (1 - z * m) + drec @ U.T
                np.add.at(dprod[:, k * 3 * H : (k + 1) * 3 * H], index[t], dgate)
        g["W"], g["b"] = x.T @ dprod, dprod.sum(0)
        dx = dprod @ p["W"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], whole, dx[:, EVIDENCE + PAIR_DIM :])
        share = dx[:, EVIDENCE : EVIDENCE + PAIR_DIM] / np.maximum(np.bincount(owner, minlength=len(x)), 1)[:, None]
        g["pair"] = np.stack([np.bincount(pairs, share[owner, j], PAIRS) for j in range(PAIR_DIM)], axis=1)
        return loss, g

    def fit(self, batches: list, epochs: int, rate: float = 0.02) -> None:
        first, second, n = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        total = epochs * len(batches)
        for _ in range(epochs):
            for batch in batches:
                _, g = self.step(*batch)
                n += 1
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= (rate * 0.5 * (1 + math.cos(math.pi * n / total)) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)


class Detector:
    """The network, its evidence, and the products of the words that a worker has seen."""

    def __init__(self, network: Network, evidence: Evidence):
        self.network, self.evidence = network, evidence
        self.known: dict[bytes, int] = {}
        self.kept = np.zeros((1, 6 * HIDDEN), dtype=np.float32)

    def __getstate__(self):
        return {"network": self.network, "evidence": self.evidence}

    def __setstate__(self, x):
        self.__init__(x["network"], x["evidence"])

    def learn(self, words: set[bytes]) -> None:
        """Know all of a group's words: those of earlier groups go first where they don't fit beside them."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list(words)
        need = len(self.known) + len(new) + 1
        if need > len(self.kept):
            self.kept = np.concatenate((self.kept, np.zeros((need + need // 2 - len(self.kept), 6 * HIDDEN), dtype=np.float32)))
        for a in range(0, len(new), 20_000):
            part, at = new[a : a + 20_000], len(self.known) + 1
            self.kept[at : at + len(part)] = self.network.products(self.network.vectors(*self.evidence.of(part)))
            self.known.update(zip(part, range(at, at + len(part))))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's logit of each text."""
        out = np.full(len(texts), -np.inf)
        group, size = [], 0
        for i, t in enumerate(texts):
            words = split(t)
            for part in pieces(words):
                group.append((i, part))
                size += len(part) + WINDOW
                if size > GROUP_WORDS:
                    self.score_group(group, out)
                    group, size = [], 0
        if group:
            self.score_group(group, out)
        return out

    def score_group(self, group: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        self.learn(set().union(*(words for _, words in group)))
        flat, starts, owner, lengths, at = [], [], [], [], 0
        for j, words in group:
            ids = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            s = windows(len(ids))
            flat.append(ids)
            starts.append(s + at)
            owner.append(np.full(len(s), j))
            lengths.append(np.minimum(WINDOW, len(ids) - s))
            at += len(ids)
        flat = np.concatenate((*flat, np.zeros(WINDOW, dtype=np.int64)))
        starts, owner, lengths = np.concatenate(starts), np.concatenate(owner), np.concatenate(lengths)
        for a in range(0, len(starts), BATCH):
            s, n = starts[a : a + BATCH], lengths[a : a + BATCH]
            t = np.arange(max(int(n.max()), 1))[:, None]
            mask = (t < n).astype(np.float32)
            index = np.where(mask > 0, flat[np.minimum(s + t, len(flat) - 1)], 0)
            np.maximum.at(out, owner[a : a + BATCH], self.network.forward(self.kept, index, mask))

    def scores(self, texts) -> np.ndarray:
        n = self.network
        return 1 / (1 + np.exp(-np.clip(n.scale * (self.logits(texts) - n.cut) + math.log(0.3 / 0.7), -30, 30)))


def fitted(texts: list[str | None], y: np.ndarray, epochs: int = 8, seed: int = 4) -> Detector:
    """Train on texts with labels 0 and 1.

    Evidence for training windows is counted without the fold that a text is in, so the network learns how far
    evidence holds for other texts. Of a text the window with most evidence is used, of a clean one another, too.
    A fifth of the texts is set aside for the threshold, at which the score is 0.3.
    """
    rng = np.random.default_rng(seed)
    one: dict[bytes, bytes] = {}  # equal words share an object: the sample has millions of words and few that differ
    words = [[one.setdefault(w, w) for w in split(t)] for t in texts]
    fold = np.arange(len(texts)) % 5
    counts = [counted([w for w, f in zip(words, fold) if f == k], y[fold == k]) for k in range(5)]
    sizes = [[int(((fold == k) & (y == c)).sum()) for c in (0, 1)] for k in range(5)]

    def evidence(folds) -> Evidence:
        total = [{n: sum(counts[k][c][n] for k in folds) for n in (0, *GRAMS)} for c in (0, 1)]
        return Evidence(total[1], total[0], sum(sizes[k][1] for k in folds), sum(sizes[k][0] for k in folds))

    network, examples = Network(), []
    for k in range(4):
        e = evidence([j for j in range(4) if j != k])
        for i in np.flatnonzero(fold == k):
            w = words[i]
            if not w:
                continue
            distinct = list(set(w))
            known = dict(zip(distinct, np.maximum(e.of(distinct)[0][:, : len(GRAMS)].max(1), 0)))
            total = np.concatenate(([0.0], np.cumsum([known[x] for x in w])))
            starts = windows(len(w))
            best = int(np.argmax(total[np.minimum(starts + WINDOW, len(w))] - total[starts]))
            picks = {best} | ({int(rng.integers(len(starts)))} if y[i] == 0 else set())
            examples += [(w[starts[p] : starts[p] + WINDOW], y[i], k) for p in sorted(picks)]
    evidence_of = {k: evidence([j for j in range(4) if j != k]) for k in range(4)}
    batches = []
    for k in range(4):
        own = [x for x in examples if x[2] == k]
        order = rng.permutation(len(own))
        for a in range(0, len(own), 64):
            part = [own[i] for i in order[a : a + 64]]
            distinct = list({x for w, _, _ in part for x in w})
            at = dict(zip(distinct, range(len(distinct))))
            index, mask = np.zeros((WINDOW, len(part)), dtype=np.int64), np.zeros((WINDOW, len(part)), dtype=np.float32)
            for j, (w, _, _) in enumerate(part):
                index[: len(w), j], mask[: len(w), j] = [at[x] for x in w], 1
            label = np.array([x[1] for x in part], dtype=np.float32)
            batches.append((evidence_of[k].of(distinct), index, mask, label, np.where(label == 1, 1.5, 1.0).astype(np.float32)))
    rng.shuffle(batches)
    epochs = max(epochs, min(60, 600 // max(len(batches), 1)))
    network.fit(batches, epochs)
    detector = Detector(network, evidence(range(4)))
    aside = np.flatnonzero(fold == 4)
    if len(set(y[aside])) == 2:
        z = detector.logits([texts[i] for i in aside])
        network.cut, network.scale = best_cut(z, y[aside], balanced=False), 3.0 / max(float(np.std(z)), 1e-3)
    return Detector(network, evidence(range(5)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (4, 2), sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Detector:
    """Train on at most sample_rows labelled rows of each class and sample_chars characters, half of them of each class.

    Rows are taken in hashed order, whole texts only: a text that no longer fits is passed over.
    """
    parts = []
    for value in (0, 1):
        x = sample(docs, labelled(labels.where(col("toxic") == value), "toxic", held, sample_rows, id_col), id_col, text_col)
        room, taken = sample_chars // 2, []
        for r in x.where(F.coalesce(F.length("t"), F.lit(0)) <= room).orderBy(F.xxhash64("id"), "id").toLocalIterator():
            if (n := len(r["t"] or "")) <= room:
                room -= n
                taken.append((r["t"], r["y"]))
        parts.append(taken)
    both = [*parts[0], *parts[1]]
    order = np.random.default_rng(5).permutation(len(both))
    y = np.array([both[i][1] for i in order])
    if len(set(y.tolist())) < 2:
        none = {n: np.zeros(TABLE) for n in (0, *GRAMS)}
        return Detector(Network(), Evidence(none, none, 0, 0))
    return fitted([both[i][0] for i in order], y)


def score(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (4, 2), threshold: float = 0.3) -> DataFrame:
    """(<id>, held_out, score, predicted) for every row of docs.

    Cases: null and empty texts are one window without words; repeated rows and null ids (never held out) are
    scored like others, equal texts alike up to rounding; without labels of both classes the network is untrained;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                p = detector.scores(part.column(2).to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    x = docs.select(col(id_col).alias("id"), held_out(id_col, *held).alias("held_out"), col(text_col).alias("t"))
    return x.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, detector: Detector, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Docs without the rows that score at least the threshold; same columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                yield part.filter(pa.array(detector.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
