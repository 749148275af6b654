"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops
from .common import in_arrow, slices, table
from .labelled import scored, training_rows

WORDS = 1 << 14  # buckets of hashed words
BINS = 12  # of each structure statistic
RANK = 8
SAMPLE = 12_000  # labelled rows it is fitted on, at most
HELD_OUT = (5, 0)
CUT = 0.3
STATS = ["upper", "digit", "mark", "top_mark", "bar", "marked_end", "word_length", "log_words", "log_chars", "line_length", "repeated_words", "repeated_lines", "repeated_halves", "long_words", "ascii_letters"]
U = np.uint64


def structure(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(statistics of each text, one column for each name in STATS; distinct word buckets of each text).

    Length, the only metadata a score may use, is among them. All shares are of the whole text."""
    out = np.zeros((len(texts), len(STATS)))
    buckets: list[np.ndarray] = []
    for first, part in textops.chunks(texts):
        h, n = textops.words(part)
        code = (h >> U(50)).astype(np.int32)
        c = np.frombuffer((" ".join(part) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
        start = np.cumsum(size) - size
        kind = np.full(c.shape, 3, np.int8)  # 0 lower, 1 upper, 2 digit, 3 other mark, 4 blank, 5 other letter
        kind[(c >= 97) & (c <= 122)] = 0
        kind[(c >= 65) & (c <= 90)] = 1
        kind[(c >= 48) & (c <= 57)] = 2
        kind[(c == 32) | ((c >= 9) & (c <= 13))] = 4
        kind[(c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c < 0x2C00))] = 5
        upper_accent = (c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)
        kind[upper_accent] = 1
        sums = lambda m: np.add.reduceat(m.astype(np.int32), start)
        letters = np.maximum(1, sums(kind <= 1) + sums(kind == 5))
        full = np.maximum(1, sums(kind != 4))
        nw = np.maximum(1, n)
        blank_after = np.append(kind[1:], 4) == 4
        s = out[first : first + len(part)]
        s[:, 0] = sums(kind == 1) / letters
        s[:, 1] = sums(kind == 2) / full
        plain = (c == 46) | (c == 44) | (c == 39) | (c == 45)
        mark = (kind == 3) & ~plain
        s[:, 2] = sums(mark) / full
        s[:, 4] = sums(c == 124) / nw
        s[:, 5] = sums(mark & blank_after) / nw
        s[:, 6] = full / nw
        s[:, 7] = np.log1p(n)
        s[:, 8] = np.log1p(size - 1)
        s[:, 14] = sums((kind <= 1) & (c < 128)) / letters
        at = 0
        for k, (t, m) in enumerate(zip(part, n.tolist())):
            w = h[at : at + m]
            lines = [x for x in t.split("\n") if x]
            s[k, 9] = np.log1p(len(t) / max(1, len(lines)))
            s[k, 11] = 1 - len(set(lines)) / max(1, len(lines))
            if m:
                s[k, 10] = 1 - len(np.unique(w)) / m
                if m >= 8:
                    x = w[:-3] * textops.MIX[2] + w[1:-2] * textops.MIX[3] + w[2:-1] * textops.MIX[4] + w[3:] * textops.MIX[5]
                    s[k, 12] = 1 - len(np.unique(x)) / len(x)
                s[k, 13] = sum(len(x) > 18 for x in t.split()) / m
            if mark_n := int(s[k, 2] * full[k] + 0.5):
                seg = c[start[k] : start[k] + size[k]][mark[start[k] : start[k] + size[k]]]
                s[k, 3] = np.bincount(seg % 4096).max() / max(1, m) if mark_n else 0
            buckets.append(np.unique(code[at : at + m]))
            at += m
    return out, buckets


def features(texts: list[str], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, number) of the active features of each text: words share a total square of 1, each statistic's
    bin is 1 / sqrt(number of statistics)."""
    stats, buckets = structure(texts)
    bins = (stats[:, :, None] > edges[None, :, :]).sum(2) + np.arange(len(STATS)) * BINS + WORDS
    index = np.concatenate([np.concatenate((b, k)) for b, k in zip(buckets, bins)]) if texts else np.zeros(0, np.int64)
    value = np.concatenate([np.concatenate((np.full(len(b), len(b) ** -0.5 if len(b) else 0.0), np.full(len(STATS), 1.0))) for b in buckets]) if texts else np.zeros(0)
    return index.astype(np.int64), value, np.array([len(b) + len(STATS) for b in buckets], np.int64)


def margins(model, index, value, number) -> tuple[np.ndarray, np.ndarray]:
    """w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j of each row, in time linear in its features: the pairs are half
    of (sum of v_i x_i) squared minus the sum of (v_i x_i) squared. Also the inner sums, for training."""
    first = np.cumsum(number) - number
    vx = model["v"][index] * value[:, None]
    s = np.add.reduceat(vx, first, axis=0)
    q = np.add.reduceat((vx * vx).sum(1), first)
    return model["w0"] + np.add.reduceat(model["w"][index] * value, first) + 0.5 * ((s * s).sum(1) - q), s


def fit(index, value, number, y, rank: int = RANK, epochs: int = 8, rate: float = 0.15, decay: float = 2e-5, batch: int = 64, seed: int = 7) -> dict:
    """Logistic loss, AdaGrad over mini-batches, in a fixed order from a seed."""
    rnd = np.random.default_rng(seed)
    size = WORDS + BINS * len(STATS)
    p = min(max(float(np.mean(y)), 1e-3), 1 - 1e-3) if len(y) else 0.5
    m = {"w0": np.log(p / (1 - p)), "w": np.zeros(size), "v": rnd.normal(0, 0.05, (size, rank))}
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    first = np.cumsum(number) - number
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = number[rows]
            where = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, x = index[where], value[where]
            z, s = margins(m, i, x, n)
            g = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
            gx = np.repeat(g, n) * x
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, gx, len(u)) + decay * m["w"][u]
            full = gx[:, None] * (np.repeat(s, n, axis=0) - m["v"][i] * x[:, None])
            dv = np.stack([np.bincount(inv, full[:, k], len(u)) for k in range(rank)], 1) + decay * m["v"][u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += g.sum() ** 2
            m["w"][u] -= rate * dw / np.sqrt(gw[u])
            m["v"][u] -= rate * dv / np.sqrt(gv[u])
            m["w0"] -= rate * g.sum() / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, about 1 MB. Statistics and word buckets are taken on the executors; the driver gets some hundred
    numbers a row of `sample` rows at most. Without labelled rows every score is 0.5."""

    def run(batches):
        for b in slices(batches):
            s, w = structure(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array([x.astype("<i4").tobytes() for x in w], pa.binary())], names=["y", "stats", "words"])

    rows = training_rows(docs, labels, "quality", *HELD_OUT, sample).transform(in_arrow, run, "y double, stats array<double>, words binary").collect()
    if not rows:
        return {"w0": 0.0, "w": np.zeros(WORDS + BINS * len(STATS)), "v": np.zeros((WORDS + BINS * len(STATS), 1)), "edges": np.zeros((len(STATS), BINS - 1))}
    rows.sort(key=lambda r: (r.words, r.stats, r.y))  # the order in which tasks end must not matter
    stats = np.array([r.stats for r in rows])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    low, high = stats.min(0), stats.max(0)
    flat = edges[:, 0] == edges[:, -1]  # mostly one value: even steps
    edges[flat] = np.linspace(low[flat], high[flat], BINS + 1).T[:, :-2]
    words = [np.frombuffer(r.words, "<i4").astype(np.int64) for r in rows]
    bins = (stats[:, :, None] > edges[None, :, :]).sum(2) + np.arange(len(STATS)) * BINS + WORDS
    index = np.concatenate([np.concatenate((w, k)) for w, k in zip(words, bins)])
    value = np.concatenate([np.concatenate((np.full(len(w), len(w) ** -0.5 if len(w) else 0.0), np.ones(len(STATS)))) for w in words])
    m = fit(index, value, np.array([len(w) + len(STATS) for w in words]), np.array([r.y for r in rows]))
    return m | {"edges": edges}


def score(model: dict, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, part in textops.chunks(texts):
        z, _ = margins(model, *features(part, model["edges"]))
        out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null and empty texts get the score of their structure; very long texts are described whole; repeated rows score
    alike; labels other than 0 and 1 and null ids teach nothing; ties in the sample's order go by id and label; empty
    tables give no rows, or scores of 0.5 where only labels are missing; columns beside doc_id and text are ignored."""
    return scored(docs, score, docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)), *HELD_OUT, CUT)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
