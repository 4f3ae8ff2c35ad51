"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded (byte-pair
histogram and a few ratios, then a learned tanh layer). A gated attention, learned from
document labels alone, weighs the passages; the weighted sum is scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, labelled_sample, map_texts

PASSAGE = 64
PAIRS = 64
RATIOS = 10
INPUTS = PAIRS + RATIOS
#: Training texts of each class at most.
SAMPLE = 1500

_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.uint8)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 3, np.uint8)  # punctuation and controls
    kind[[9, 10, 13, 32]] = 4
    kind[ord("A") : ord("Z") + 1] = 0
    kind[ord("0") : ord("9") + 1] = 1
    kind[128:] = 2
    kind[ord("a") : ord("z") + 1] = 5
    return kind


_KIND = _byte_kinds()


def passages(text: str | None) -> list[list[str]]:
    """Runs of PASSAGE words; a text without words has one passage without words."""
    words = text.split() if text else []
    return [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]


def encode_inputs(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all passages of all texts, and where each text's passages start."""
    starts, chunks, ratios = [], [], []
    for text in texts:
        starts.append(len(chunks))
        seen: set[int] = set()
        for ws in passages(text):
            n, joined = len(ws), " ".join(ws)
            again = joined in seen
            seen.add(joined)
            # how much of it repeats: distinct words, a word right after itself, the passage itself
            twice = sum(map(str.__eq__, ws[1:], ws))
            ratios.append((len(set(ws)) / n if n else 1.0, twice / n if n else 0.0, float(again), n / PASSAGE, min(len(joined) / max(n, 1) / 16, 4.0)))
            chunks.append(joined.encode("utf-8", "surrogatepass"))
    # a blank behind each passage: its last pair doesn't depend on what comes next
    data = np.frombuffer(b" ".join(chunks) + b" ", np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    inside = np.ones(len(data), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    here = np.flatnonzero(inside)
    which = np.repeat(np.arange(len(chunks), dtype=np.int64), sizes)
    pair = _PAIR[(data[here].astype(np.uint16) << np.uint16(8)) | data[here + 1]]
    pairs = np.bincount(which * PAIRS + pair, minlength=len(chunks) * PAIRS).reshape(-1, PAIRS)
    kinds = np.bincount(which * 6 + _KIND[data[here]], minlength=len(chunks) * 6).reshape(-1, 6)
    share = np.maximum(sizes, 1)[:, None]
    x = np.concatenate([np.sqrt(pairs / share) * 2 - 0.2, np.sqrt(kinds[:, :5] / share), np.array(ratios)], axis=1)
    return x.astype(np.float32), np.array(starts, np.int64)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(p, x, starts):
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (v * u) @ p["a"]
    counts = np.diff(np.append(starts, len(x)))
    w = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    w /= np.repeat(np.add.reduceat(w, starts), counts)
    z = np.add.reduceat(w[:, None] * h, starts)
    return h, v, u, w, z, counts, z @ p["c"] + p["d"]


def _grads(p, x, starts, y) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of bags."""
    h, v, u, w, z, counts, logit = _forward(p, x, starts)
    dl = (_sigmoid(logit) - y) / len(y)
    dz = np.repeat(dl[:, None] * p["c"], counts, axis=0)
    dw = (dz * h).sum(1)
    de = w * (dw - np.repeat(np.add.reduceat(w * dw, starts), counts))
    dg = de[:, None] * p["a"]
    dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
    dh = (w[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}


def train(texts: list[str], labels: list[int], hidden: int = 16, gate: int = 8, steps: int = 160, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam over whole bags. Without both classes the score is the share of label 1 (0.5 without rows)."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, INPUTS**-0.5, (INPUTS, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, 0.1, gate), "c": np.zeros(hidden), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    p["d"][:] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return p
    x, starts = encode_inputs(texts)
    p["c"] = rng.normal(0, hidden**-0.5, hidden).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for i in range(1, steps + 1):
        g = _grads(p, x, starts, y)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - (0.03 * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8) + 1e-4 * 0.03 * p[k] * (k != "d")).astype(np.float32)
    return p


def score_texts(p: dict[str, np.ndarray], texts: list) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x, starts = encode_inputs(texts)
    return _sigmoid(_forward(p, x, starts)[-1].astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, bound: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    The model is fitted on at most ``bound`` labelled texts of each class outside the
    held-out bucket (crc32 of the id's text modulo ``parts`` equal to ``held``). Null and
    empty texts are a bag of one passage without words and get a score too. Null ids stay
    and are never trained on; repeated rows stay; further columns are ignored; without
    usable labels every score is 0.5; an empty table gives an empty result.
    """
    sample = labelled_sample(docs, labels, "quality", parts, held, bound, "min", id_col, text_col)
    fitted = train([t for t, _ in sample], [y for _, y in sample])
    give_back()
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def setup():
        return lambda texts: [score_texts(model.value, texts)]

    got = map_texts(docs, setup, [("score", T.DoubleType())], id_col, text_col)
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
