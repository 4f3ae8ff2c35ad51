"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words: a word's vector is its hashed word embedding plus the mean of its hashed
four-byte-gram embeddings (so stems and endings count). Every overlapping window of WINDOW words (one starts at
every word) runs through a forward and a backward GRU; an attention pools the states to a
window score. A document's score comes from its highest
window. Trained and run in numpy; a document label trains the window that scores highest.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, labelled_sample, map_texts, slices

#: STRIDE is for ``windows`` only, the plain form; ``scan`` scores a window at every word.
WINDOW, STRIDE = 12, 6
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 14
#: Bytes of a gram; a word is bounded by "<" and ">>", so the shortest has one gram.
GRAM = 4
DIM, HIDDEN = 8, 8
#: Training texts of each class at most.
SAMPLE = 800
#: Bytes of text that a worker scores at once.
SLICE = 2 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_find = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _find(text.lower()) if text else []


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: word bucket; gram buckets of all words in a row; where each word's begin."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">>" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes) - sizes
    within = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    mixed = (data + np.uint64(1)) * _MIX * (within * np.uint64(2) + np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    word = np.add.reduceat(mixed * _MIX, starts)
    word = ((word ^ (word >> np.uint64(31))) * _MIX >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    code = sum(data[i : len(data) - GRAM + 1 + i] << np.uint64(8 * i) for i in range(GRAM))
    inside = np.ones(len(data), bool)
    for i in range(1, GRAM):
        inside[starts + sizes - i] = False
    gram = (code * _MIX >> np.uint64(40)).astype(np.int64)[inside[: len(code)]] % CHAR_BUCKETS
    counts = sizes - GRAM + 1
    return word, gram, np.cumsum(counts) - counts


def vectors(p, word, gram, starts):
    n = np.diff(np.append(starts, len(gram)))[:, None]
    return p["E"][word] + np.add.reduceat(p["C"][gram], starts) / np.sqrt(n)


def sequences(texts: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; 1 + word numbers of all texts in a row (0: nothing, fills a text up to WINDOW); where texts start; their windows."""
    number: dict[str, int] = {}
    flat, sizes = [], []
    for t in texts:
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(t)]
        flat += ids
        flat += [0] * (WINDOW - len(ids))
        sizes.append(max(WINDOW, len(ids)))
    n = np.array(sizes, np.int64)
    return list(number), np.array(flat, np.int32), np.cumsum(n) - n, n - WINDOW + 1


def windows(texts: list, stride: int = STRIDE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words; windows as rows of 1 + word number (0: nothing); where each text's windows start."""
    number: dict[str, int] = {}
    flat, counts = [], []
    for t in texts:
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(t)]
        n = max(1, -(-max(0, len(ids) - WINDOW) // stride) + 1)
        flat += ids
        flat += [0] * (stride * (n - 1) + WINDOW - len(ids))
        counts.append(n)
    n = np.array(counts, np.int64)
    lengths = stride * (n - 1) + WINDOW
    base = np.repeat(np.cumsum(lengths) - lengths, n)
    starts = np.cumsum(n) - n
    nth = np.arange(n.sum()) - np.repeat(starts, n)
    return list(number), np.array(flat, np.int32)[(base + stride * nth)[:, None] + np.arange(WINDOW)], starts


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(gates, rows, recurrent, back: bool, trace: bool):
    """States of one direction, [time, window, HIDDEN]. ``gates``: each word's input to update, reset and candidate."""
    h = np.zeros((len(rows), HIDDEN), np.float32)
    out, kept = np.empty((WINDOW, len(rows), HIDDEN), np.float32), []
    Uz, Uh = recurrent[:, : 2 * HIDDEN], recurrent[:, 2 * HIDDEN :]
    for t in reversed(range(WINDOW)) if back else range(WINDOW):
        g = gates[rows[:, t]]
        zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ Uz)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ Uh)
        if trace:
            kept.append((t, h, z, r, c))
        h = h + z * (c - h)
        out[t] = h
    return out, kept


def _pool(p, f, b):
    e = np.tensordot(f, p["a"][:HIDDEN], 1) + np.tensordot(b, p["a"][HIDDEN:], 1)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    s = np.tensordot(f, p["o"][:HIDDEN], 1) + np.tensordot(b, p["o"][HIDDEN:], 1)
    return w, s, (w * s).sum(0) + p["d"]


def logits(p, x, rows, block: int = 8192) -> np.ndarray:
    """Scores of windows; ``x``: vectors of the distinct words."""
    x = np.concatenate([np.zeros((1, DIM), np.float32), x])
    gf, gb = x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]
    got = [np.zeros(0, np.float32)]
    for i in range(0, len(rows), block):
        part = rows[i : i + block]
        got.append(_pool(p, _gru(gf, part, p["Uf"], False, False)[0], _gru(gb, part, p["Ub"], True, False)[0])[2])
    return np.concatenate(got)


def _heads(p, gates, k: str, n: int) -> np.ndarray:
    """Attention and output of each state of ``n`` windows, [2, time, window]. ``gates``: inputs of the words in a row, [gate, word]."""
    half = slice(0, HIDDEN) if k == "f" else slice(HIDDEN, None)
    Uz, Uh = np.ascontiguousarray(p["U" + k][:, : 2 * HIDDEN].T), np.ascontiguousarray(p["U" + k][:, 2 * HIDDEN :].T)
    heads = np.stack([p["a"][half], p["o"][half]])
    h, out = np.zeros((HIDDEN, n), np.float32), np.empty((2, WINDOW, n), np.float32)
    for t in reversed(range(WINDOW)) if k == "b" else range(WINDOW):
        zr = Uz @ h
        zr += gates[: 2 * HIDDEN, t : t + n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = Uh @ (zr[HIDDEN:] * h)
        c += gates[2 * HIDDEN :, t : t + n]
        np.tanh(c, out=c)
        c -= h
        c *= zr[:HIDDEN]
        h += c
        out[:, t] = heads @ h
    return out


def scan(p, x, flat, starts, block: int = 2048) -> np.ndarray:
    """Scores of the windows at every word; -inf where a window would pass its text's end."""
    x = np.concatenate([np.zeros((1, DIM), np.float32), x.astype(np.float32)])
    gates = {k: x @ p["W" + k] + p["b" + k] for k in "fb"}
    total = max(0, len(flat) - WINDOW + 1)
    got = np.empty(total, np.float32)
    for i in range(0, total, block):
        n = min(block, total - i)
        words = flat[i : i + n + WINDOW - 1]
        e, s = sum(_heads(p, np.ascontiguousarray(gates[k][words].T), k, n) for k in "fb")
        w = np.exp(e - e.max(0))
        got[i : i + n] = (w * s).sum(0) / w.sum(0) + p["d"]
    for k in range(1, WINDOW):
        got[starts[1:] - k] = -np.inf
    return got


def _grads(p, x, rows, y):
    """Gradients of the mean log loss by backpropagation through time; also of the word vectors."""
    x = np.concatenate([np.zeros((1, DIM), np.float32), x])
    g, dx = {}, np.zeros_like(x)
    runs = {k: _gru(x @ p["W" + k] + p["b" + k], rows, p["U" + k], k == "b", True) for k in "fb"}
    f, b = runs["f"][0], runs["b"][0]
    w, s, logit = _pool(p, f, b)
    dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    ds, de = w * dl, w * (s - (w * s).sum(0)) * dl
    g["d"] = dl.sum(keepdims=True)
    g["o"] = np.concatenate([np.tensordot(ds, q, ([0, 1], [0, 1])) for q in (f, b)])
    g["a"] = np.concatenate([np.tensordot(de, q, ([0, 1], [0, 1])) for q in (f, b)])
    for k, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        U = p["U" + k]
        dU, dW, db, dh = np.zeros_like(U), np.zeros_like(p["W" + k]), np.zeros_like(p["b" + k]), 0
        for t, h, z, r, c in reversed(runs[k][1]):
            dh = dh + ds[t][:, None] * p["o"][half] + de[t][:, None] * p["a"][half]
            dz, dc = dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)
            drh = dc @ U[:, 2 * HIDDEN :].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            dU[:, : 2 * HIDDEN] += h.T @ dg[:, : 2 * HIDDEN]
            dU[:, 2 * HIDDEN :] += (r * h).T @ dc
            xt = x[rows[:, t]]
            dW += xt.T @ dg
            db += dg.sum(0)
            np.add.at(dx, rows[:, t], dg @ p["W" + k].T)
            dh = dh * (1 - z) + drh * r + dg[:, : 2 * HIDDEN] @ U[:, : 2 * HIDDEN].T
        g |= {"U" + k: dU, "W" + k: dW, "b" + k: db}
    return g, dx[1:]


def train(texts: list[str], labels: list[int], rounds: int = 5, inner: int = 20, seed: int = 3) -> dict[str, np.ndarray]:
    """Fit on labelled texts. Without both classes the score is the share of label 1 (0 without rows)."""
    rng = np.random.default_rng(seed)
    small = lambda *n: rng.normal(0, 0.3, n).astype(np.float32)
    p = {"E": np.zeros((WORD_BUCKETS, DIM), np.float32), "C": np.zeros((CHAR_BUCKETS, DIM), np.float32), "a": np.zeros(2 * HIDDEN, np.float32), "o": small(2 * HIDDEN), "d": np.zeros(1, np.float32)}
    for k in "fb":
        p |= {"W" + k: small(DIM, 3 * HIDDEN), "U" + k: small(HIDDEN, 3 * HIDDEN), "b" + k: np.zeros(3 * HIDDEN, np.float32)}
    y = np.array(labels, np.float32)
    p["scale"] = np.array([0.0, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if len(y) else -7.0])
    if not len(y) or y.min() == y.max():
        return p
    # every fifth text of a class only calibrates the score, so that learnt words don't
    aside = np.zeros(len(y), bool)
    for k in (0, 1):
        aside[np.flatnonzero(y == k)[4::5]] = True
    tests, y_tests = ([t for t, q in zip(texts, aside, strict=True) if q], y[aside]) if aside.any() else (texts, y)
    texts, y = [t for t, q in zip(texts, aside, strict=True) if not q], y[~aside]
    vocabulary, flat, starts, counts = sequences(texts)
    word, gram, at = hashed(vocabulary)
    rows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)
    doc = np.repeat(np.arange(len(y)), counts + WINDOW - 1)
    last = np.append(starts[1:], len(rows)) - 1
    # First vectors: how much likelier a bucket is in texts of label 1 than of label 0, smoothed.
    pairs = np.unique(doc * (len(vocabulary) + 1) + flat)
    of, w = pairs // (len(vocabulary) + 1), pairs % (len(vocabulary) + 1)
    of, w = of[w > 0], w[w > 0] - 1
    def odds(one, none):
        got = np.log((one + 2 * y.mean()) / (none + 2 * (1 - y.mean()))) - np.log(y.mean() / (1 - y.mean()))
        return np.where(one + none < 3, 0, got)

    direction = small(2, DIM)
    p["E"] += (odds(np.bincount(word[w], y[of], WORD_BUCKETS), np.bincount(word[w], 1 - y[of], WORD_BUCKETS))[:, None] * direction[0]).astype(np.float32)
    # a gram counts once for each text and word that has it: words' counts are summed by their distinct grams
    grams = np.unique(np.repeat(np.arange(len(vocabulary)), np.diff(np.append(at, len(gram)))) * CHAR_BUCKETS + gram)
    in_one, in_none = np.bincount(w, y[of], len(vocabulary)), np.bincount(w, 1 - y[of], len(vocabulary))
    bucket, word_of = grams % CHAR_BUCKETS, grams // CHAR_BUCKETS
    p["C"] += (odds(*(np.bincount(bucket, n[word_of], CHAR_BUCKETS) for n in (in_one, in_none)))[:, None] * direction[1]).astype(np.float32)
    del grams, bucket, word_of, pairs, of, w
    m, v, i = {}, {}, 0
    for _ in range(rounds):
        x = vectors(p, word, gram, at)
        scores = scan(p, x, flat, starts)
        # the highest window of each text stands for it; for label 0 another one as well
        best = np.lexsort((scores, doc[: len(rows)]))[last]
        other = (starts + (rng.random(len(y)) * counts).astype(np.int64))[y == 0]
        chosen, target = np.concatenate([best, other]), np.concatenate([y, np.zeros(len(other), np.float32)])
        for _ in range(inner):
            i += 1
            pick = rng.permutation(len(chosen))[:512]
            used, local = np.unique(rows[chosen[pick]], return_inverse=True)
            used = used[used > 0] - 1
            local = local.reshape(len(pick), WINDOW) + (0 if (rows[chosen[pick]] == 0).any() else 1)
            sizes_used = np.diff(np.append(at, len(gram)))[used]
            where = np.repeat(at[used], sizes_used) + np.arange(sizes_used.sum()) - np.repeat(np.cumsum(sizes_used) - sizes_used, sizes_used)
            sub = gram[where]
            sub_at = np.cumsum(sizes_used) - sizes_used
            g, dx = _grads(p, vectors(p, word[used], sub, sub_at), local, target[pick])
            for k, d in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                p[k] = (p[k] - 0.02 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            np.add.at(p["E"], word[used], -0.2 * dx)
            np.add.at(p["C"], sub, -0.2 * np.repeat(dx / np.sqrt(sizes_used[:, None]), sizes_used, axis=0))
    p["scale"] = _calibrate(_tops(p, tests), y_tests.astype(np.float64))
    return p


def _tops(p, texts: list) -> np.ndarray:
    """Each text's highest window score, limited to +-15."""
    vocabulary, flat, starts, _ = sequences(texts)
    x = vectors(p, *hashed(vocabulary)) if vocabulary else np.zeros((0, DIM), np.float32)
    return np.clip(np.maximum.reduceat(scan(p, x, flat, starts), starts), -15, 15).astype(np.float64)


def _calibrate(top, y):
    """Slope and offset of a logistic curve from the highest window's score, by Newton steps."""
    a = np.array([1.0, 0.0])
    x = np.stack([top, np.ones_like(top)], 1)
    for _ in range(50):
        q = _sigmoid(x @ a)
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (q - y) + 1e-3 * a)
        a = a - np.clip(step, -1, 1)
    return np.array([max(a[0], 0.0), a[1]])


def score_texts(p: dict[str, np.ndarray], texts: list) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    return _sigmoid(p["scale"][0] * _tops(p, texts) + p["scale"][1])


def fitted(docs: DataFrame, labels: DataFrame, parts: int, held: int, bound: int, id_col: str = "doc_id", text_col: str = "text"):
    """The network trained on the labelled sample, as a broadcast variable."""
    sample = labelled_sample(docs, labels, "toxic", parts, held, bound, "max", id_col, text_col)
    model = train([t for t, _ in sample], [y for _, y in sample])
    give_back()
    return docs.sparkSession.sparkContext.broadcast(model)


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, bound: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    The network is fitted on at most ``bound`` labelled texts of each class outside the
    held-out bucket (crc32 of the id's text modulo ``parts`` equal to ``held``). Null and
    empty texts and texts without words are one empty window and get a score too. Null ids
    stay and are never trained on; repeated rows stay; further columns are ignored;
    without usable labels every score is next to 0; an empty table gives an empty result.
    """
    model = fitted(docs, labels, parts, held, bound, id_col, text_col)

    def setup():
        return lambda texts: [score_texts(model.value, texts)]

    got = map_texts(docs, setup, [("score", T.DoubleType())], id_col, text_col, SLICE)
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, bound: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic.

    Null texts are scored as empty ones; repeated rows and null ids are judged one by one;
    without usable labels all rows stay; an empty table gives an empty result.
    """
    model = fitted(docs, labels, parts, held, bound, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                score = score_texts(model.value, part.column(at).to_pylist())
                yield part.filter(pa.array(score < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
