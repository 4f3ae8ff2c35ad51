"""Trained models: held-out accuracy, gradients, exact code lengths, edge cases."""

import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from delimkit.llm import language_id as I
from delimkit.llm import quality as Q
from delimkit.llm import toxicity as X
from delimkit.llm.common import crc_bucket

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_crc_bucket(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", crc_bucket("doc_id", 5).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


@needs_data
def test_held_out_quality(spark):
    docs, labels = tables(spark)
    got = Q.score_quality(docs, labels).join(labels, "doc_id").where(crc_bucket("doc_id", 5) == 0)
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).first()
    assert r.a > 0.93


@needs_data
def test_held_out_toxicity(spark):
    docs, labels = tables(spark)
    got = X.score_toxicity(docs, labels).join(labels, "doc_id").where(crc_bucket("doc_id", 3) == 1)
    r = got.agg(*[F.count_if((F.col("predicted") == a) & (F.col("toxic") == b)).alias(n) for n, a, b in (("hit", 1, 1), ("missed", 0, 1), ("wrong", 1, 0), ("clean", 0, 0))]).first()
    # 18 toxic rows are held out on this table
    assert r.hit + r.missed > 15 and r.hit / (r.hit + r.missed) >= 0.75 and r.hit / max(r.hit + r.wrong, 1) >= 0.75
    assert r.wrong / (r.wrong + r.clean) <= 0.03


@needs_data
def test_held_out_language(spark):
    docs, _ = tables(spark)
    got = I.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where(crc_bucket("doc_id", 5) == 0)
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a")).first().a > 0.95


def test_edges(spark, edge, labels):
    n = edge.count()
    for f in (Q.score_quality, X.score_toxicity):
        rows = f(edge, labels).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert f(edge.limit(0), labels).count() == 0
        assert f(edge, labels.limit(0)).count() == n
    rows = I.identify_language(edge).collect()
    pred = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == n and pred[0] == pred[1] == pred[11] == "und" and pred[4] == "en"
    assert {r.lang_pred for r in I.identify_language(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert I.identify_language(edge.limit(0)).count() == 0
    clean = X.keep_clean(edge, labels.limit(0))
    assert clean.columns == edge.columns and clean.count() == n


def test_names_of_columns_are_free(spark, edge, labels):
    """Ids and texts under other names, beside columns with the operators' own names."""
    names = {"doc_id": "k", "text": "body", "lang": "doc_id", "source": "text"}
    odd = edge.select([F.col(c).alias(names.get(c, c)) for c in edge.columns])
    for f in (Q.score_quality, X.score_toxicity):
        want = sorted(map(tuple, f(edge, labels).collect()), key=repr)
        assert sorted(map(tuple, f(odd, labels, id_col="k", text_col="body").collect()), key=repr) == want
    assert X.keep_clean(odd, labels, id_col="k", text_col="body").columns == odd.columns


def plain_quality(p, text):
    """Gated attention over passages, one number at a time."""
    x, _ = Q.encode_inputs([text])
    hs, es = [], []
    for row in x.astype(float):
        h = [math.tanh(sum(row[i] * p["W"][i][k] for i in range(len(row))) + p["b"][k]) for k in range(len(p["b"]))]
        v = [math.tanh(sum(h[i] * p["V"][i][k] for i in range(len(h)))) for k in range(len(p["a"]))]
        u = [1 / (1 + math.exp(-sum(h[i] * p["U"][i][k] for i in range(len(h))))) for k in range(len(p["a"]))]
        hs.append(h)
        es.append(sum(a * b * c for a, b, c in zip(v, u, p["a"], strict=True)))
    w = [math.exp(e - max(es)) for e in es]
    z = [sum(a * h[k] for a, h in zip(w, hs, strict=True)) / sum(w) for k in range(len(p["c"]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["d"][0]))


def bags(n, seed=4):
    r = np.random.default_rng(seed)
    return [" ".join("".join(chr(97 + i) for i in r.integers(0, 20, r.integers(1, 9))) for _ in range(int(r.integers(0, 300)))) for _ in range(n)]


def test_quality_equals_plain():
    texts = bags(40)
    p = Q.train(texts, [i % 2 for i in range(40)], steps=20)
    assert np.abs(p["c"]).max() > 0 and np.abs(p["a"]).max() > 0
    asked = [*texts[:12], "", None, "one"]
    assert Q.score_texts(p, asked) == pytest.approx([plain_quality(p, t) for t in asked], abs=1e-4)


def test_quality_gradients():
    texts, r = bags(9, 5), np.random.default_rng(6)
    x, starts = Q.encode_inputs(texts)
    x, y = x.astype(float), r.integers(0, 2, 9).astype(float)
    p = {k: r.normal(0, 0.3, v.shape) for k, v in Q.train(["a"], [1]).items()}

    def loss():
        q = Q._forward(p, x, starts)[-1]
        return float(np.mean(np.logaddexp(0, q) - y * q))

    g = Q._grads(p, x, starts, y)
    for k in p:
        for _ in range(3):
            i = tuple(r.integers(0, n) for n in p[k].shape)
            old, e = p[k][i], 1e-4
            p[k][i] = old + e
            up = loss()
            p[k][i] = old - e
            down = loss()
            p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-7), k


def plain_toxicity(p, text):
    """The document's score, one window, step and number at a time."""
    sig = lambda a: 1 / (1 + math.exp(-a))
    words = X.words_of(text)
    vec = [X.vectors(p, *X.hashed([w]))[0].astype(float) for w in words]
    vec += [np.zeros(X.DIM)] * (X.WINDOW - len(vec))
    top = -1e9
    for s in range(len(vec) - X.WINDOW + 1):
        states = []
        for k, order in (("f", range(X.WINDOW)), ("b", reversed(range(X.WINDOW)))):
            W, U, b = (p[m + k].astype(float) for m in "WUb")
            h, out, n = [0.0] * X.HIDDEN, {}, X.HIDDEN
            for t in order:
                g = vec[s + t] @ W + b
                z = [sig(g[j] + sum(h[i] * U[i][j] for i in range(n))) for j in range(n)]
                r = [sig(g[n + j] + sum(h[i] * U[i][n + j] for i in range(n))) for j in range(n)]
                c = [math.tanh(g[2 * n + j] + sum(r[i] * h[i] * U[i][2 * n + j] for i in range(n))) for j in range(n)]
                h = [h[j] + z[j] * (c[j] - h[j]) for j in range(n)]
                out[t] = h
            states.append(out)
        both = [states[0][t] + states[1][t] for t in range(X.WINDOW)]
        e = [math.exp(sum(a * b for a, b in zip(q, p["a"], strict=True))) for q in both]
        top = max(top, sum(w * sum(a * b for a, b in zip(q, p["o"], strict=True)) for w, q in zip(e, both, strict=True)) / sum(e) + p["d"][0])
    return sig(p["scale"][0] * min(15, max(-15, top)) + p["scale"][1])


def test_toxicity_equals_plain():
    r = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{i}" for i in r.integers(0, 40, n))
    texts = [say(30) + (" vile words here" if i % 2 else "") + say(9) for i in range(60)]
    p = X.train(texts, [i % 2 for i in range(60)])
    asked = [*texts[:6], "", "one", say(11), say(12), say(13), None]
    assert X.score_texts(p, asked) == pytest.approx([plain_toxicity(p, t) for t in asked], abs=1e-3)


def test_windows_overlap_and_cover():
    words = [f"w{i}" for i in range(40)]
    vocabulary, rows, starts = X.windows([" ".join(words), "", "one"])
    assert starts.tolist() == [0, 6, 7] and len(rows) == 8
    seen = np.bincount(rows[:6][rows[:6] > 0], minlength=41)[1:]
    assert seen[:40].min() >= 1 and (seen[6:36] == 2).all() and vocabulary[:40] == words


def test_gru_gradients():
    p = X.train(["a b"], [1])
    r = np.random.default_rng(0)
    x, rows, y = r.normal(0, 1, (5, X.DIM)), r.integers(0, 6, (7, X.WINDOW)), r.integers(0, 2, 7).astype(float)
    p = {k: v.astype(float) for k, v in p.items()}
    p["a"] = r.normal(0, 0.5, 2 * X.HIDDEN)

    def loss():
        z = np.zeros((1, X.DIM))
        xs = np.concatenate([z, x])
        f = X._gru(xs @ p["Wf"] + p["bf"], rows, p["Uf"], False, False)[0]
        b = X._gru(xs @ p["Wb"] + p["bb"], rows, p["Ub"], True, False)[0]
        q = X._pool(p, f, b)[2]
        return float(np.mean(np.logaddexp(0, q) - y * q))

    g, _ = X._grads(p, x, rows, y)
    for k in ("Uf", "Ub", "Wf", "Wb", "bf", "bb", "a", "o", "d"):
        i = tuple(r.integers(0, n) for n in p[k].shape)
        old, e = p[k][i], 2e-2
        p[k][i] = old + e
        up = loss()
        p[k][i] = old - e
        down = loss()
        p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * e), rel=0.15, abs=2e-4), k


def test_code_lengths_are_exact():
    train = {"x": [b"abracadabra abra", b"banana bandana"], "y": [b"zyzzyva xyz", b"quiz"]}
    trees = I.Trees(train)
    everything = [t for ts in train.values() for t in ts]
    texts = [b"abra banana", b"", b"zz\xff!", b"a" * 50]
    got = trees.bits(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(trees.languages):
            # bytes that only the other language has are known symbols without counts
            kinds = {b for u in everything for b in u}
            sym_train = train[g]
            want = plain_with_alphabet(sym_train, t, kinds)
            assert got[i, j] == pytest.approx(want, abs=1e-3)


def plain_with_alphabet(train, text, kinds):
    kinds, order = sorted(kinds), 3
    sym = {b: i + 1 for i, b in enumerate(kinds)}
    unseen = max(1, 256 - len(kinds))
    trees = {}
    for t in train:
        s = [0] * order + [sym[b] for b in t]
        for i in range(order, len(s)):
            for k in range(order + 1):
                c = trees.setdefault(tuple(s[i - k : i]), {})
                c[s[i]] = c.get(s[i], 0) + 1
    return walk(trees, sym, unseen, len(kinds), text, order)


def walk(trees, sym, unseen, n_kinds, text, order):
    def share(ctx):
        if ctx is None:
            return [unseen / 256] + [1 / 256] * n_kinds
        lower = share(ctx[1:] if ctx else None)
        c = trees.get(ctx)
        if not c:
            return lower
        n, q = sum(c.values()), len(c)
        left = sum(p for i, p in enumerate(lower) if i not in c)
        esc = q / (n + q) if left > 0 else 0
        return [c[i] / n * (1 - esc) if i in c else esc * p / left for i, p in enumerate(lower)]

    s, bits = [0] * order + [sym.get(b, 0) for b in text], 0.0
    for i in range(order, len(s)):
        p = share(tuple(s[i - order : i]))[s[i]]
        bits -= math.log2(max(p / (unseen if not s[i] else 1), 1e-12))
    return bits


def test_every_window_is_scored():
    r = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{i}" for i in r.integers(0, 60, n))
    bad = " ".join(f"bad{i}" for i in range(12))
    texts = [say(40) + " " + bad + " " + say(30) for _ in range(60)] + [say(80) for _ in range(60)]
    p = X.train(texts, [1] * 60 + [0] * 60)
    asked = [say(n) for n in (0, 1, 5, 11, 12, 13, 17, 40)] + [say(k) + " " + bad for k in range(8)] + [None]
    vocabulary, rows, starts = X.windows(asked, 1)
    plain = np.maximum.reduceat(X.logits(p, X.vectors(p, *X.hashed(vocabulary)), rows), starts)
    assert X._tops(p, asked) == pytest.approx(np.clip(plain, -15, 15), abs=1e-3)
    # one window score, wherever the sentence stands
    alone = X._tops(p, [bad])[0]
    assert all(X._tops(p, [say(k) + " " + bad])[0] >= alone - 1e-3 for k in range(1, 13))


def test_sparse_code_lengths_equal_dense():
    r = np.random.default_rng(2)
    say = lambda g, n: bytes(r.integers(97 + g, 103 + g, n).astype(np.uint8))
    train = {f"l{g}": [say(g, n) for n in (0, 1, 3, 50, 400)] for g in range(5)} | {"none": [b""]}
    texts = [say(g, n) for g in range(6) for n in (0, 1, 2, 60)] + ["z\0ö".encode(), b"\xff"]
    dense, sparse = I.Trees(train), I.SparseTrees(train)
    assert dense.languages == sparse.languages
    assert sparse.bits(texts) == pytest.approx(dense.bits(texts), abs=1e-2)
    assert sparse.bits([]).shape == (0, 6) and isinstance(I.trees_of(train), I.Trees) and isinstance(I.trees_of(train, 1), I.SparseTrees)


def test_more_than_64_languages_are_learnt(spark):
    names = [chr(97 + i // 9) + chr(105 + i % 9) for i in range(70)]
    rows = [(100 * g + k, " ".join(f"{w}{w}{chr(97 + (k + j) % 7)}" for j in range(12)), w) for g, w in enumerate(names) for k in range(8 + (g < 64))]
    got = I.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {d: w for d, _, w in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got) and len(got) == len(rows)


def test_languages_are_learnt_from_whole_texts(spark):
    rows = [(i, "shared opening words " * 250 + end * 20, g) for i in range(12) for g, end in (("a", "zug quist "), ("b", "mel ova "))]
    rows = [(2 * i + (g == "b"), t, g) for i, t, g in rows] + [(100, "zug quist zug quist", None), (101, "mel ova mel ova", None)]
    got = {r.doc_id: r.lang_pred for r in I.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "a" and got[101] == "b"
