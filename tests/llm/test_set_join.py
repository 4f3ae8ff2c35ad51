"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from delimkit.llm import set_join as S


def shingles(text, width=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, width=3, percent=90):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, n=220):
    """Chains of near copies around the threshold, shared passages, exact copies, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.choice([1, 2, 3, 4, 9, 12, 20, 40, 80, 150]))]
        if r.random() < 0.3:
            base = base[:20] + passage.split()
        cur = base
        for _ in range(r.choice([1, 1, 2, 6, 12])):
            out.append(" ".join(cur))
            if r.random() < 0.15:
                out.append(" ".join(cur).upper() if r.random() < 0.5 else "\n".join(cur))
            cur = list(cur if r.random() < 0.5 else base)
            for _ in range(r.randint(0, max(1, len(cur) // 35))):
                cur[r.randrange(len(cur))] = word()
    rows = [(i, t) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 5, 80)])
def test_components_equal_all_pairs(spark, seed, width, percent, monkeypatch):
    monkeypatch.setattr(S, "LIST_BLOCK", 3)  # so that lists are dealt over several tasks
    monkeypatch.setattr(S, "CLUSTER", 4096 if seed % 2 else 4)
    rows = corpus(seed)
    got = S.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, width, percent)


def test_keep_one_takes_five_words_and_four_fifths(spark):
    rows = corpus(5)
    kept = sorted(r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted(d for d, _, low in brute(rows, 5, 80) if d == low)
    assert kept != sorted(d for d, _, low in brute(rows) if d == low)


def test_edges(spark, edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = S.jaccard_components(edge).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert S.jaccard_components(edge.limit(0)).count() == 0
    kept = S.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect() if r.text and r.text.startswith("a b c")) == [5]


@pytest.mark.parametrize(("percent", "part", "often"), [(90, 12, 0), (80, 6, 0), (80, 6, 40)])
def test_similar_sets_share_an_indexed_element(percent, part, often):
    """Counting, packing and indexing without Spark: what is indexed of two similar sets has an element in common."""
    r = np.random.default_rng(4)
    common = r.integers(0, 2**64, 60, dtype=np.uint64)
    sets = []
    for _ in range(150):
        a = np.unique(np.concatenate([r.integers(0, 2**64, int(r.integers(1, 300)), dtype=np.uint64), common[: int(r.integers(0, 61))]]))
        sets.append(a)
        for _ in range(int(r.integers(0, 4))):
            drop, add = int(r.integers(0, len(a) // part + 1)), int(r.integers(0, len(a) // part + 1))
            sets.append(np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**64, add, dtype=np.uint64)])))
    sets = [s for s in {s.tobytes(): s for s in sets if len(s)}.values()]
    parts, ids = 5, list(range(1000, 1000 + len(sets)))
    frequent = np.sort(common[:often])
    packed = [r for at in range(0, len(sets), 37) for r in S.pack(sets[at : at + 37], ids[at : at + 37], parts, frequent)]
    packed += S.pack(sets[:20], ids[:20], parts, frequent)  # sets that another task sends too
    back = []
    read = lambda raw, kind: np.frombuffer(raw, kind)
    for p in range(parts):
        mine = [x for x in packed if x[0] == p and not x[1]]
        raw = read(b"".join(x[5] for x in mine), np.uint8).reshape(-1, 5)
        low = np.zeros((len(raw), 8), np.uint8)
        low[:, :5] = raw
        back += S.shared_elements(p, parts, *(read(b"".join(x[i] for x in mine), k) for i, k in ((2, np.int64), (3, np.uint32), (4, np.uint32))), low.view(np.uint64).ravel())
    back += [(p, *x, np.full(len(x[3]) // 8, 65535, np.uint16).tobytes()) for p, sure, *x in packed if sure]
    indexed, whole = {}, {}
    for p in range(parts):
        mine = [x for x in back if x[0] == p]
        number, size, take, have, items = S.indexed_sets(*(read(b"".join(x[i] for x in mine), k) for i, k in ((1, np.int64), (2, np.uint32), (3, np.uint32), (4, np.uint64), (5, np.uint16))), percent, 100)
        for i, n, t, s in zip(number.tolist(), size.tolist(), take.tolist(), np.split(items, np.cumsum(have)[:-1]), strict=True):
            assert i not in indexed and n == len(sets[i - 1000])
            indexed[i], whole[i] = set(s[:t].tolist()), set(s.tolist())
    similar = 0
    for i in ids:
        for j in range(1000, i):
            a, b = sets[i - 1000], sets[j - 1000]
            x = len(np.intersect1d(a, b))
            if 100 * x >= percent * (len(a) + len(b) - x):
                similar += 1
                assert indexed[i] & indexed[j] and len(whole[i] & whole[j]) == x
    assert similar > 100


def test_summary_counts_are_too_low_by_a_share_at_most():
    r = np.random.default_rng(2)
    s, every = S.Summary(50), []
    for _ in range(20):
        part = np.concatenate([r.integers(0, 5000, 400), np.repeat(r.integers(0, 10, 20), 5)]).astype(np.uint64)
        every.append(part)
        s.add(part)
    true = np.bincount(np.concatenate(every).astype(np.int64), minlength=5000)
    low = np.zeros(5000, np.int64)
    low[s.element.astype(np.int64)] = s.count
    assert len(s.element) <= 50 and s.total == true.sum()
    assert (low <= true).all() and (true - low <= s.total // 50).all()
    assert set(np.flatnonzero(true > 3 * s.total // 50)) <= set(s.most(50)[0].tolist())


def test_frequent_elements_take_the_other_way(spark, monkeypatch):
    """With elements dealt out by their sets from two entries on, the result is the same."""
    monkeypatch.setattr(S, "OFTEN", 2)
    monkeypatch.setattr(S, "PART", 500)
    rows = corpus(6)
    src = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, by_id, _ = S._identified(S.id_and_text(src), 5)
    assert len(S._frequent(sets, by_id.agg({"n": "sum"}).first()[0])) > 100
    got = S.jaccard_components(src, 5, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 5, 80)


def test_numbers_that_clash_are_made_anew(spark, monkeypatch):
    real = S._number
    monkeypatch.setattr(S, "_sets_table", lambda docs, width, seed, f=S._sets_table: f(docs, width, seed) if seed else f(docs, width, seed).withColumn("id", F.when(F.col("id").isNotNull(), F.col("id") % 3)))
    assert real(b"\1" + bytes(15)) == 1
    rows = corpus(7, 60)
    got = S.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 5, 80)


def _entries(spark, n):
    r = random.Random(n)
    words = [f"w{i}" for i in range(20_000)]
    passages = [" ".join(r.choices(words, k=60)) for _ in range(40)]
    # unrelated texts of one size, each with a passage that many others hold
    rows = [(i, " ".join(r.choices(words, k=240)) + " " + passages[i % 40]) for i in range(n)]
    src = S.id_and_text(spark.createDataFrame(rows, "doc_id long, text string"))
    members = S.keep(S._members(src, 5, 80, 100, 0, 4, np.zeros(0, np.uint64)), "members")
    return members.count(), S._lists(members, 80, 100).count()


def test_unrelated_sets_of_one_size_make_no_work(spark):
    assert _entries(spark, 1000) == (0, 0)
    assert _entries(spark, 10_000) == (0, 0)


def test_derived_links_equal_direct():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**64, 100, dtype=np.uint64))
    sets = [base] + [np.unique(np.concatenate([r.permutation(base)[int(r.integers(0, 12)) :], r.integers(0, 2**64, int(r.integers(0, 8)), dtype=np.uint64)])) for _ in range(30)]
    ids = list(range(len(sets)))
    links = S.derived_links(ids, ids, sets, 90, 100)

    def groups(pairs):
        g = list(ids)
        for a, b in pairs:
            g = [g[a] if x == g[b] else x for x in g]
        return [g.index(x) for x in g]

    direct = [(i, j) for i in ids for j in range(i) if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - x)]
    assert groups(links) == groups(direct)
