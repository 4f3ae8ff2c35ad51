"""N-gram Jaccard join by set relations: block skipping and derived answers.

A document's set holds the hashes of its distinct word shingles. Two sets of a Jaccard
similarity of at least t share at least t times the size of each, so an element that no
other set has helps neither, and a set of too few shared elements is similar to none.

Index: the elements of each set are ordered by the number of sets that have them, the
rarest first; similar sets then have an element in common among the first n - ceil(t n) + 1
of each. Those that are shared at all become entries (element, set, size, position). To
count, elements travel once, packed by ranges of their hashes; elements of very many sets
are known from a summary made before and are dealt out by their sets instead. Back travel
the shared elements alone, and of a set that has enough of them everything later steps need.

Block skipping: an element's list is cut into blocks by size class. What an entry can share
with a block is bounded by what follows its position and the block's earliest position;
entries and whole blocks whose bound is too low for their sizes are skipped, and lists of
the same members count once.

Derived answers: every remaining list compares its members with a leader, the set that is
in the most lists; a set is first compared with the best of its leaders alone. Lists whose
other members are connected by then are done. The others are brought together to clusters
(lists that share members; beyond a size each list stays by itself), so that each set
travels once, and a cluster's overlaps are derived from those of one of its sets: for X and
Z close to L, |X n Z| = |L| - |L-X| - |L-Z| + |(L-X) n (L-Z)| + |(X-L) n (Z-L)|, so only the
small differences are read. Pairs already connected are skipped: components need no further
link between them.

Exactness: take two similar sets and the first element, in the index's order, that they
share. Both have it among their first ones, and their bound holds in its list, so they meet
there and are either connected already or compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_kept, give_back, id_and_text, keep, slices, without
from .components import components

#: Members, and elements, of a block of a list whose pairs one task compares with another block's.
LIST_BLOCK, LIST_ELEMENTS = 256, 1 << 20
#: Elements of the sets that one task compares with one leader.
LED_ELEMENTS = 1 << 15
#: Members up to which all lists that share members are worked off as one cluster, and their elements.
CLUSTER, CLUSTER_ELEMENTS = 4096, 1 << 22
#: Elements that one task counts at about; memory of a worker is some 50 bytes for each.
PART = 1 << 22
#: Elements of which a task's summary keeps count, and what part of all it has an element must be to be reported.
SUMMARY, SHARE = 1 << 17, 1 << 14
#: An element of at least so many entries may be dealt out by its sets.
OFTEN = PART >> 3
#: Bits of an element's hash within its part.
LOW = np.uint64(40)

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _A)


def shingle_sets(texts: list, width: int = 3) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs without ASCII white space. With fewer words than
    ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b" ".join(b" ".join(w) for w in words if w) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    if not counts.sum():
        return [np.zeros(0, np.uint64) for _ in texts]
    sizes = np.diff(np.concatenate([[-1], ends]))
    power = np.ones(sizes.max(), np.uint64)
    np.cumprod(np.full(len(power) - 1, _A | np.uint64(1), np.uint64), out=power[1:])
    starts = ends + 1 - sizes
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    value = _BYTE[data] * power[within]
    h = _mix(np.add.reduceat(value, starts))
    # shingle i: words i to i + width - 1, each in its own place
    odd = [np.uint64(pow(int(_C), 2 * k + 1, 1 << 64)) for k in range(width)]
    full = sum(h[k : len(h) - width + 1 + k] * odd[k] for k in range(width)) if len(h) >= width else h[:0]
    full = _mix(full + np.uint64(width))
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(full[at : at + n - width + 1]))
        elif n:
            one = sum(h[at + k : at + k + 1] * odd[k] for k in range(n))
            out.append(_mix(one + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Classes:
    """Size classes: similar sets are of one class or of two neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.top = num, den, [0]

    def of(self, n: int) -> int:
        while self.top[-1] < n:
            low = self.top[-1] + 1
            self.top.append(max(low, low * self.den // self.num))
        return int(np.searchsorted(self.top, n))


def _fingerprint(s: np.ndarray, seed: int = 0) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(2, "big")).digest()


def _number(fingerprint: bytes) -> int:
    """A set's number: 64 bits of its fingerprint."""
    return int.from_bytes(fingerprint[:8], "little", signed=True)


class Summary:
    """The elements that occur most (Misra-Gries): counts are too low by at most a ``size``-th of what was added."""

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.element, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, elements: np.ndarray) -> None:
        self.total += len(elements)
        seen, count = np.unique(elements, return_counts=True)
        both, at = np.unique(np.concatenate([self.element, seen]), return_inverse=True)
        count = np.bincount(at, np.concatenate([self.count, count]), len(both)).astype(np.int64)
        if len(both) > self.size:
            cut = np.partition(count, len(count) - self.size - 1)[len(count) - self.size - 1]
            both, count = both[count > cut], count[count > cut] - cut
        self.element, self.count = both, count

    def most(self, share: int) -> tuple[np.ndarray, np.ndarray]:
        """Elements that are more than a ``share``-th of all, and occur more than once; fewer than ``share`` of them."""
        some = self.count > max(1, self.total // share)
        return self.element[some], self.count[some]


def _sets_table(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, id, fp of each row; and a row of each task with what occurs most (element, count)."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("id", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("element", longs), T.StructField("count", longs)])
    size, share = SUMMARY, SHARE

    def run(batches):
        import pyarrow as pa

        seen, summary, kind = set(), Summary(size), None
        for batch in batches:
            for part in slices(batch):
                kind = part.column("doc_id").type
                sets = shingle_sets(part.column("text").to_pylist(), width)
                fps = [_fingerprint(s, seed) if len(s) else None for s in sets]
                fresh = {}
                for s, fp in zip(sets, fps, strict=True):
                    if fp is not None and fp not in seen:
                        seen.add(fp)
                        fresh[fp] = s
                if fresh:
                    summary.add(np.concatenate(list(fresh.values())))
                ids = pa.array([None if fp is None else _number(fp) for fp in fps], pa.int64())
                none = pa.nulls(len(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), ids, pa.array(fps, pa.binary()), none, none], names=schema.names)
        if kind is not None:
            element, count = summary.most(share)
            cols = [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([element.view(np.int64)], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))], names=schema.names)
        del seen, summary
        give_back()

    return docs.mapInArrow(run, schema)


def _identified(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows' sets; (id, low, n) of each distinct set, its number and smallest doc_id; and the seed for which numbers are unique."""
    for seed in range(16):
        sets = keep(_sets_table(docs, width, seed), "sets")
        by_id = keep(sets.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")), "ids")
        if not by_id.where("x != y").limit(1).count():
            return sets, by_id, seed
        drop_kept(sets, by_id)
    raise RuntimeError("sets can't be numbered")


def _frequent(sets: DataFrame, total: int) -> np.ndarray:
    """Sorted elements that have very many entries by the tasks' summaries, SHARE / 2 at most.

    One that is three SHARE-ths of all is found, unless tasks have too few sets to have it
    twice; others may be. All are compared alike: this only says which way they travel.
    """
    each = sets.where(F.col("element").isNotNull()).select(F.explode(F.arrays_zip("element", "count")).alias("e"))
    sums = each.groupBy("e.element").agg(F.sum("e.count").alias("n")).where(F.col("n") >= max(OFTEN, 2 * total // SHARE))
    return np.sort(np.array([r["element"] for r in sums.select("element").collect()], np.int64).view(np.uint64))


def pack(sets: list[np.ndarray], ids: list[int], parts: int, often: np.ndarray) -> list[tuple]:
    """(part, sure, ids, sizes, counts, elements) of sets: each part's sets and what they have there, packed.

    An element is its part and LOW bits of its hash. Frequent ones are sure to be shared:
    they go to a part by their set, each as 8 bytes, the others to that of their hash, as 5.
    """
    rows: list[tuple] = []
    if not sets:
        return rows
    flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    own, number = np.repeat(np.arange(len(sets)), sizes), np.array(ids, np.int64)
    at = ((flat >> LOW) % np.uint64(parts)).astype(np.int64)
    low = flat & np.uint64((1 << int(LOW)) - 1)
    sure = np.isin(flat, often) if len(often) else np.zeros(len(flat), bool)
    for kind in (False, True):
        some = np.flatnonzero(sure == kind)
        if not len(some):
            continue
        of, mine = own[some], at[some]
        items = low[some] | mine.astype(np.uint64) << LOW
        to = number[of].view(np.uint64) % np.uint64(parts) if kind else mine
        order = np.argsort(to.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        to, of, items = to[order].astype(np.int64), of[order], items[order]
        raw = items.view(np.uint8).reshape(-1, 8) if kind else np.ascontiguousarray(items.view(np.uint8).reshape(-1, 8)[:, :5])
        # a run: what one set has in one part
        runs = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (of[1:] != of[:-1])]))
        ends = np.append(runs[1:], len(to))
        whose, where = of[runs], to[runs]
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows.append((int(where[a]), kind, number[whose[a:z]].tobytes(), sizes[whose[a:z]].astype(np.uint32).tobytes(), (ends[a:z] - runs[a:z]).astype(np.uint32).tobytes(), raw[runs[a] : ends[z - 1]].tobytes()))
    return rows


PACKED = "part int, sure boolean, ids binary, sizes binary, counts binary, elements binary"
SHARED = "part int, ids binary, sizes binary, counts binary, elements binary, ranks binary"


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared_elements(part: int, parts: int, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, low: np.ndarray) -> list[tuple]:
    """Of a part's elements those that several sets have, packed by the part of their set; a rank is the number of sets, 65535 at most."""
    number, of, first = *np.unique(ids, return_inverse=True)[:2], None
    size = np.zeros(len(number), np.uint32)
    size[of] = sizes
    of = np.repeat(of, counts)
    # copies of a set come from several tasks: each counts once
    order = np.lexsort((of, low))
    low, of = low[order], of[order]
    once = np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])]) if len(low) else np.zeros(0, bool)
    low, of = low[once], of[once]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(low)))
    rank = np.repeat(n, n)
    some = rank > 1
    return _by_set(parts, number, size, of[some], low[some] | np.uint64(part) << LOW, np.minimum(rank[some], 65535))


def _by_set(parts: int, number: np.ndarray, size: np.ndarray, of: np.ndarray, items: np.ndarray, rank: np.ndarray) -> list[tuple]:
    """Rows of SHARED: elements of sets, one row for each part of sets."""
    to = (number.view(np.uint64) % np.uint64(parts)).astype(np.int64)[of]
    order = np.lexsort((of, to))
    to, of, items, rank = to[order], of[order], items[order], rank[order].astype(np.uint16)
    runs = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = np.append(runs[1:], len(of))
    whose, where = of[runs], to[runs]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
    out = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        cut = slice(runs[a], ends[z - 1])
        out.append((int(where[a]), number[whose[a:z]].tobytes(), size[whose[a:z]].tobytes(), (ends[a:z] - runs[a:z]).astype(np.uint32).tobytes(), items[cut].tobytes(), rank[cut].tobytes()))
    return out


def indexed_sets(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, items: np.ndarray, ranks: np.ndarray, num: int, den: int):
    """Of sets that have enough shared elements: number, size, how many of the rarest to index; and their shared elements, rarest first."""
    number, of = np.unique(ids, return_inverse=True)
    size = np.zeros(len(number), np.int64)
    size[of] = sizes
    of = np.repeat(of, counts)
    order = np.lexsort((items, ranks, of))
    of, items = of[order], items[order]
    once = np.concatenate([[True], (items[1:] != items[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    of, items = of[once], items[once]
    have = np.bincount(of, minlength=len(number))
    need = -(-num * size // den)
    enough = have >= need
    return number[enough], size[enough], (have - need + 1)[enough], have[enough], items[enough[of]]


def _members(docs: DataFrame, width: int, num: int, den: int, seed: int, parts: int, often: np.ndarray) -> DataFrame:
    """(id, n, cls, take, shared): the sets that have enough shared elements, rarest first, and how many of those are indexed."""
    known = docs.sparkSession.sparkContext.broadcast(often)

    def packed(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for piece in slices(batch):
                fresh = {}
                for s in shingle_sets(piece.column("text").to_pylist(), width):
                    if len(s) and (i := _number(_fingerprint(s, seed))) not in seen:
                        seen.add(i)
                        fresh[i] = s
                rows = pack(list(fresh.values()), list(fresh), parts, known.value)
                if rows:
                    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "sure", "ids", "sizes", "counts", "elements"])
        give_back()

    def counted(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        part, rows = table.column("part")[0].as_py(), []
        plain, sure = table.filter(pc.invert(table.column("sure"))), table.filter(table.column("sure"))
        raw = _joined(plain.column("elements"), np.uint8).reshape(-1, 5)
        low = np.zeros((len(raw), 8), np.uint8)
        low[:, :5] = raw
        rows += shared_elements(part, parts, _joined(plain.column("ids"), np.int64), _joined(plain.column("sizes"), np.uint32), _joined(plain.column("counts"), np.uint32), low.view(np.uint64).ravel())
        for r in sure.to_pylist():
            many = len(r["elements"]) // 8
            rows.append((part, r["ids"], r["sizes"], r["counts"], r["elements"], np.full(many, 65535, np.uint16).tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["part", "ids", "sizes", "counts", "elements", "ranks"])

    def gathered(table):
        import pyarrow as pa

        number, size, take, have, items = indexed_sets(*(_joined(table.column(c), k) for c, k in (("ids", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("elements", np.uint64), ("ranks", np.uint16))), num, den)
        classes = Classes(num, den)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(have)]).astype(np.int64), pa.array(items.view(np.int64))).cast(pa.list_(pa.int64()))
        cols = [pa.array(number, pa.int64()), pa.array(size, pa.int64()), pa.array([classes.of(int(x)) for x in size], pa.int32()), pa.array(take, pa.int32()), lists]
        return pa.Table.from_arrays(cols, names=["id", "n", "cls", "take", "shared"])

    shared = docs.mapInArrow(packed, PACKED).groupBy("part").applyInArrow(counted, SHARED)
    return shared.groupBy("part").applyInArrow(gathered, "id long, n long, cls int, take int, shared array<long>")


def _lists(members: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id): the index's lists, without what block skipping drops; those with the same members once.

    A list has the sets of one size class and those of the next smaller one, which are
    marked: pairs of marked ones meet in the list of their own class.
    """
    each = members.select("id", "n", "cls", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("nth", "element"))
    # rest: elements behind the entry's position
    each = each.select("id", "n", "element", (F.col("m") - F.col("nth") - 1).alias("rest"), F.posexplode(F.array("cls", F.col("cls") + 1)).alias("up", "cls"))
    blocks = each.groupBy("element", "cls").agg(F.count("*").alias("c"), F.min("up").alias("own"), F.max("rest").alias("reach"), F.min("n").alias("least")).where("c > 1 and own = 0")
    fits = F.lit(num + den) * (1 + F.least("rest", "reach")) >= F.lit(num) * (F.col("n") + F.col("least"))
    left = each.join(blocks.select("element", "cls", "reach", "least"), ["element", "cls"]).where(fits).select(F.struct("element", "cls").alias("key"), "id", "up")
    left = keep(left, "entries")
    shape = left.groupBy("key").agg(F.count("*").alias("c"), F.min("up").alias("own"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("c > 1 and own = 0")
    out = keep(left.join(shape.groupBy("c", "x", "y").agg(F.min("key").alias("key")), "key").select("key", "id"), "lists")
    drop_kept(left)
    return out


def _led(lists: DataFrame) -> DataFrame:
    """(key, a, deg): each list's leader, the member that is in the most lists, and in how many."""
    degree = lists.groupBy("id").agg(F.count("*").alias("deg"))
    best = lists.join(degree, "id").groupBy("key").agg(F.max(F.struct("deg", "id")).alias("top"))
    return best.select("key", F.col("top.id").alias("a"), F.col("top.deg").alias("deg"))


def _verified(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): those pairs that are similar. Each a is compared with its partners block by block, so it is sent once for each."""
    sized = pairs.join(members.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(members.select(F.col("id").alias("b"), "n"), "b")
    sized = sized.where((F.col("n") * den >= F.col("na") * num) & (F.col("na") * den >= F.col("n") * num))
    size = sized.groupBy("a").agg(F.greatest(F.ceil(F.sum("n") / LED_ELEMENTS), F.lit(1)).cast("int").alias("nb"))
    asked = sized.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("nb")).cast("int").alias("block"), F.col("b").alias("id"))
    rows = asked.unionByName(size.select("a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.col("a").alias("id")))
    rows = rows.join(members.select("id", "n", "shared"), "id").select("a", "block", "id", "n", "shared")

    def run(table):
        import pyarrow as pa

        a, links = table.column("a")[0].as_py(), []
        ids, sizes, sets = table.column("id").to_pylist(), table.column("n").to_pylist(), _arrays(table.column("shared"))
        if a in ids:
            lead, n = np.sort(sets[ids.index(a)]), sizes[ids.index(a)]
            for b, m, s in zip(ids, sizes, sets, strict=True):
                if b != a:
                    at = np.minimum(np.searchsorted(lead, s), max(len(lead) - 1, 0))
                    both = int((lead[at] == s).sum()) if len(lead) else 0
                    if den * both >= num * (n + m - both):
                        links.append(b)
        return pa.table({"a": pa.array([a] * len(links), pa.int64()), "b": pa.array(links, pa.int64())})

    return rows.groupBy("a", "block").applyInArrow(run, "a long, b long")


def _arrays(column) -> list[np.ndarray]:
    """A column of lists as arrays."""
    got = column.combine_chunks()
    flat, at = got.values.to_numpy(zero_copy_only=False), got.offsets.to_numpy()
    return [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def derived_links(ids: list[int], groups: list[int], sets: list[np.ndarray], num: int, den: int, first: list[bool] | None = None, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join different groups, found from the sets' differences to the first set.

    ``first``: if given, only pairs of a marked and an unmarked set are compared. ``sizes``:
    of the whole sets, where ``sets`` lack elements that no other set has. One link for
    each two groups that it joins; pairs that are connected by then are skipped.
    """
    base = sets[0]
    less = [np.setdiff1d(base, s, assume_unique=True) for s in sets]
    more = [np.setdiff1d(s, base, assume_unique=True) for s in sets]
    n_less = np.array([len(x) for x in less])
    sizes = np.array([len(s) for s in sets] if sizes is None else sizes)
    # elements of the differences, numbered; an element of the base can't be an added one
    sized = np.array([len(x) + len(y) for x, y in zip(less, more, strict=True)])
    numbers, flat = np.unique(np.concatenate([z for x, y in zip(less, more, strict=True) for z in (x, y)]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sized)
    order = np.argsort(flat, kind="stable")
    by_number, bounds = owner[order], np.searchsorted(flat[order], np.arange(len(numbers) + 1))
    begins = np.cumsum(sized) - sized
    group, links = np.array(groups), []
    side = np.array(first) if first is not None else None
    for i in range(len(sets)):
        apart = group != group[i]
        apart[: i + 1] = False
        if side is not None:
            apart &= side != side[i]
        if not apart.any():
            continue
        mine = flat[begins[i] : begins[i] + sized[i]]
        met = np.concatenate([np.zeros(0, np.int64), *(by_number[bounds[m] : bounds[m + 1]] for m in mine)]).astype(np.int64)
        shared = np.bincount(met, minlength=len(sets))
        overlap = len(base) - n_less[i] - n_less + shared
        fits = apart & (den * overlap >= num * (sizes[i] + sizes - overlap))
        for j in np.flatnonzero(fits):
            if group[j] != group[i]:
                links.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
    return links


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label): lists of which members are still apart; those with the same members once."""
    named = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    shape = named.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    return named.join(shape.groupBy("c", "x", "y").agg(F.min("key").alias("key")), "key").select("key", "id", "label")


def _groups(lists: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, n, label): the clusters of lists; the lists themselves where a cluster is large. And the clusters."""
    lead = _led(lists.select("key", "id"))
    clusters = components(lists.join(lead, "key").where("a != id").select("a", F.col("id").alias("b")))
    named = lists.join(clusters.select(F.col("node").alias("id"), F.col("label").alias("cluster")), "id").join(members.select("id", "n"), "id")
    once = named.select("cluster", "id", "n", "label").distinct()
    small = (F.col("c") <= CLUSTER) & (F.col("s") <= CLUSTER_ELEMENTS)
    size = once.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    key = lambda kind, of: F.struct(F.lit(kind).alias("kind"), of.alias("of")).alias("key")
    none = F.struct(F.lit(0).cast("long").alias("element"), F.lit(0).alias("cls"), F.col("cluster").alias("cluster"))
    few = once.join(size.where(small), "cluster").select(key(0, none), "id", "n", "label")
    each = F.struct(F.col("key.element").alias("element"), F.col("key.cls").alias("cls"), F.lit(0).cast("long").alias("cluster"))
    many = named.join(size.where(~small), "cluster").select(key(1, each), "id", "n", "label")
    return keep(few.unionByName(many), "groups"), clusters


def _apart(named: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links within lists between members that their labels leave apart."""
    size = named.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / LIST_BLOCK), F.ceil(F.sum("n") / LIST_ELEMENTS)).cast("int").alias("nb"))
    rows = named.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    # two blocks of a list meet in one task, so a long list is dealt over many; a block meets itself there if it is alone
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    rows = rows.select("key", "id", "label", "mine", other).withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    rows = rows.join(members.select("id", "n", "shared"), "id").select("key", "x", "y", "id", "label", "mine", "n", "shared")

    def run(table):
        import pyarrow as pa

        table = table.sort_by("id")
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        first = None if x == y else [m == x for m in table.column("mine").to_pylist()]
        got = derived_links(table.column("id").to_pylist(), table.column("label").to_pylist(), _arrays(table.column("shared")), num, den, first, table.column("n").to_pylist())
        return pa.table({k: pa.array([p[i] for p in got], pa.int64()) for i, k in enumerate("ab")})

    return rows.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def _linked(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, label): the smallest number reachable by links, for each set that has any."""
    lists = _lists(members, num, den)
    # lists' leaders are compared with all other members, and then leave their lists; first each member meets its best one
    lead = keep(_led(lists), "leaders")
    pairs = keep(lists.join(lead, "key").where("a != id").select("a", F.col("id").alias("b"), "deg").distinct(), "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("deg", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    links = keep(_verified(best, members, num, den), "links")
    labels = components(links)
    named = labels.withColumnRenamed("label", "la").withColumnRenamed("node", "a"), labels.withColumnRenamed("label", "lb").withColumnRenamed("node", "b")
    late = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(named[0], "a", "left").join(named[1], "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    more = keep(_verified(late.select("a", "b"), members, num, den), "links")
    tables = [lists, lead, pairs, links, more]
    if more.limit(1).count():
        drop_kept(labels)
        links = links.unionByName(more)
        labels = components(links)
    left = keep(_open(lists.join(lead, "key").where("a != id").select("key", "id"), labels), "lists")
    tables.append(left)
    if left.limit(1).count():
        groups, clusters = _groups(left, members)
        last = keep(_apart(groups, members, num, den), "links")
        tables += [groups, clusters, last]
        if last.limit(1).count():
            drop_kept(labels)
            labels = components(links.unionByName(last))
    drop_kept(*tables)
    return labels


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by links).

    Two rows are linked if den * intersection >= num * union of their sets. Sets are made
    of 64-bit hashes of shingles; to compare them an element is its part (of as many as the
    input needs) and 40 bits of its hash. A null text or one without words has an empty
    set, is linked with nothing and is its own component; so does any row with a null id
    count for its set, while smallest ids ignore nulls. Repeated rows are linked like
    copies; further columns are ignored; an empty table gives an empty result.
    """
    src = id_and_text(docs, id_col, text_col)
    sets, by_id, seed = _identified(src, width)
    total = by_id.agg(F.sum("n")).first()[0] or 0
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(wide, total // 50_000), -(-total // PART))
    members = keep(_members(src, width, num, den, seed, parts, _frequent(sets, total)), "members")
    labels = _linked(members, num, den)
    joined = by_id.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "low", F.coalesce("label", "id").alias("label"))
    lowest = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    named = keep(joined.join(lowest, "label").select("id", "component_id"), "components")
    rows = sets.where(F.col("element").isNull()).select("doc_id", "n_shingles", "id")
    linked = rows.where(F.col("id").isNotNull()).join(named, "id").select("doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = keep(linked.unionByName(alone), "jaccard")
    drop_kept(sets, by_id, members, labels, named)
    return out


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group of linked rows: the one with the smallest id, then the first of equal ids.

    Rows are linked as near duplicates: by default at a similarity of 0.8 of their sets of
    five-word shingles. Rows without words are linked with nothing and stay; a null id
    counts as the largest; an empty table gives an empty result.
    """

    def copies(rows):
        got = jaccard_components(rows, width, num, den)
        out = got.where("doc_id != component_id").select("doc_id")
        out._reads = [got]
        return out

    return without(docs, id_col, text_col, copies)
