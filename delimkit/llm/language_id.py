"""Language by prediction by partial matching (PPM) over bytes.

For each language, counts of bytes in contexts of up to ORDER bytes form a context tree.
A byte seen in a context costs what its share there says; else an escape (method C: as many
escapes as distinct bytes seen) leads to the next shorter context, without the bytes
already ruled out. After fitting the statistics are frozen: each text's exact code length
under each language is a sum of table look-ups, and the shortest code wins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, drop_kept, few, id_and_text, keep, map_texts

ORDER = 3
#: Training texts of each language at most; each is taken whole.
SAMPLE_ROWS = 150
#: Bytes of the dense tables at most, where they are asked for.
DENSE_BYTES = 512 << 20


class Trees:
    """Frozen context trees of several languages as dense look-up tables, for few languages.

    ``identify_language`` uses ``SparseTrees``, whose size follows the training texts; tests
    hold those against these.

    Bytes never seen in training share one symbol (number 0, an even share of the rest).
    ``low``: cost by two context symbols and the symbol, for all languages. ``high``: cost
    by a known three-symbol context's number and the symbol. Costs are in bits.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = sorted({b for ts in texts.values() for t in ts for b in t})
        self.n = len(seen) + 1
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, self.n)
        self.unseen = max(1, 256 - len(seen))
        n, count = self.n, len(self.languages)
        known = [np.zeros(0, np.int64)]
        coded = {}
        for g in self.languages:
            coded[g] = [np.concatenate([np.zeros(ORDER, np.int64), self.symbol[np.frombuffer(t, np.uint8)]]) for t in texts[g] if t]
            known += [np.unique(s[:-3] * n * n + s[1:-2] * n + s[2:-1]) for s in coded[g]]
        self.contexts = np.unique(np.concatenate(known))
        self.low = np.zeros((n * n * n, count), np.float32)
        self.high = np.zeros((len(self.contexts) * n, count), np.float32)
        even = np.full(n, 1 / 256)
        even[0] = self.unseen / 256
        for i, g in enumerate(self.languages):
            p = even[None]
            for order in range(ORDER):
                p = self._blend(self._counts(coded[g], order, None), np.tile(p, (n, 1)) if order else p, order)  # the shorter context lacks the oldest byte
            self.low[:, i] = self._bits(p).ravel()
            top = self._blend(self._counts(coded[g], ORDER, self.contexts), p[self.contexts % (n * n)], ORDER)
            self.high[:, i] = self._bits(top).ravel()
        self.number = np.zeros(n**3, np.int32)  # context -> 1 + its number
        self.number[self.contexts] = np.arange(1, len(self.contexts) + 1)

    def _bits(self, p):
        share = p.copy()
        share[:, 0] /= self.unseen  # the byte itself among those of the common symbol
        return -np.log2(np.maximum(share, 1e-12))

    def _counts(self, coded, order, contexts):
        n = self.n
        size = n**order if contexts is None else len(contexts)
        out = np.zeros(size * n)
        for s in coded:
            end = len(s)
            ctx = np.zeros(end - ORDER, np.int64)
            for k in range(order, 0, -1):
                ctx = ctx * n + s[ORDER - k : end - k]
            if contexts is not None:
                ctx = np.searchsorted(contexts, ctx)
            code, c = np.unique(ctx * n + s[ORDER:], return_counts=True)
            out[code] += c
        return out.reshape(size, n)

    @staticmethod
    def _blend(c, lower, order):
        """Shares in a context: counted bytes, and the shorter context's shares for the rest."""
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        rest = np.where(c > 0, 0, lower)
        left = rest.sum(1, keepdims=True)
        escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
        p = np.where(c > 0, c / np.maximum(total, 1) * (1 - escape), escape * rest / np.where(left > 0, left, 1))
        return np.where(total > 0, p, lower)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        n = self.n
        pad = b"\0" * ORDER
        data = self.symbol[np.frombuffer(b"".join(pad + t for t in texts), np.uint8)] if texts else np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + ORDER) - sizes - ORDER
        for k in range(ORDER):
            data[starts + k] = 0
        for first in range(0, len(texts), 256):  # blocks bound the memory; a text is never cut
            last = min(first + 256, len(texts))
            lo, hi = starts[first], starts[last - 1] + ORDER + sizes[last - 1]
            s = data[lo:hi]
            if len(s) <= ORDER:
                continue
            two = s[1:-2] * n + s[2:-1]
            number = self.number[s[:-3] * n * n + two]
            sym = s[3:]
            at_low, at_high = two * n + sym, (number - 1).astype(np.int64) * n + sym
            known = number > 0
            cost = np.empty((len(sym), len(self.languages)), np.float32)
            cost[known] = self.high[at_high[known]]
            cost[~known] = self.low[at_low[~known]]
            # what stands at the borders belongs to no text
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(cost, axis=0, dtype=np.float64)])
            a = starts[first:last] - lo
            out[first:last] = sums[a + sizes[first:last]] - sums[a]
        return out


class SparseTrees:
    """The code lengths of ``Trees`` from tables of counted entries only, so memory grows with the training texts.

    A symbol that a context hasn't counted costs the context's escape (shared out among
    what is left) and what it costs in the shorter context, so costs add up.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = sorted({b for ts in texts.values() for t in ts for b in set(t)})
        self.n = n = len(seen) + 1
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, n)
        self.unseen = max(1, 256 - len(seen))
        self.tables = [self._fit([self.symbol[np.frombuffer(t, np.uint8)] for t in texts[g] if t]) for g in self.languages]

    def _fit(self, coded):
        """Of each order: keys of (context, symbol) and their bits; contexts and the bits of their escape."""
        n, out = self.n, []
        coded = [np.concatenate([np.zeros(ORDER, np.int64), s]) for s in coded]
        for order in range(ORDER + 1):
            keys = [np.zeros(0, np.int64)]
            for s in coded:
                key = np.zeros(len(s) - ORDER, np.int64)
                for k in range(order, -1, -1):
                    key = key * n + s[ORDER - k : len(s) - k]
                keys.append(key)
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            ctx, first = np.unique(key // n, return_index=True)
            if not len(key):
                out.append((key, np.zeros(0), ctx, np.zeros(0)))
                continue
            total, kinds = np.add.reduceat(count, first), np.diff(np.append(first, len(key)))
            lower = self._share(out, key, order - 1)
            left = 1 - np.add.reduceat(lower, first)  # what uncounted symbols have in the shorter context
            # nothing is left where all symbols are counted
            some = kinds < n
            escape = np.where(some, kinds / (total + kinds), 0)
            share = count / np.repeat(total, kinds) * (1 - np.repeat(escape, kinds))
            out.append((key, -np.log2(share), ctx, np.where(some, -np.log2(np.where(some, escape / np.maximum(left, 1e-300), 1)), 0)))
        return out

    def _share(self, tables, key, order):
        return np.exp2(-self._cost(tables, key, order))

    def _cost(self, tables, key, order):
        """Bits of (context, symbol) keys, whose contexts may have more symbols than ``order``."""
        n = self.n
        cost, ask = np.zeros(len(key)), np.arange(len(key))
        for k in range(order, -1, -1):
            keys, bits, ctxs, escape = tables[k]
            if not len(keys) or not len(ask):
                continue
            part = key[ask] % n ** (k + 1)
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            cost[ask[hit]] += bits[at[hit]]
            ask, part = ask[~hit], part[~hit] // n
            at = np.minimum(np.searchsorted(ctxs, part), len(ctxs) - 1)
            cost[ask] += np.where(ctxs[at] == part, escape[at], 0)
        cost[ask] += np.where(key[ask] % n == 0, 8 - np.log2(self.unseen), 8)
        return cost

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language."""
        n, out = self.n, np.zeros((len(texts), len(self.languages)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        s = self.symbol[np.frombuffer(b"".join(b"\0" * ORDER + texts[i] for i in some), np.uint8)]
        ends = np.cumsum(sizes[some] + ORDER)
        starts = ends - sizes[some] - ORDER
        inside = np.ones(len(s), bool)
        for k in range(ORDER):
            s[starts + k] = 0
            inside[starts + k] = False
        key = np.zeros(len(s), np.int64)
        for k in range(ORDER, -1, -1):
            key[ORDER:] = key[ORDER:] * n + s[ORDER - k : len(s) - k]
        # a byte behind its three neighbours costs the same wherever it stands
        key, back = np.unique(key[inside], return_inverse=True)
        begin = np.cumsum(sizes[some]) - sizes[some]
        extra = (key % n == 0) * np.log2(self.unseen)  # the byte itself among those of the common symbol
        for j, tables in enumerate(self.tables):
            cost = np.minimum(self._cost(tables, key, ORDER) + extra, -np.log2(1e-12))
            out[some, j] = np.add.reduceat(cost[back], begin)
        return out


def trees_of(texts: dict[str, list[bytes]], bound: int = DENSE_BYTES) -> Trees | SparseTrees:
    """Dense tables if they are sure to fit ``bound`` bytes, else sparse ones. Every language is kept."""
    n, contexts = 1 + len({b for ts in texts.values() for t in ts for b in set(t)}), np.zeros(0, np.int64)
    for ts in texts.values():
        if (n**3 + len(contexts) * n) * 4 * len(texts) > bound:
            return SparseTrees(texts)
        raw = [np.concatenate([np.zeros(ORDER, np.int64), np.frombuffer(t, np.uint8)]) for t in ts if t]
        contexts = np.unique(np.concatenate([contexts, *(s[:-3] << 16 | s[1:-2] << 8 | s[2:-1] for s in raw)]))
    return Trees(texts) if (n**3 + len(contexts) * n) * 4 * len(texts) <= bound else SparseTrees(texts)


def training_texts(docs: DataFrame, parts: int, held: int, rows: int) -> dict[str, list[bytes]]:
    """At most ``rows`` whole texts of each language, chosen by a hash of the id."""
    src = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fit = src.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", parts) != held))
    # all rows are counted; then a hash bound that leaves about twice the rows needed picks the sample
    n = keep(fit.groupBy("lang").agg(F.count("*").alias("n_lang")), "languages")
    hashed = F.xxhash64("doc_id")
    share = F.lit(2.0 * rows) / F.col("n_lang")
    picked = fit.join(few(n), "lang").where((F.pmod(hashed, F.lit(1 << 30)) / (1 << 30)) < share)
    picked = picked.groupBy("lang", "doc_id").agg(F.min(F.col("text").cast("binary")).alias("b"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    kept: dict[str, list[bytes]] = {}
    for r in picked.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").collect():
        kept.setdefault(r["lang"], []).append(bytes(r["b"]))
    drop_kept(n)
    return kept


def identify_language(docs: DataFrame, parts: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang_pred (a learnt language or und), score (0 to 1).

    The trees are fitted on at most ``rows`` whole texts of each language,
    outside the held-out bucket (crc32 of the id's text modulo ``parts`` equal to
    ``held``). Whole texts are scored. A null text, one without a letter, and any text
    where nothing could be learnt, is ``und`` with score 0. Of equal code lengths the
    first language by name wins. The score is the winner's share of probability if code
    lengths are scaled to 64 bytes. Repeated rows and null ids stay; further columns are
    ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = training_texts(src, parts, held, rows)
    # fitted once; sparse tables have an entry for each counted context and byte, so the sample bounds what is sent
    shared = docs.sparkSession.sparkContext.broadcast(SparseTrees(sample) if sample else None)

    def setup():
        import regex

        letter, trees = regex.compile(r"\p{L}").search, shared.value

        def step(texts):
            ask = [i for i, x in enumerate(texts) if x and trees and letter(x)]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            raw = [texts[i].encode("utf-8", "surrogatepass") for i in ask]
            bits = trees.bits(raw) if ask else None
            for row, i in enumerate(ask):
                b = bits[row]
                best = int(np.argmin(b))
                w = np.exp2(-(b - b[best]) * min(1.0, 64 / max(len(raw[row]), 1)))
                pred[i], score[i] = trees.languages[best], float(w[best] / w.sum())
            return [pred, score]

        return step

    return map_texts(id_and_text(src), setup, [("lang_pred", T.StringType()), ("score", T.DoubleType())], limit=2 << 20)
