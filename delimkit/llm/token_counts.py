"""Token counts by a map-side two-tier lookup.

Tier one is a compact table, broadcast once: the pre-tokens that the tokenizer's own
vocabulary marks as frequent (at most one per vocabulary entry, so its size is fixed),
with the number of tokens each gives. Tier two is a bounded cache in each worker:
pre-tokens missing in tier one are encoded once per worker by the library, in batches.
No pre-token ever leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, map_texts

#: Entries of a worker's cache; beyond them it starts anew.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded each time and never kept.
CACHE_CHARS = 48

# Fixed value: the published split pattern of this family of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _load(data: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executors' cores are taken by tasks
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data)
    t.no_truncation()
    t.no_padding()
    return t


def splits_like_pattern(data: str) -> bool:
    """Whether whole texts encode as their pre-tokens do, one by one."""
    spec = json.loads(data)
    pre = spec.get("pre_tokenizer") or {}
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec.get("added_tokens", []))
    return plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def frequent_table(data: str) -> tuple[list[str], bytes]:
    """Vocabulary entries that are whole pre-tokens, and how many tokens each gives (as the library says)."""
    import regex

    t = _load(data)
    if not splits_like_pattern(data):
        return [], b""
    texts = [s for s in t.decode_batch([[i] for i in range(t.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False) if s and "�" not in s]
    find = regex.compile(SPLIT).findall
    special = {a.content for a in t.get_added_tokens_decoder().values()}
    texts = sorted({s for s in texts if s not in special and find(s) == [s]})
    lengths = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    few = [(s, n) for s, n in zip(texts, lengths, strict=True) if n < 256]
    return [s for s, _ in few], bytes(n for _, n in few)


class Counter:
    """Counts the tokens of texts; one lives in each task."""

    def __init__(self, data: str, frequent: tuple[list[str], bytes], cache_entries: int = CACHE_ENTRIES):
        import regex
        import unicodedata

        self.t, self.limit = _load(data), cache_entries
        self.whole = not splits_like_pattern(data)
        self.first = dict(zip(*frequent, strict=True))
        self.known = dict(self.first)  # tier one, and behind it what this worker has encoded
        self.late: list[str] = []
        self.find = regex.compile(SPLIT).findall
        self.added = regex.compile("|".join(regex.escape(a.content) for a in self.t.get_added_tokens_decoder().values()) or r"(?!)")
        self.old = unicodedata.ucd_3_2_0.category

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens. Where a character is so new that two Unicode tables may differ, the library splits."""
        if text.isascii() or all(c < "ɐ" or self.old(c) != "Cn" for c in set(text)):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, seen: set[str]) -> None:
        """Encode the pre-tokens that neither tier knows."""
        self.late = list(seen - self.known.keys())
        if self.late:
            self.known.update(zip(self.late, map(len, self.t.encode_batch_fast(self.late, add_special_tokens=False)), strict=True))

    def forget(self) -> None:
        """Keep the worker's cache bounded: no long pre-tokens, and a new start beyond the limit."""
        if len(self.known) - len(self.first) > self.limit:
            self.known = dict(self.first)
        else:
            for s in self.late:
                if len(s) > CACHE_CHARS:
                    del self.known[s]

    def __call__(self, texts: list) -> list[int]:
        if self.whole:
            return [len(e) for e in self.t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
        parts, seen, extra = [], set(), []
        for x in texts:
            mine, n = [], 0
            if x:
                # an added token's text counts as one token and splits what is around it
                cut = self.added.split(x)
                n = len(cut) - 1
                mine = self.pieces(x) if not n else [s for c in cut for s in self.pieces(c)]
            seen.update(mine)
            parts.append(mine)
            extra.append(n)
        self.learn(seen)
        out = [n + sum(map(self.known.__getitem__, mine)) for mine, n in zip(parts, extra, strict=True)]
        self.forget()
        return out


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Tokens are those that the library gives without begin, end or added special tokens;
    special strings inside a text are handled as is its default. A null or empty text has
    0 bytes and 0 tokens. Rows come back one for one: repeated rows and ids stay, a null
    id stays null, further columns are ignored, an empty table gives an empty result.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    shared = df.sparkSession.sparkContext.broadcast((data, frequent_table(data)))

    def setup():
        counter = Counter(*shared.value)

        def step(texts):
            return [[len(x.encode()) if x else 0 for x in texts], counter(texts)]

        return step

    got = map_texts(id_and_text(df, id_col, text_col), setup, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())], limit=6 << 20)
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
