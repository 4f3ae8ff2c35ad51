"""Token counts and SentencePiece ids against the libraries themselves."""

import random
from array import array

import public_tokenizers as P
import pytest

from delimkit.llm import sentencepiece_codec as C
from delimkit.llm import token_counts as K

from .conftest import edge_texts

BITS = [" ", "  ", "a", "th", "\n", "\r", "\t", "é", "漢", "😀", "ing", "the", ";", "{}", "//", "1", "23", "\u0000", "Ж", "del", " de", "'s", "'ll", "<|endoftext|>", "<|endof", "՘", "\U00010ec5", "\x1c", "​", "　", "\xa0", "return"]


def random_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_counts_equal_library():
    from tokenizers import Tokenizer

    data = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    counter = K.Counter(data, K.frequent_table(data), cache_entries=300)  # the small cache starts anew often
    t = Tokenizer.from_str(data)
    texts = random_texts(3000) + [x for x in edge_texts() if x]
    assert counter(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counter([None, ""]) == [0, 0]


def test_counts_other_tokenizer():
    from tokenizers import Tokenizer

    data = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    texts = random_texts(200)
    assert K.Counter(data, K.frequent_table(data))(texts) == [len(e.ids) for e in Tokenizer.from_str(data).encode_batch(texts, add_special_tokens=False)]


def test_count_tokens_edges(spark, edge):
    got = K.count_tokens(edge, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == edge.count()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[0].n_bytes, by_id[0].n_tokens, by_id[1].n_tokens) == (0, 0, 0)
    assert None in by_id and by_id[7].over_limit and not by_id[4].over_limit
    assert K.count_tokens(edge.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_pieces_equal_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    codec, lib = C.Codec(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = random_texts(3000, 9) + [x for x in edge_texts() if x]
    ids = [list(array("i", b)) for b in codec.encode(texts)]
    assert ids == lib.encode(texts, num_threads=1)
    assert [codec.decode(x) for x in ids] == [lib.decode(x) for x in ids]
    assert codec.encode([None, ""]) == [b"", b""]


def test_unigram_viterbi_is_best(monkeypatch):
    """The forward pass over the trie finds the best sum of any segmentation."""
    r = random.Random(2)
    codec = C.Codec(open(P.path("piece_bpe_32k.model"), "rb").read())
    codec.kind = C.UNIGRAM
    pieces = ["a", "b", "ab", "ba", "aab", "▁", "▁a", "bb", "abb"]
    codec.id, codec.score, codec.byte, codec.unknown = {p: i for i, p in enumerate(pieces)}, [-r.random() * 5 for _ in pieces], {}, 99
    codec.begins, codec.tails, codec.low = {p[:i] for p in pieces for i in range(1, len(p) + 1)}, {}, -50.0
    words = ["▁" + "".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(200)]

    def best(w):
        top = [0.0] + [None] * len(w)
        for i in range(1, len(w) + 1):
            top[i] = max(top[j] + codec.score[codec.id[w[j:i]]] for j in range(i) if w[j:i] in codec.id and top[j] is not None)
        return top[-1]

    for w, ids in codec.encode_words(words).items():
        got = array("i", ids)
        assert "".join(pieces[i] for i in got) == w
        assert sum(codec.score[i] for i in got) == pytest.approx(best(w))


def test_encode_pieces_edges(spark, edge):
    path = P.path("piece_bpe_32k.model")
    got = C.encode_pieces(edge, path)
    rows = got.collect()
    assert len(rows) == edge.count() and all(r.round_trip for r in rows)
    assert C.encode_pieces(edge.limit(0), path).count() == 0
    back = C.decode_pieces(got, path).select("doc_id", "text").collect()
    assert {r.doc_id: r.text for r in back}[8] == edge_texts()[8]
