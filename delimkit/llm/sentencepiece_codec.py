"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The text is cut into marked words (runs of the mark, then what follows). The distinct words
of a slice are sorted, which makes them a trie read depth-first: the forward state of each
prefix is kept on a stack, and a word only computes what its common prefix with the word
before it hasn't. At the end of a word the pieces are read back from the last state.

A state is the last piece of its prefix. For a unigram model it is the piece of the best
summed score (Viterbi). For a BPE model the library merges by rank instead of maximising a
sum; there the state is the one piece whose neighbour before it stays separate from it if
the two are encoded alone. A sequence is the BPE encoding exactly if all its neighbours
are so compatible, hence the same pass gives the library's ids.
"""

from __future__ import annotations

import hashlib
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6
#: Entries of a worker's caches of words and of neighbours; beyond them a cache starts anew.
CACHE_WORDS, CACHE_PAIRS = 250_000, 700_000
CACHE_CHARS = 24


class Codec:
    """Encodes and decodes with the pieces of a model; one lives in each task.

    Raises ValueError for a model whose normaliser changes texts, or whose pieces hold the
    mark elsewhere than in front: words wouldn't be independent there.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model changes texts before encoding them")
        self.kind, self.dummy = m.trainer_spec.model_type, spec.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self.id, self.score, self.byte, self.surface = {}, [], {}, []
        self.unknown = 0
        for i, p in enumerate(m.pieces):
            self.score.append(p.score)
            self.surface.append(p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"")
            if p.type == NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece holds the mark behind other characters")
                self.id[p.piece] = i
            elif p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == pb.ModelProto.SentencePiece.UNKNOWN:
                self.unknown = i
                self.surface[i] = (m.trainer_spec.unk_surface or " ⁇ ").encode()
        self.begins = {p[:i] for p in self.id for i in range(1, len(p) + 1)}
        self.low = min([s for s, p in zip(self.score, m.pieces, strict=True) if p.type == NORMAL], default=0.0) - 10.0
        self.tails: dict[str, tuple[str, tuple]] = {}
        self.apart: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.words: dict[str, bytes] = {}

    # -- the forward pass

    def _tail(self, s: str) -> tuple[str, tuple]:
        """The longest end of ``s`` that begins a piece, and the pieces among its ends, longest first.

        Each piece comes with its length and its known neighbours. A single character
        always counts as a piece: unknown ones become bytes later.
        """
        t = s
        while len(t) > 1 and t not in self.begins:
            t = t[1:]
        ends = (t[i:] for i in range(len(t)) if t[i:] in self.id or i == len(t) - 1)
        got = self.tails[s] = (t, tuple((e, len(e), self.apart.setdefault(e, {})) for e in ends))
        return got

    def _separate(self, left: str, right: str) -> bool:
        """Whether left + right, merged by rank alone, ends as exactly these two pieces."""
        parts = list(left + right)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                j = self.id.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best[0]):
                    best = (self.score[j], i)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        self.pairs += 1
        got = self.apart[right][left] = parts == [left, right]
        return got

    def _extend_bpe(self, word: str, at: int, state: str, last: list, states: list) -> None:
        """States after word[:at + 1], ..., word: the one compatible piece each."""
        tails = self.tails.get
        for i in range(at, len(word)):
            state, ends = tails(state + word[i]) or self._tail(state + word[i])
            for t, n, known in ends:
                left = last[i + 1 - n]
                if not left:
                    break  # the piece begins the word
                ok = known.get(left)
                if ok or ok is None and self._separate(left, t):
                    break
            else:
                raise ValueError(f"no compatible piece ends {word[: i + 1]!r}")
            last.append(t)
            states.append(state)

    def _extend_unigram(self, word: str, at: int, state: str, last: list, states: list, total: list) -> None:
        """States after word[:at + 1], ..., word: the piece of the best sum each."""
        for i in range(at, len(word)):
            state, ends = self.tails.get(state + word[i]) or self._tail(state + word[i])
            best = None
            for t, n, _ in ends:
                j = self.id.get(t)
                s = total[i + 1 - n] + (self.low if j is None else self.score[j])
                if best is None or s > best[0]:
                    best = (s, t)
            last.append(best[1])
            total.append(best[0])
            states.append(state)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (as 4-byte integers in a row) of distinct marked words, by one depth-first pass over their trie."""
        if self.pairs > CACHE_PAIRS:
            self.tails, self.apart, self.pairs = {}, {}, 0
        out, one = {}, {t: array("i", [j]).tobytes() for t, j in self.id.items()}.get
        last, total, states = [""], [0.0], [""]
        before = ""
        for word in sorted(words):
            n = min(len(word), len(before))
            shared = n
            if word[:n] != before[:n]:
                shared = 0
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], states[shared + 1 :], total[shared + 1 :]
            if self.kind == BPE:
                self._extend_bpe(word, shared, states[shared], last, states)
            else:
                self._extend_unigram(word, shared, states[shared], last, states, total)
            at, pieces = len(word), []
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            pieces.reverse()
            ids = list(map(one, pieces))
            out[word] = self._with_unknown(pieces) if None in ids else b"".join(ids)
            before = word
        return out

    def _with_unknown(self, pieces: list[str]) -> bytes:
        """Ids where some characters aren't pieces: their bytes, or one unknown piece for a run of them."""
        ids = array("i")
        for t in pieces:
            j = self.id.get(t)
            if j is not None:
                ids.append(j)
            elif self.byte:
                ids.extend(self.byte[b] for b in t.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids.tobytes()

    # -- texts

    def marked(self, text: str) -> list[str]:
        """The marked words of a text; joined they are the text with marks for spaces."""
        if not text:
            return []
        if self.dummy and MARK not in text and text[0] != " " and text[-1] != " " and "  " not in text:
            return [MARK + w for w in text.split(" ")]
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK if self.dummy else "") + text.replace(" ", MARK))

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as 4-byte integers in a row; nothing for null and empty texts."""
        cut = [self.marked(t) if t else [] for t in texts]
        late = self.encode_words(list(set().union(*cut) - self.words.keys()))
        self.words |= late
        out = [b"".join(map(self.words.__getitem__, ws)) for ws in cut]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        else:
            for w in late:
                if len(w) > CACHE_CHARS:
                    del self.words[w]
        return out

    def decode(self, ids) -> str:
        """The text of ids: the mark becomes a space, the one put in front goes, broken bytes become U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pieces, piece_ids (array of int), decoded_sha256, round_trip.

    The ids are those of the library without begin and end pieces. They are decoded again:
    decoded_sha256 is the digest of the UTF-8 of what comes out, round_trip whether it is
    the text (a null text counts as empty). Texts that hold the mark itself (U+2581) come
    back with a space there, as from the library, and round_trip is false. Repeated rows
    and null ids stay; further columns are ignored; an empty table gives an empty result.
    """
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def setup():
        import numpy as np
        import pyarrow as pa

        codec = Codec(shared.value)

        def step(texts):
            ids = [array("i", b) for b in codec.encode(texts)]
            back = [codec.decode(x) for x in ids]
            flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in ids if len(x))])
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return [list(map(len, ids)), lists, [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], [b == (t or "") for b, t in zip(back, texts, strict=True)]]

        return step

    fields = [("n_pieces", T.LongType()), ("piece_ids", T.ArrayType(T.IntegerType(), False)), ("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]
    return map_texts(df, setup, fields, id_col, text_col, limit=4 << 20)


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "text") -> DataFrame:
    """Add ``out_col``: the text of a column of ids. Null ids stay null; no ids give an empty text.

    A column of that name gives way to the new one. Repeated rows stay; an empty table gives
    an empty result; an id that the model lacks is an error.
    """
    df = df.drop(out_col) if out_col != ids_col else df
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def text(frames):
        import pyarrow as pa

        codec = Codec(shared.value)
        for b in frames:
            made = [None if x is None else codec.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out_col])

    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    return df.mapInArrow(text, schema)
