"""Media columns: telephony audio.

Payload bytes are stored as 8-bit companded samples in a RIFF/WAVE container (format 7,
mu-law, 8000 Hz, one channel), which keeps them bit by bit. Read back they are expanded by
look-up tables (mu-law or A-law), or decoded as ADPCM blocks step by step across all blocks
at once, and the linear samples are resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

RATE = 8000
PCM, ALAW, ULAW, IMA = 1, 6, 7, 0x11
#: Bytes of an ADPCM block; payloads are padded to a multiple of PAD, which it divides.
BLOCK, PAD = 288, 576


def _ulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, value = (code & 0x70) >> 4, (code & 0x0F) << 4
    value = np.where(part == 0, value + 8, (value + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


ULAW_TABLE, ALAW_TABLE = _ulaw_table(), _alaw_table()

# ADPCM step sizes and index changes of the IMA recommendation.
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]

_STEPS, _INDEX = np.array(IMA_STEPS, np.int32), np.array(IMA_INDEX * 2, np.int32)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and code: the change of the sample, and the next index."""
    code, step = np.arange(16)[None, :], _STEPS[:, None]
    d = step >> 3
    d = d + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -d, d).astype(np.int32)
    following = np.clip(np.arange(89)[:, None] + _INDEX[None, :], 0, 88).astype(np.int32)
    return change.ravel(), following.ravel() * 16


_CHANGE, _NEXT = _adpcm_tables()


def decode_adpcm(data: bytes | np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row each: 4 header bytes (sample, index, nothing), then two codes a byte.

    All blocks advance together, one code at a time. A header index over 88 counts as 88;
    a last block that isn't whole is filled with zero codes.
    """
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    n = -(-len(raw) // block)
    if len(raw) < n * block:
        raw = np.concatenate([raw, np.zeros(n * block - len(raw), np.uint8)])
    b = raw.reshape(n, block)
    sample = np.ascontiguousarray(b[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(b[:, 2], 88).astype(np.int32) * 16
    codes = np.ascontiguousarray(b[:, 4:].T)
    out = np.empty((1 + 2 * (block - 4), n), np.int16)
    out[0] = sample
    for i in range(block - 4):
        for k, code in enumerate((codes[i] & 15, codes[i] >> 4)):
            at = state + code
            sample = np.clip(sample + _CHANGE[at], -32768, 32767)
            state = _NEXT[at]
            out[1 + 2 * i + k] = sample
    return out.T


def encode_adpcm(samples: np.ndarray, block: int = BLOCK) -> bytes:
    """IMA ADPCM blocks of 16-bit samples; the last block is filled with its last sample."""
    per = 1 + 2 * (block - 4)
    x = np.asarray(samples, np.int16).astype(np.int32)
    if not len(x):
        return b""
    n = -(-len(x) // per)
    x = np.concatenate([x, np.repeat(x[-1:], n * per - len(x))]).reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8).reshape(n, 2)
    sample, index = x[:, 0].copy(), np.zeros(n, np.int32)
    for i in range(1, per):
        step = _STEPS[index]
        d = x[:, i] - sample
        code = np.where(d < 0, 8, 0)
        d = np.abs(d)
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            over = d >= step >> shift
            code |= np.where(over, bit, 0)
            d = np.where(over, d - (step >> shift), d)
        at = index * 16 + code
        sample, index = np.clip(sample + _CHANGE[at], -32768, 32767), _NEXT[at] // 16
        out[:, 4 + (i - 1) // 2] |= (code << (4 * ((i - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def resample(samples: np.ndarray, up: int = 2, down: int = 1, reach: int = 4) -> np.ndarray:
    """16-bit samples at up/down times the rate: a windowed-sinc filter of integer taps, so results are exact everywhere."""
    x = np.asarray(samples, np.int64)
    if not len(x):
        return np.zeros(0, np.int16)
    wide = max(up, down)
    half = reach * wide
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / wide) * np.hanning(2 * half + 3)[1:-1]
    out = np.empty(-(-len(x) * up // down), np.int64)
    place = np.arange(len(out)) * down
    for phase in range(up):
        mine = np.flatnonzero(place % up == phase)
        own = taps[(phase + half) % up :: up]
        own = np.rint(own / own.sum() * 16384).astype(np.int64)
        own[len(own) // 2] += 16384 - own.sum()
        lead = (phase + half) // up  # taps that reach ahead of the sample
        full = np.convolve(x, own)
        at = place[mine] // up + lead
        out[mine] = np.where(at < len(full), full[np.minimum(at, len(full) - 1)], 0)
    return np.clip((out + 8192) >> 14, -32768, 32767).astype(np.int16)


def write_wave(data: bytes, kind: int, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A RIFF/WAVE file of one channel."""
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block if kind != IMA else rate // 2, block, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and sample bytes of a RIFF/WAVE file. ValueError if it isn't one."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = media[at + 8 : at + 8 + n]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", body)
        elif name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], body
        at += 8 + n + n % 2
    raise ValueError("no samples")


def linear(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples of a stored file, and their rate."""
    kind, rate, block, data = read_wave(media)
    if kind == PCM:
        return np.frombuffer(data, "<i2"), rate
    if kind == IMA:
        return decode_adpcm(data, block).ravel(), rate
    if kind not in (ALAW, ULAW):
        raise ValueError(f"unknown format {kind}")
    return (ALAW_TABLE if kind == ALAW else ULAW_TABLE)[np.frombuffer(data, np.uint8)], rate


def to_pcm(media: bytes, up: int = 2, down: int = 1) -> bytes:
    """A stored file decoded, resampled, and stored as 16-bit PCM."""
    x, rate = linear(media)
    return write_wave(resample(x, up, down).astype("<i2").tobytes(), PCM, rate * up // down, 16, 2)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of PAD."""
    return data + b"\xff" * ((-len(data)) % PAD or (0 if data else PAD))


def features(media: list[bytes], pcms: list[bytes] | None = None) -> list[str]:
    """Whole-number features of mu-law files: mean and mean size of their linear samples under three codecs, and their resampled PCM (``pcms`` if it is stored).

    The ADPCM blocks of all files are decoded together.
    """
    datas = [np.frombuffer(read_wave(m)[3], np.uint8) for m in media]
    blocks = np.array([-(-len(d) // BLOCK) for d in datas])
    whole = np.concatenate([d if not len(d) % BLOCK else np.concatenate([d, np.zeros(-len(d) % BLOCK, np.uint8)]) for d in datas])
    ad = decode_adpcm(whole)
    at = np.cumsum(blocks) - blocks
    size = blocks * ad.shape[1]
    mean = np.add.reduceat(ad.sum(1, dtype=np.int64), at) // size
    loud = np.add.reduceat(np.abs(ad.astype(np.int32)).sum(1, dtype=np.int64), at) // size
    out = []
    for i, (m, d) in enumerate(zip(media, datas, strict=True)):
        seen, said = np.bincount(d, minlength=256), []
        for table in (ULAW_TABLE, ALAW_TABLE):
            t = table.astype(np.int64)
            said.append(f"{int((seen * t).sum()) // len(d)}/{int((seen * np.abs(t)).sum()) // len(d)}")
        pcm = pcms[i] if pcms else to_pcm(m)
        out.append(f"ulaw={said[0]};alaw={said[1]};adpcm={mean[i]}/{loud[i]};pcm={len(pcm)}/{zlib.crc32(pcm)}")
    return out


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pcm: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, media (the stored file); with ``pcm`` also the resampled PCM file.

    A null text counts as empty and gives one padded block. Repeated rows and null ids
    stay; further columns are ignored; an empty table gives an empty result; a long text
    is stored whole (a file holds up to 4 GB).
    """
    fields = [("n_bytes", T.LongType()), ("media", T.BinaryType())] + ([("pcm", T.BinaryType())] if pcm else [])

    def setup():
        def step(texts):
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
            media = [write_wave(pad(b), ULAW) for b in raw]
            return [list(map(len, raw)), media, *([[to_pcm(m) for m in media]] if pcm else [])]

        return step

    return map_texts(df, setup, fields, id_col, text_col, limit=1 << 20)


def read_audio(stored: DataFrame) -> DataFrame:
    """Read the stored columns back: payload size and digests, the file's size and digest, features; of a pcm column too, size and digest.

    Rows come back one for one, repeated ones and null ids too; further columns are ignored;
    an empty table gives an empty result; media that isn't a RIFF/WAVE file is an error.
    """
    pcm = "pcm" in stored.columns
    names = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    names += [("pcm_bytes", T.LongType()), ("pcm_sha256", T.StringType())] if pcm else []
    schema = T.StructType([stored.schema["doc_id"], stored.schema["n_bytes"], *(T.StructField(n, t) for n, t in names)])

    def run(batches):
        import pyarrow as pa

        from .common import slices

        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                media, rows = part.column("media").to_pylist(), []
                pcms = part.column("pcm").to_pylist() if pcm else None
                for i, (m, feature) in enumerate(zip(media, features(media, pcms), strict=True)):
                    data = read_wave(m)[3]
                    more = (len(pcms[i]), hashlib.sha256(pcms[i]).hexdigest()) if pcm else ()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, *more))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c) for c in cols)], names=schema.names)

    return stored.select("doc_id", "n_bytes", "media", *["pcm"] * pcm).mapInArrow(run, schema)
