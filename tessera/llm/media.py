"""Media columns: telephony audio (mu-law, A-law, IMA ADPCM) in WAV form, expanded to PCM, resampled and stored.

mu-law and A-law samples are expanded through 256-entry tables; ADPCM blocks are decoded position by position
with numpy across all blocks of a recording, since blocks are independent and samples within one are not.

Nulls count as empty texts; equal texts give equal values; an empty payload gives empty PCM; repeated rows stay
separate recordings; long texts are long recordings, taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, materialise, table, text_runs

PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17

#: Fixed values of the IMA ADPCM format: change of the step index by the code's three low bits.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of the IMA ADPCM format: step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code (G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code (G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def write_wav(kind: int, rate: int, data: bytes, block: int = 1, samples: int = 0) -> bytes:
    """One-channel WAV file. block, samples: bytes and samples of an ADPCM block."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(kind, 8)
    block = 2 if kind == PCM else block
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * block if kind != IMA_ADPCM else rate * block // max(samples, 1), block, bits)
    if kind == IMA_ADPCM:
        form += struct.pack("<HH", 2, samples)
    elif kind != PCM:
        form += struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form
    if kind != PCM:
        body += b"fact" + struct.pack("<II", 4, len(data))
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block bytes, data) of a one-channel WAV file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[1] != 1:
                raise ValueError("no format, or not one channel")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def encode_adpcm(pcm: np.ndarray, block: int = 256) -> bytes:
    """IMA ADPCM blocks of `block` bytes, encoded across blocks; the last block is filled with its last sample."""
    per = (block - 4) * 2 + 1
    n = -(-len(pcm) // per)
    if n == 0:
        return b""
    x = np.concatenate([pcm, np.repeat(pcm[-1:], n * per - len(pcm))]).astype(np.int32).reshape(n, per)
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    codes = np.zeros((n, per - 1), np.uint8)
    for i in range(1, per):
        step, diff = STEPS[index], x[:, i] - value
        code = np.minimum(np.abs(diff) * 4 // step, 7).astype(np.int32)
        code |= np.where(diff < 0, 8, 0)
        value, index = _adpcm_step(value, index, code)
        codes[:, i - 1] = code
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    out[:, 4:] = codes[:, 0::2] | (codes[:, 1::2] << 4)
    return out.tobytes()


def _adpcm_step(value: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
    return value, np.clip(index + INDEX_CHANGE[code & 7], 0, 88)


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """PCM of whole IMA ADPCM blocks, all blocks at once; an incomplete last block is left out."""
    n = len(data) // block
    raw = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    out = np.empty((n, (block - 4) * 2 + 1), np.int16)
    out[:, 0] = value
    for i in range(1, out.shape[1]):
        code = (raw[:, 4 + (i - 1) // 2] >> (4 * ((i - 1) % 2))).astype(np.int32) & 15
        value, index = _adpcm_step(value, index, code)
        out[:, i] = value
    return out.ravel()


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit PCM) of a WAV file in any of the four formats."""
    kind, rate, block, data = read_wav(media)
    if kind == MULAW:
        return rate, MULAW_PCM[np.frombuffer(data, np.uint8)]
    if kind == ALAW:
        return rate, ALAW_PCM[np.frombuffer(data, np.uint8)]
    if kind == IMA_ADPCM:
        return rate, decode_adpcm(data, block)
    if kind == PCM:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    raise ValueError(f"format {kind}")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Upwards linear interpolation, downwards the mean over each new sample's span. Positions and weights are integers, so that the result is the same everywhere."""
    if not len(pcm) or rate == to:
        return pcm.astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2], out[-1] = pcm, pcm[-1]
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        return out
    if rate % to == 0:
        k, whole = rate // to, len(pcm) // (rate // to)
        out = sum(pcm[i : whole * k : k].astype(np.int64) for i in range(k)) // k
        rest = pcm[whole * k :].astype(np.int64)
        return np.append(out, rest.sum() // len(rest) if len(rest) else []).astype(np.int16)
    at = np.arange(-(-len(pcm) * to // rate) + (to < rate), dtype=np.int64) * rate
    if to < rate:
        at = np.minimum(at, len(pcm) * to)
        i, part = at // to, at % to
        sums = np.concatenate(([0], np.cumsum(pcm, dtype=np.int64)))
        area = sums[i] * to + np.append(pcm, 0).astype(np.int64)[i] * part
        return (np.diff(area) // np.diff(at)).astype(np.int16)
    i, part = at // to, at % to
    j = np.minimum(i + 1, len(pcm) - 1)
    return ((pcm[i].astype(np.int64) * (to - part) + pcm[j].astype(np.int64) * part) // to).astype(np.int16)


DIGESTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def features(pcm: np.ndarray, rate: int) -> str:
    """Whole-number features, exact on every machine: rate, samples, peak, mean square, sign changes."""
    square, peak = 0, 0
    for at in range(0, len(pcm), 1 << 22):  # sums of so many squares are exact
        x = pcm[at : at + (1 << 22)].astype(np.float64)
        square, peak = square + int(np.dot(x, x)), max(peak, int(x.max()), int(-x.min()))
    below = pcm < 0
    return f"rate={rate};n={len(pcm)};peak={peak};ms={square // max(len(pcm), 1)};zc={np.count_nonzero(below[1:] ^ below[:-1])}"


def payload(text: str | None) -> tuple[int, bytes]:
    """(length in UTF-8, those bytes and zeros up to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_texts(docs: DataFrame, rate: int = 16000) -> DataFrame:
    """Texts as mu-law recordings: doc_id, n_bytes, media (WAV). A null text is an empty one."""

    def run(texts: list) -> list:
        kept = [payload(t) for t in texts]
        return [[n for n, _ in kept], [write_wav(MULAW, rate, p) for _, p in kept]]

    return map_texts(docs, ["doc_id"], run, "n_bytes long, media binary")


def decode_media(media: DataFrame, to_rate: int = 8000) -> DataFrame:
    """media(doc_id, media, ...) with pcm (16-bit WAV at to_rate) added; null media give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256].copy()
                part["pcm"] = [_pcm_wav(m, to_rate) for m in part["media"]]
                yield part

    return media.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + ", pcm binary")


def _pcm_wav(media: bytes | None, to_rate: int) -> bytes | None:
    if media is None:
        return None
    rate, pcm = decode(bytes(media))
    return write_wav(PCM, to_rate, resample(pcm, rate, to_rate).astype("<i2").tobytes())


def stored_media(docs: DataFrame, rate: int = 16000, to_rate: int = 8000) -> DataFrame:
    """The texts' wide-band recordings and their PCM in telephone band as a table in the shared folder, read back: doc_id, n_bytes, media, pcm."""
    return materialise(decode_media(store_texts(docs, rate), to_rate), "media", 9)


def digest_media(stored: DataFrame) -> DataFrame:
    """doc_id, digests and features of each row of stored_media(), all from the stored bytes.

    Features: of the stored PCM, and of what the payload's bytes are as A-law codes and as ADPCM blocks of 64 bytes
    (decoded across all recordings of a run at once).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_runs(batch.column(2)):
                rows, backs = [], []
                for n, media, pcm in zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in (1, 2, 3))):
                    _, rate, _, back = read_wav(media)
                    backs.append(back)
                    rows.append([n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"pcm:{features(*decode(pcm)[::-1])},alaw:{features(ALAW_PCM[np.frombuffer(back, np.uint8)], rate)}"])
                samples = decode_adpcm(b"".join(backs), 64)
                ends = np.cumsum([len(b) // 64 for b in backs]) * 121
                for row, end, start in zip(rows, ends.tolist(), [0, *ends.tolist()]):
                    row[-1] += f",adpcm:{features(samples[start:end], rate)}"
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["doc_id", *DIGESTS])

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(stored_media(table(spark, sf_dir, "documents")))
