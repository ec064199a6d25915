"""Telephony audio in media columns.

A payload of bytes is stored as a one-channel WAV file of 8-bit companded samples (mu-law or
A-law) or of 4-bit ADPCM blocks of 64 bytes (IMA). Reading takes the codec and the data from the
stored header, expands companded samples by lookup table, decodes ADPCM with numpy across all
blocks of an Arrow batch (one step per place in a block, whatever the number of blocks), and
resamples to a target rate by linear interpolation in whole numbers, so results repeat exactly.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import prepare
from recordloom.session import stored

BLOCK = 64
RATE = 8_000
PCM_RATE = 16_000
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Fixed values of IMA ADPCM: change of the step index by the low three bits of a code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
#: Fixed values of IMA ADPCM: the 89 step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767], np.int64)


def mulaw_table() -> np.ndarray:
    """All 256 mu-law codes as 16-bit samples: inverted bits, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """All 256 A-law codes as 16-bit samples: every other bit inverted, exponent 0 is linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """The stored form: RIFF header, format chunk, data chunk."""
    if codec == "adpcm":
        per_block = (BLOCK - 4) * 2 + 1
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and payload, found by walking the chunks of the stored bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        found[name] = media[at + 8:at + 8 + size]
        at += 8 + size + (size & 1)
    tag, _, rate = struct.unpack_from("<HHI", found[b"fmt "])
    return {v: k for k, v in TAGS.items()}[tag], rate, found[b"data"]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) -> (blocks, samples): all blocks advance together, sample by sample."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2").ravel().astype(np.int64)
    index = np.minimum(head[:, 2], 88).astype(np.int64)
    codes = np.empty((blocks.shape[0], (blocks.shape[1] - 4) * 2), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    codes = np.ascontiguousarray(codes.T)
    out = np.empty((codes.shape[0] + 1, blocks.shape[0]), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[k] = value
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation at every target tick, in whole numbers; the last sample is held."""
    if source == target or not len(pcm):
        return pcm
    tick = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    at, part = tick // target, tick % target
    wide = np.append(pcm, pcm[-1]).astype(np.int64)
    return ((wide[at] * (target - part) + wide[at + 1] * part) // target).astype(np.int16)


def features(codec: str, pcm: np.ndarray, rate: int) -> str:
    """Codec, rate, samples, root mean square, peak, sign changes, and a checksum of the PCM."""
    wide = pcm.astype(np.int64)
    energy = math.isqrt(int((wide * wide).sum()) // max(1, len(wide)))
    changes = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
    peak = int(np.abs(wide).max(initial=0))
    return f"{codec};rate={rate};n={len(pcm)};rms={energy};peak={peak};zc={changes};pcm={zlib.crc32(pcm.astype('<i2').tobytes())}"


def payload_of(text: str | None, unit: int = BLOCK) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes padded with zeros to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def codec_of(payload: bytes) -> str:
    """The codec depends on the payload alone, so equal texts are stored alike."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def store_texts(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a WAV file, one row per input row.

    A null text counts as empty, and an empty one is 64 zero bytes. With no `codec` named the
    payload's checksum picks one of the three.
    """
    def rows(batches):
        for batch in batches:
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in made], pa.int64()),
                pa.array([wav(codec or codec_of(p), p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, pcm_rate: int = PCM_RATE, with_pcm: bool = True) -> DataFrame:
    """All input columns but `media` kept as they are; adds payload_bytes, payload_sha256,
    tail_crc32, feature, and `pcm` (resampled 16-bit little-endian samples) if asked for.

    A null media value gives nulls.
    """
    kept = [f for f in media.schema.fields if f.name != "media"]
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string" + (", pcm binary" if with_pcm else "")
    order = [f.name for f in kept]

    def rows(batches):
        for batch in batches:
            files = [None if m is None else unwav(m) for m in batch.column("media").to_pylist()]
            cells = [np.frombuffer(f[2], np.uint8).reshape(-1, BLOCK) for f in files if f and f[0] == "adpcm"]
            decoded = iter(np.split(decode_adpcm(np.concatenate(cells)), np.cumsum([len(c) for c in cells])[:-1])) if cells else iter(())
            out = []
            for f in files:
                if f is None:
                    out.append((None,) * 5)
                    continue
                codec, rate, payload = f
                pcm = next(decoded).ravel() if codec == "adpcm" else TABLES[codec][np.frombuffer(payload, np.uint8)]
                pcm = resample(pcm, rate, pcm_rate)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]),
                            features(codec, pcm, pcm_rate), pcm.astype("<i2").tobytes() if with_pcm else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()][:5 if with_pcm else 4]
            arrays = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "pcm"][:len(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in order] + arrays, order + names)

    prepare(media.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [added])
    return media.mapInArrow(rows, schema)


def round_trip(docs: DataFrame, pcm_rate: int = PCM_RATE) -> DataFrame:
    """Texts stored as a media table in the shared folder, read back, decoded and resampled.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm: one row per input
    row. The samples leave as a column, so they are stored once, where the caller writes the result, and
    features are measured on them. A null text is an empty one (64 zero bytes), repeated rows give equal
    values, an empty table gives an empty one, other columns are ignored. The media table is compressed.
    """
    table = stored(store_texts(docs))
    seen = table.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return read_media(seen, pcm_rate).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
