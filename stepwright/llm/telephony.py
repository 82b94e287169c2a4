"""Operator 3. Telephony audio columns.

Mu-law and A-law bytes are expanded by 256-entry lookup tables; IMA ADPCM
blocks (4-byte head, then two samples a byte) are decoded by numpy across all
blocks of a batch at once, one step for each sample of a block; the PCM is
resampled by a windowed-sinc filter bank and stored as 16-bit little-endian.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import free_names, map_batches

BLOCK_ALIGN = 256
RATE_IN = 8000
RATE_OUT = 16000
#: Zero crossings of the resampling filter on each side.
ZEROS = 8

_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    t = (((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)
    return np.where(u & 0x80, 0x84 - t, t - 0x84).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, t = (a >> 4) & 7, (a & 0x0F) << 4
    t = np.where(segment == 0, t + 8, (t + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM (blocks x samples) of IMA ADPCM blocks (blocks x bytes): a head (predictor, index, zero), then nibbles, low first."""
    predictor = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    predictor = np.where(predictor >= 32768, predictor - 65536, predictor)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = predictor
    for k in range(blocks.shape[1] - 4):
        byte = blocks[:, 4 + k]
        for half, code in enumerate((byte & 15, byte >> 4)):
            step = _STEP[index]
            code = code.astype(np.int32)
            diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            predictor = np.clip(np.where(code & 8, predictor - diff, predictor + diff), -32768, 32767)
            index = np.clip(index + _INDEX[code], 0, 88)
            out[:, 1 + 2 * k + half] = predictor
    return out


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """PCM at up/down times its rate; ceil(n * up / down) samples, zeros beyond the ends."""
    if up == down or not len(pcm):
        return pcm
    cut = min(1.0, up / down)
    reach = int(np.ceil(ZEROS / cut))
    n = -(-len(pcm) * up // down)
    padded = np.concatenate([np.zeros(reach), pcm.astype(np.float64), np.zeros(reach + 1)])
    out = np.empty(n)
    # The output's samples fall into `up` phases, each with a filter of its own.
    for phase in range(up):
        at = np.arange(phase, n, up, dtype=np.int64)
        whole, part = (at * down) // up, ((phase * down) % up) / up
        offset = np.arange(-reach + 1, reach + 1)
        x = offset - part
        taps = cut * np.sinc(cut * x) * np.where(np.abs(x) <= reach, 0.5 + 0.5 * np.cos(np.pi * x / reach), 0)
        taps /= taps.sum()
        total = np.zeros(len(at))
        for k, t in zip(offset, taps, strict=True):
            total += t * padded[whole + k + reach]
        out[at] = total
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def resample_all(signals: list[np.ndarray | None], up: int, down: int) -> list[np.ndarray | None]:
    """resample() of each signal: they are laid on one line with zeros between them, so that no filter reaches two."""
    some = [k for k, x in enumerate(signals) if x is not None and len(x)]
    if up == down or not some:
        return list(signals)
    gap = int(np.ceil(ZEROS / min(1.0, up / down))) + 2
    length = np.array([len(signals[k]) for k in some])
    # Starts are multiples of `down`: each signal begins at the filter's first phase.
    start = np.concatenate([[0], np.cumsum(-(-(length + gap) // down) * down)])
    line = np.zeros(int(start[-1]), np.int16)
    for k, s in zip(some, start, strict=False):
        line[s : s + len(signals[k])] = signals[k]
    whole = resample(line, up, down)
    out = list(signals)
    for k, s, n in zip(some, start, length, strict=False):
        at = s * up // down
        out[k] = whole[at : at + -(-n * up // down)]
    return out


def decode(codec: list, payload: list, block_align: int) -> list[np.ndarray | None]:
    """PCM of each payload. ADPCM blocks of all payloads are decoded together; a last, shorter block is filled up and cut."""
    out: list[np.ndarray | None] = [None] * len(codec)
    blocks, owner, lengths = [], [], {}
    for i, (kind, data) in enumerate(zip(codec, payload, strict=True)):
        if data is None:
            continue
        raw = np.frombuffer(data, np.uint8)
        if kind in ("mulaw", "alaw"):
            out[i] = (MULAW if kind == "mulaw" else ALAW)[raw]
        elif kind == "adpcm":
            full, rest = divmod(len(raw), block_align)
            n = full + (rest > 4)
            lengths[i] = full * (2 * block_align - 7) + (2 * rest - 7 if rest > 4 else 0)
            filled = np.zeros(n * block_align, np.uint8)
            filled[: min(len(raw), len(filled))] = raw[: len(filled)]
            blocks.append(filled.reshape(n, block_align))
            owner += [i] * n
            out[i] = np.zeros(0, np.int16)
    if owner:
        pcm = decode_adpcm(np.concatenate(blocks))
        edge = np.searchsorted(owner, list(lengths) + [len(codec)])
        for k, i in enumerate(lengths):
            out[i] = pcm[edge[k] : edge[k + 1]].ravel()[: lengths[i]]
    return out


def to_pcm(audio: DataFrame, keys: list[str], codec_col: str = "codec", payload_col: str = "payload", rate_in: int = RATE_IN, rate_out: int = RATE_OUT, block_align: int = BLOCK_ALIGN) -> DataFrame:
    """The key columns, codec, sample_rate, n_samples and pcm (16-bit little-endian) of each row.

    A null payload or a codec other than mulaw, alaw and adpcm gives null n_samples and pcm; an empty payload gives
    0 samples. A last ADPCM block of 4 bytes or fewer has no sample. Null keys and repeated rows pass through; long
    payloads are decoded whole; an empty table gives no rows. Columns beyond those named are not looked at. A key may
    have any name; if it is that of a result, the result has an underscore before its own.
    """
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g

    def make():
        def kernel(batch: pa.RecordBatch):
            codec = batch.column(len(keys)).to_pylist()
            pcm = resample_all(decode(codec, batch.column(len(keys) + 1).to_pylist(), block_align), up, down)
            columns = [*batch.columns[: len(keys)], batch.column(len(keys)), pa.array([rate_out] * len(codec), pa.int32())]
            columns += [pa.array([None if x is None else len(x) for x in pcm], pa.int64()), pa.array([None if x is None else x.astype("<i2").tobytes() for x in pcm], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"key{k}" for k in range(len(keys))] + ["codec", "sample_rate", "n_samples", "pcm"])

        return kernel

    inner = [F.col(f"`{k}`").alias(f"key{n}") for n, k in enumerate(keys)]
    chosen = audio.select(*inner, F.col(f"`{codec_col}`").cast("string").alias("codec"), F.col(f"`{payload_col}`").cast("binary").alias("payload"))
    own = "".join(f"key{n} {audio.schema[k].dataType.simpleString()}, " for n, k in enumerate(keys))
    out = map_batches(chosen, make, f"{own}codec string, sample_rate int, n_samples long, pcm binary", "payload")
    return out.toDF(*keys, *free_names(audio.select(*(F.col(f"`{k}`") for k in keys)), "codec", "sample_rate", "n_samples", "pcm"))
