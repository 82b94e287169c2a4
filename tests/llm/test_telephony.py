import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stepwright.llm import telephony as T


def mulaw(u: int) -> int:
    """ITU-T G.711 by its definition."""
    u = ~u & 0xFF
    t = ((u & 0x0F) * 2 + 33) * 2 ** ((u >> 4) & 7) - 33
    return -4 * t if u & 0x80 else 4 * t


def alaw(a: int) -> int:
    a ^= 0x55
    e, m = (a >> 4) & 7, a & 0x0F
    t = 2 * m + 1 if e == 0 else (2 * m + 33) * 2 ** (e - 1)
    return 8 * t if a & 0x80 else -8 * t


def test_tables():
    assert T.MULAW.tolist() == [mulaw(k) for k in range(256)]
    assert T.ALAW.tolist() == [alaw(k) for k in range(256)]


def scalar_block(block: bytes) -> list[int]:
    """One ADPCM block, sample by sample."""
    p = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [p]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(T._STEP[index])
            d = step >> 3
            d += step if code & 4 else 0
            d += step >> 1 if code & 2 else 0
            d += step >> 2 if code & 1 else 0
            p = max(-32768, min(32767, p - d if code & 8 else p + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(p)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=150), max_size=6))
def test_adpcm_equals_scalar(payloads):
    got = T.decode(["adpcm"] * len(payloads), payloads, 32)
    for data, pcm in zip(payloads, got, strict=True):
        want = [x for k in range(0, len(data), 32) if len(data) - k > 4 for x in scalar_block(data[k : k + 32])]
        assert pcm.tolist() == want


def brute_resample(pcm, up, down):
    cut = min(1.0, up / down)
    reach = int(np.ceil(T.ZEROS / cut))
    out = []
    for n in range(-(-len(pcm) * up // down)):
        x = n * down / up
        ks = np.arange(int(np.floor(x)) - reach + 1, int(np.floor(x)) + reach + 1)
        u = ks - x
        h = cut * np.sinc(cut * u) * np.where(np.abs(u) <= reach, 0.5 + 0.5 * np.cos(np.pi * u / reach), 0)
        h /= h.sum()
        out.append(sum(w * pcm[k] for w, k in zip(h, ks, strict=True) if 0 <= k < len(pcm)))
    return np.clip(np.rint(out), -32768, 32767)


def test_resample_equals_brute_force():
    rng = np.random.default_rng(2)
    for up, down in ((2, 1), (1, 2), (3, 2), (441, 80)):
        pcm = rng.integers(-32768, 32767, 70).astype(np.int16)
        assert np.abs(T.resample(pcm, up, down) - brute_resample(pcm.astype(float), up, down)).max() <= 1
    assert len(T.resample(np.zeros(0, np.int16), 2, 1)) == 0
    tone = (8000 * np.sin(2 * np.pi * 440 * np.arange(800) / 8000)).astype(np.int16)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(T.resample(tone, 2, 1)[100:-100] - want[100:-100]).max() < 60


def test_resample_all_equals_one_by_one():
    rng = np.random.default_rng(5)
    for up, down in ((2, 1), (1, 2), (3, 2), (2, 3), (441, 80), (1, 1)):
        signals = [None if n is None else rng.integers(-32768, 32767, n).astype(np.int16) for n in (5, 0, None, 40, 1, 77, 3)]
        for got, x in zip(T.resample_all(signals, up, down), signals, strict=True):
            assert (got is None) == (x is None) and (x is None or np.array_equal(got, T.resample(x, up, down)))
    assert T.resample_all([], 2, 1) == [] and T.resample_all([None], 2, 1) == [None]


def test_column(spark):
    rng = random.Random(4)
    rows = [(1, "mulaw", rng.randbytes(500), 3), (2, "alaw", rng.randbytes(10), 3), (3, "adpcm", rng.randbytes(700), 3), (4, "opus", b"x", 3), (5, "mulaw", None, 3), (6, "adpcm", b"", 3), (None, "mulaw", b"\x00", 3), (7, None, b"a", 3), (8, "mulaw", bytes(3_000_000), 3), (1, "mulaw", b"\xff", 3)]
    df = spark.createDataFrame(rows, "id long, codec string, payload binary, sample_rate int")
    got = T.to_pcm(df, ["id"]).collect()
    assert len(got) == len(rows)
    of = {(r["id"], r["n_samples"]): r for r in got}
    for i, codec, data, _ in rows:
        pcm = T.decode([codec], [data], T.BLOCK_ALIGN)[0]
        n = None if pcm is None else 2 * len(pcm)
        r = of[i, n]
        assert r["sample_rate"] == 16000 and (r["pcm"] is None) == (pcm is None)
        if pcm is not None:
            assert np.array_equal(np.frombuffer(r["pcm"], "<i2"), T.resample(pcm, 2, 1))
    assert T.to_pcm(df.limit(0), ["id"]).collect() == []


def test_keys_of_any_name(spark):
    rows = [("k", 1, 2, "mulaw", b"abc")]
    audio = spark.createDataFrame(rows, "payload string, pcm int, `a.b` int, c string, p binary")
    out = T.to_pcm(audio, ["payload", "pcm", "a.b"], "c", "p")
    assert out.columns == ["payload", "pcm", "a.b", "codec", "sample_rate", "n_samples", "_pcm"]
    assert [tuple(r)[:6] for r in out.collect()] == [("k", 1, 2, "mulaw", 16000, 6)]
