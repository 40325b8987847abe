import wave

import numpy as np
import pytest

from chronoweave.operators import signal as S
from chronoweave.sources.recordings import read_wav

SR, SIZE, HALO = 16000, 32000, 8000


def voice(seconds, hz=140.0, seed=1):
    """Bursts of a gliding tone with harmonics, 0.4 s of it and 0.3 s of quiet in turn, in soft noise."""
    draw, t = np.random.default_rng(seed), np.arange(int(seconds * SR)) / SR
    phase = np.cumsum(2 * np.pi * hz * (1 + 0.1 * np.sin(2 * np.pi * 0.8 * t)) / SR)
    x = sum(np.sin(k * phase) / k for k in range(1, 6)) * 0.12 * ((t % 0.7) < 0.4)
    return x + draw.normal(0, 1e-4, len(t))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("wav")
    x = voice(70)
    clicky = x.copy()
    for at in (0.55, 2.65, 7.55):  # in the middle of a quiet stretch
        clicky[int(at * SR) : int(at * SR) + 48] += 0.05 * np.random.default_rng(2).normal(0, 1, 48)
    sine = 0.1 * np.sin(2 * np.pi * 1000 * np.arange(5 * SR) / SR)
    for name, y in {"plain": x, "clicky": clicky, "sine": sine, "short": x[:3000]}.items():
        with wave.open(str(out / f"{name}.wav"), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(SR)
            f.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out


@pytest.fixture(scope="module")
def blocks(spark, folder):
    return read_wav(spark, str(folder), block=SIZE, halo=HALO).cache()


def name(row):
    return row.path.rsplit("/", 1)[1][:-4]


def test_filter_and_resampling():
    t = np.arange(SR) / SR
    for hz, least, most in ((50, -99, -40), (1000, -0.1, 0.1), (7000, -99, -20)):
        y = S.filtered(np.sin(2 * np.pi * hz * t), SR, 4, 300, 4000)[SR // 4 :]
        assert least < 10 * np.log10(2 * (y**2).mean()) < most
    x = np.sin(2 * np.pi * 440 * t)
    assert np.abs(S.resample(x, 3, 2)[500:-500] - np.sin(2 * np.pi * 440 * np.arange(24000) / 24000)[500:-500]).max() < 2e-3


def test_levels(blocks):
    got = {name(r): r for r in S.mastering_metrics(blocks, SIZE).collect()}
    assert abs(got["sine"].rms_db + 23.01) < 0.01 and abs(got["sine"].true_peak_db + 20) < 0.05 and got["sine"].n == 5 * SR and not got["sine"].rms_ok
    assert got["short"].noise_floor_db == got["short"].rms_db
    x = (np.clip(voice(70), -1, 1) * 32767).astype("<i2") / 32768
    want = 10 * np.log10(min((x[s : s + 8000] ** 2).mean() for s in range(0, len(x) - 8000, 4000)))
    assert abs(got["plain"].noise_floor_db - want) < 1e-6
    tone = S.band_levels(blocks.where("path like '%sine%'"), SIZE, 300, 4000).toPandas()
    assert abs(tone.db.median() + 23.0) < 0.3 and sorted(tone.frame) == list(range(500))
    room = {name(r): r.room_db for r in S.room_under_voice(S.band_levels(blocks, SIZE, 300, 4000, 0.05)).collect()}
    assert room["plain"] > 30 and room["sine"] < 3
    minutes = S.room_by_minute(S.band_levels(blocks.where("path like '%plain%'"), SIZE, 300, 4000, 0.05)).collect()
    assert [r.minute for r in minutes] == [0]
    loud = S.frame_levels(blocks.where("path like '%short%'"), SIZE).orderBy("frame").toPandas().db.to_numpy()
    y = x[:3000].reshape(-1, 80)[:37] if 3000 % 80 == 0 else x[: 3000 // 80 * 80].reshape(-1, 80)
    own = 10 * np.log10((y**2).mean(axis=1) + 1e-20)
    assert np.allclose(loud, np.maximum(own, np.append(own[1:], own[-1])))


def test_pauses_and_clicks(blocks):
    levels = S.band_levels(blocks, SIZE, 80, 12000, 0.005)
    quiet = S.pauses(levels)
    here = [r for r in quiet.collect() if name(r) == "plain"]
    assert len(here) == 100 and all(abs(r.end - r.start - 0.3) < 0.06 for r in here)
    loud = S.loudness(blocks, SIZE)
    found = S.clicks(S.band_levels(blocks, SIZE, 1000, 10000, 0.005), quiet, loud)
    assert sorted(round(r.at, 1) for r in found.collect() if name(r) == "clicky") == [0.5, 2.6, 7.5] or sorted(round(r.at, 2) for r in found.collect() if name(r) == "clicky") == [0.55, 2.65, 7.55]
    rate = {name(r): r.clicks_per_minute for r in S.clicks_per_minute(found, loud).collect()}
    assert rate["plain"] == 0 and abs(rate["clicky"] - 3 / 70 * 60) < 1e-9 and rate["short"] == 0


def test_pitch_and_liveliness(blocks):
    frames = S.voice_frames(blocks.where("path like '%plain%'"), SIZE)
    assert abs(S.median_pitch(frames).first().pitch_hz - 140) < 4
    tones = S.semitones(frames)
    got = S.liveliness(tones).first()
    assert abs(got.lift - 12 * np.log2(1.4)) < 0.5 and 1 < got.spread < 5 and got.movement > 0 and 100 < got.brightness < 1000
    assert [r.minute for r in S.liveliness(tones, per_minute=True).collect()] == [0]
    steady = S.resampled(blocks.where("path like '%sine%'"), 8000)
    assert abs(S.loudness(steady, SIZE // 2).first().rms_db + 23.01) < 0.05


def test_standards(blocks):
    got = {name(r): r for r in S.standards(blocks.where("path not like '%short%'"), SIZE).collect()}
    assert got["plain"].head_s == 0 and abs(got["plain"].longest_pause_s - 0.3) < 0.06 and abs(got["plain"].tail_s - 0.3) < 0.06
    assert len(got["sine"].tone) == 7 and got["sine"].tone[3] > -0.1 and max(got["sine"].tone[:2]) < -30


def test_mix(spark):
    from pyspark.sql import functions as F

    one = lambda *x: spark.createDataFrame([("p", 0, [float(v) for v in x])], "path string, block int, samples array<float>")
    assert S.sample_mix(one(1, 2, 3), one(4, 4, 4, 4), one(2, 0), F.lit(0.5)).first().samples == [2.0, 4.0]
