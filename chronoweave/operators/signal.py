"""Measures of recordings, from overlapping blocks of samples (sources.recordings.read_wav) to rows for each frame.

Only what works on samples runs in Python, in Arrow batches, a block at a time: a block with its halo gives the frames that
start in it, so a recording of any length is spread over as many tasks as it has blocks. Levels, runs, percentiles and
scores are native from there on. Blocks are (path, sr, block, start_sample, lead, samples); `size` below is their length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.windows import framed_median, islands

OCTAVES = (125, 250, 500, 1000, 2000, 4000, 8000)


# -- filters ---------------------------------------------------------------------------------------------------------


def butterworth(hz: np.ndarray, sr: int, order: int, low: float | None, high: float | None) -> np.ndarray:
    """Response at the frequencies hz of a digital Butterworth filter (bilinear transform): band-pass, high-pass or low-pass."""
    warp = lambda f: 2 * np.tan(np.pi * np.minimum(f, 0.4999 * sr) / sr)
    s = 1j * np.maximum(warp(np.asarray(hz, float)), 1e-12)
    if low and high:
        a, b = warp(low), warp(high)
        z = (s * s + a * b) / ((b - a) * s)
    else:
        z = warp(low) / s if low else s / warp(high)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    return 1 / np.prod(z[:, None] - poles, axis=1)


def filtered(x: np.ndarray, sr: int, order: int, low: float | None = None, high: float | None = None) -> np.ndarray:
    """x through the causal filter, applied in its spectrum; a second of zeros holds what rings on."""
    n = 1 << int(np.ceil(np.log2(len(x) + sr + 1)))
    return np.fft.irfft(np.fft.rfft(x, n) * butterworth(np.fft.rfftfreq(n, 1 / sr), sr, order, low, high), n)[: len(x)]


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate, by a windowed sinc of ten zeros on each side."""
    g = gcd(up, down)
    up, down = up // g, down // g
    if up == down or not len(x):
        return x
    widest = max(up, down)
    t = np.arange(-10 * widest, 10 * widest + 1)
    h = np.sinc(t / widest) * np.kaiser(len(t), 5.0)
    h *= up / h.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    n = 1 << int(np.ceil(np.log2(len(wide) + len(h))))
    return np.fft.irfft(np.fft.rfft(wide, n) * np.fft.rfft(h, n), n)[10 * widest : 10 * widest + len(wide)][::down][: -(-len(x) * up // down)]


# -- from blocks to frames -------------------------------------------------------------------------------------------


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
    names = {c: k for k, c in enumerate(batch.schema.names)}
    plain = [batch.column(names[c]).to_pylist() for c in ("path", "sr", "start_sample", "lead")]
    for *head, samples in zip(*plain, batch.column(names["samples"])):
        yield *head, np.asarray(samples.values.to_numpy(zero_copy_only=False), np.float64)


def per_frame(blocks: DataFrame, size: int, frame: Callable[[int], tuple[int, int]], kernel: Callable[[np.ndarray, int], np.ndarray], columns: list[str], prepare: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(path, sr, step, frame, *columns): the kernel's values for each whole frame, a row for each.

    frame(sr) gives a frame's length and the step from one to the next, in samples; the halo of the blocks must be at least
    as long as a frame. kernel(frames, sr) gives a row of values for each. prepare(samples, sr) runs over a block with its halo first."""
    schema = ", ".join(["path string", "sr int", "step double", "frame long", *(f"{c} double" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sr, start, lead, x in _arrays(batch):
                n, step = frame(sr)
                x = prepare(x, sr) if prepare else x
                first = -(-start // step)
                last = min(-(-(start + size) // step), (start - lead + len(x) - n) // step + 1)
                if last <= first:
                    continue
                at = first * step - (start - lead)
                views = np.lib.stride_tricks.sliding_window_view(x[at : at + (last - first - 1) * step + n], n)[::step]
                got = np.concatenate([np.asarray(kernel(views[k : k + 2048], sr), float).reshape(-1, len(columns)) for k in range(0, len(views), 2048)])
                m = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([path] * m), pa.array([sr] * m, pa.int32()), pa.array(np.full(m, step / sr)), pa.array(np.arange(first, last)), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(columns)))], ["path", "sr", "step", "frame", *columns])

    return blocks.mapInArrow(run, schema)


def _samples(seconds: float) -> Callable[[int], tuple[int, int]]:
    return lambda sr: (max(1, int(seconds * sr)),) * 2


def _level(frames: np.ndarray, sr: int) -> np.ndarray:
    return 10 * np.log10((frames**2).mean(axis=1) + 1e-20)


def frame_levels(blocks: DataFrame, size: int, step: float = 0.005) -> DataFrame:
    """(path, sr, step, frame, db): the level of each step, or of the next one where that is louder."""
    raw = per_frame(blocks, size, _samples(step), _level, ["db"])
    following = Window.partitionBy("path").orderBy("frame")
    return raw.withColumn("db", F.greatest("db", F.coalesce(F.lead("db").over(following), F.col("db"))))


def band_levels(blocks: DataFrame, size: int, low: float, high: float, step: float = 0.01) -> DataFrame:
    """(path, sr, step, frame, db): the level between two frequencies; the blocks' halo lets the filter settle."""
    return per_frame(blocks, size, _samples(step), _level, ["db"], lambda x, sr: filtered(x, sr, 4, low, min(high, 0.45 * sr)))


def resampled(blocks: DataFrame, rate: int) -> DataFrame:
    """The blocks at another rate; the block size must be a multiple of the old rate over the greatest common divisor of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (path, sr, start, lead, x), block in zip(_arrays(batch), batch.column(batch.schema.get_field_index("block")).to_pylist()):
                down = sr // gcd(sr, rate)
                up = rate * down // sr
                if start % down:
                    raise ValueError(f"blocks must start at multiples of {down} samples")
                whole = lead // down * down
                y = resample(x[lead - whole :], up, down)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), pa.array([block], pa.int32()), pa.array([start // down * up]), pa.array([whole // down * up], pa.int32()), pa.array([y.astype(np.float32)], pa.list_(pa.float32()))], ["path", "sr", "block", "start_sample", "lead", "samples"])

    return blocks.select("path", "sr", "block", "start_sample", "lead", "samples").mapInArrow(run, "path string, sr int, block int, start_sample long, lead int, samples array<float>")


# -- levels of whole recordings --------------------------------------------------------------------------------------


def loudness(blocks: DataFrame, size: int) -> DataFrame:
    """(path, sr, n, seconds, rms_db, peak_db, true_peak_db): sums and maxima of each block's own samples, merged; the true
    peak counts what a four times finer rate shows between samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sr, _, lead, x in _arrays(batch):
                own = x[lead : lead + size]
                lo = max(0, lead - 64)
                fine = np.abs(resample(x[lo : lead + size + 64], 4, 1))[4 * (lead - lo) : 4 * (lead - lo + len(own))]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sr], pa.int32()), pa.array([len(own)], pa.int64()), *(pa.array([float(v)]) for v in (own @ own, np.abs(own).max(initial=0), fine.max(initial=0)))], ["path", "sr", "n", "squares", "peak", "fine"])

    parts = blocks.mapInArrow(run, "path string, sr int, n long, squares double, peak double, fine double")
    whole = parts.groupBy("path", "sr").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.max("peak").alias("peak"), F.max("fine").alias("fine"))
    db = lambda c: 20 * F.log10(F.col(c) + F.lit(1e-12))
    return whole.select("path", "sr", "n", (F.col("n") / F.col("sr")).alias("seconds"), F.when(F.col("n") == 0, F.lit(-120.0)).otherwise(10 * F.log10(F.col("squares") / F.col("n") + F.lit(1e-24))).alias("rms_db"), db("peak").alias("peak_db"), db("fine").alias("true_peak_db"))


def noise_floor(blocks: DataFrame, size: int, window: float = 0.5) -> DataFrame:
    """(path, noise_floor_db): the quietest window of those that start every half window and end before the recording does;
    the level of the whole where it is shorter than two windows."""
    energy = per_frame(blocks, size, lambda sr: (int(window * sr), int(window * sr) // 2), lambda f, _: (f**2).mean(axis=1), ["e"])
    whole = loudness(blocks, size)
    inside = energy.join(whole.select("path", "n"), "path").where(F.col("frame") * F.round(F.col("step") * F.col("sr")) < F.col("n") - F.floor(window * F.col("sr")))
    least = inside.groupBy("path").agg(F.min("e").alias("e"))
    long = F.col("n") >= 2 * F.floor(window * F.col("sr"))
    return whole.join(least, "path", "left").select("path", F.when(long & F.col("e").isNotNull(), 10 * F.log10(F.col("e") + F.lit(1e-24))).otherwise(F.col("rms_db")).alias("noise_floor_db"))


def mastering_metrics(blocks: DataFrame, size: int) -> DataFrame:
    """loudness with the noise floor and whether each is within what publishers take."""
    out = loudness(blocks, size).join(noise_floor(blocks, size), "path")
    return out.withColumn("rms_ok", F.col("rms_db").between(-23, -18)).withColumn("peak_ok", F.col("true_peak_db") <= -3).withColumn("floor_ok", F.col("noise_floor_db") <= -60)


# -- pauses and clicks -----------------------------------------------------------------------------------------------


def pauses(levels: DataFrame, under_voice: float = 35.0, least: float = 0.2) -> DataFrame:
    """(path, start, end) of the stretches of `least` seconds and more that stay under the loudest twentieth by `under_voice` dB,
    the level smoothed over seven frames."""
    voice = levels.groupBy("path").agg(F.percentile("db", 0.95).alias("voice"))
    smooth = levels.withColumn("smooth", framed_median("db", ["path"], ["frame"], 3)).join(voice, "path")
    quiet = islands(smooth, ["path"], ["frame"], F.col("smooth") < F.col("voice") - under_voice)
    stretches = quiet.groupBy("path", "island").agg(F.min(F.col("frame") * F.col("step")).alias("start"), F.max((F.col("frame") + 1) * F.col("step")).alias("end"))
    return stretches.where(F.col("end") - F.col("start") >= least - 1e-9).select("path", "start", "end")


def clicks(band: DataFrame, stretches: DataFrame, loud: DataFrame, *, edge: float = 0.06, over: float = 15.0, longest: int = 5) -> DataFrame:
    """(path, at, level): spikes of at most `longest` frames in pauses, clear of their ends by `edge` seconds and over the
    pause's median by `over` dB; level is against the recording's. band: levels of 1 to 10 kHz; loud: (path, rms_db)."""
    step = F.col("step")
    span = stretches.withColumnRenamed("start", "p_start").withColumnRenamed("end", "p_end")
    inner = band.withColumn("second", F.floor(F.col("frame") * step)).join(span.withColumn("second", F.explode(F.sequence(F.floor("p_start"), F.floor("p_end")))), ["path", "second"])
    inner = inner.where((F.col("frame") >= F.round(F.col("p_start") / step) + F.round(edge / step)) & (F.col("frame") < F.round(F.col("p_end") / step) - F.round(edge / step)))
    middle = inner.groupBy("path", "p_start").agg(F.percentile("db", 0.5).alias("middle"), F.count("*").alias("frames")).where("frames >= 4")
    held = inner.join(middle, ["path", "p_start"]).join(loud.select("path", "rms_db"), "path")
    spikes = islands(held, ["path", "p_start"], ["frame"], F.col("db") > F.greatest(F.col("middle") + over, F.col("rms_db") - 55))
    each = spikes.groupBy("path", "p_start", "island").agg(F.min(F.col("frame") * step).alias("at"), F.max(F.col("db") - F.col("rms_db")).alias("level"), F.count("*").alias("n"))
    return each.where(F.col("n") <= longest).select("path", "at", "level")


def clicks_per_minute(found: DataFrame, loud: DataFrame, within: float = 30.0) -> DataFrame:
    """(path, clicks_per_minute) of the clicks within so many dB of the recording's level; none counts as 0."""
    near = found.where(F.col("level") > -within).groupBy("path").agg(F.count("*").alias("k"))
    return loud.join(near, "path", "left").select("path", F.coalesce(F.col("k") / F.nullif(F.col("seconds") / 60, F.lit(0.0)), F.lit(0.0)).alias("clicks_per_minute"))


def room_under_voice(levels: DataFrame) -> DataFrame:
    """(path, room_db): the 95th less the 5th percentile of the levels of 300 to 4000 Hz."""
    return levels.groupBy("path").agg((F.percentile("db", 0.95) - F.percentile("db", 0.05)).alias("room_db"))


def room_by_minute(levels: DataFrame) -> DataFrame:
    """(path, minute, room_db): the 5th percentile of each minute; a last one of half a minute or less is left out."""
    per = F.round(60 / F.col("step"))
    minutes = levels.withColumn("minute", F.floor(F.col("frame") / per)).groupBy("path", "minute").agg(F.percentile("db", 0.05).alias("room_db"), F.count("*").alias("k"), F.max(per).alias("per"))
    return minutes.where("k > floor(per / 2)").select("path", "minute", "room_db")


def peak_between(levels: DataFrame, spans: DataFrame, voice: DataFrame) -> DataFrame:
    """spans (path, a, b, ...) with peak: the loudest frame from a to b, against the voice (path, voice), in dB."""
    step = F.col("step")
    seconds = spans.withColumn("_s", F.monotonically_increasing_id()).withColumn("second", F.explode(F.sequence(F.floor("a"), F.floor("b"))))
    inside = levels.withColumn("second", F.floor(F.col("frame") * step)).join(seconds, ["path", "second"])
    inside = inside.where((F.col("frame") >= F.floor(F.col("a") / step)) & (F.col("frame") < F.greatest(F.floor(F.col("b") / step), F.floor(F.col("a") / step) + 1)))
    top = inside.groupBy(*(c for c in spans.columns)).agg(F.max("db").alias("top"))
    return top.join(voice, "path").withColumn("peak", F.col("top") - F.col("voice")).drop("top", "voice")


# -- tone and pitch --------------------------------------------------------------------------------------------------


def octave_tone(blocks: DataFrame, size: int, within: float = 20.0) -> DataFrame:
    """(path, tone): the energy in each of OCTAVES, in dB against 200 to 4000 Hz, over the frames within `within` dB of the loudest twentieth."""

    def kernel(frames: np.ndarray, sr: int) -> np.ndarray:
        hz = np.fft.rfftfreq(frames.shape[1], 1 / sr)
        power = np.abs(np.fft.rfft(frames * np.hanning(frames.shape[1]), axis=1)) ** 2
        band = lambda a, b: power[:, (hz >= a) & (hz < b)].sum(axis=1)
        return np.column_stack([_level(frames, sr), band(200, 4000), *(band(c / 2**0.5, min(c * 2**0.5, sr / 2)) for c in OCTAVES)])

    names = [f"o{c}" for c in OCTAVES]
    rows = per_frame(blocks, size, lambda sr: (2048, 1024), kernel, ["db", "middle", *names])
    loudest = rows.groupBy("path").agg(F.percentile("db", 0.95).alias("top"))
    sums = rows.join(loudest, "path").where(F.col("db") > F.col("top") - within).groupBy("path").agg(*(F.sum(c).alias(c) for c in ("middle", *names)))
    return sums.select("path", F.array(*(10 * F.log10(F.col(c) / (F.col("middle") + 1e-30) + F.lit(1e-30)) for c in names)).alias("tone"))


def yin(frames: np.ndarray, sr: int, n: int, low: float, high: float, *, fine: bool = True, least: float = 0.15) -> np.ndarray:
    """The pitch of each frame (n samples and the longest lag), NaN where none: the first lag whose cumulative mean normalised
    difference is under `least`, followed down to the bottom of its dip."""
    longest, shortest = int(sr / low), int(sr / high)
    size = 1 << int(np.ceil(np.log2(frames.shape[1] + n)))
    head = np.fft.rfft(frames[:, :n], size)
    cross = np.fft.irfft(np.conj(head) * np.fft.rfft(frames, size), size)[:, : longest + 1]
    energy = np.cumsum(np.pad(frames**2, ((0, 0), (1, 0))), axis=1)
    moved = energy[:, n : n + longest + 1] - energy[:, : longest + 1]
    d = np.maximum(0, moved[:, :1] + moved - 2 * cross)[:, 1:]
    norm = d * np.arange(1, longest + 1) / (np.cumsum(d, axis=1) + 1e-20)
    out = np.full(len(frames), np.nan)
    dips = norm[:, shortest - 1 :] < least
    for r in np.flatnonzero(dips.any(axis=1)):
        row, k = norm[r], int(dips[r].argmax()) + shortest - 1
        rising = np.flatnonzero(np.diff(row[k:]) >= 0)
        k += int(rising[0]) if len(rising) else len(row) - 1 - k
        lag = k + 1.0
        if fine and 0 < k < len(row) - 1:
            bend = row[k - 1] - 2 * row[k] + row[k + 1]
            lag += 0.5 * (row[k - 1] - row[k + 1]) / bend if bend > 1e-12 else 0.0
        out[r] = sr / lag
    return out


def voice_frames(blocks: DataFrame, size: int, *, low: float = 60.0, high: float = 400.0) -> DataFrame:
    """(path, sr, step, frame, db, hz, bright): level, pitch (null where unvoiced) and centre of the spectrum every 10 ms of
    blocks at 16 kHz. Pitch counts only in frames within 30 dB of the recording's loudest twentieth."""
    n = 1024

    def kernel(frames: np.ndarray, sr: int) -> np.ndarray:
        power = np.abs(np.fft.rfft(frames[:, :n] * np.hanning(n), axis=1)) ** 2 + 1e-20
        return np.column_stack([_level(frames[:, :n], sr), yin(frames, sr, n, low, high), power @ np.fft.rfftfreq(n, 1 / sr) / power.sum(axis=1)])

    rows = per_frame(blocks, size, lambda sr: (n + int(sr / low), sr // 100), kernel, ["db", "hz", "bright"])
    top = rows.groupBy("path").agg(F.percentile("db", 0.95).alias("top"))
    return rows.join(top, "path").withColumn("hz", F.when(~F.isnan("hz") & (F.col("db") > F.col("top") - 30), F.col("hz"))).drop("top")


def median_pitch(frames: DataFrame, least_frames: int = 10) -> DataFrame:
    """(path, pitch_hz): the median of voiced frames; null below so many."""
    return frames.groupBy("path").agg(F.when(F.count("hz") >= least_frames, F.percentile("hz", 0.5)).alias("pitch_hz"))


def semitones(frames: DataFrame) -> DataFrame:
    """frames with st: semitones above 100 Hz; those over 9 from the median are dropped, and voiced stretches of three and
    more smoothed over three frames, what is missing at their ends counting as zero."""
    raw = frames.withColumn("_st", 12 * F.log2(F.col("hz") / 100))
    middle = raw.groupBy("path").agg(F.percentile("_st", 0.5).alias("_m"))
    kept = raw.join(middle, "path").withColumn("_st", F.when(F.abs(F.col("_st") - F.col("_m")) <= 9, F.col("_st")))
    order = Window.partitionBy("path").orderBy("frame")
    starts = F.sum((F.col("_st").isNull() != F.coalesce(F.lag("_st").over(order).isNull(), F.lit(True))).cast("int")).over(order)
    held = kept.withColumn("_stretch", starts)
    each = Window.partitionBy("path", "_stretch")
    a, b, c = F.coalesce(F.lag("_st").over(each.orderBy("frame")), F.lit(0.0)), F.col("_st"), F.coalesce(F.lead("_st").over(each.orderBy("frame")), F.lit(0.0))
    smooth = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return held.withColumn("st", F.when(b.isNotNull(), F.when(F.count("*").over(each) >= 3, smooth).otherwise(b))).drop("_st", "_m", "_stretch")


def liveliness(frames: DataFrame, *, per_minute: bool = False) -> DataFrame:
    """(path[, minute], lift, movement, spread, brightness) of semitones' rows, null with fewer than 500 frames of speech or
    300 voiced: median pitch, mean step between neighbours (those under 1.5), 90th less 10th percentile, median brightness of
    the louder half. Minutes of less than half are left out."""
    keys = ["path", "minute"] if per_minute else ["path"]
    order = Window.partitionBy("path").orderBy("frame")
    top = frames.groupBy("path").agg((F.percentile("db", 0.95) - 30).alias("speaking"))
    rows = frames.join(top, "path").withColumn("minute", F.floor(F.col("frame") * F.col("step") / 60))
    rows = rows.withColumn("jump", F.abs(F.col("st") - F.lag("st").over(order))).withColumn("voiced", F.col("st").isNotNull() & (F.col("db") > F.col("speaking")))
    half = rows.where("voiced").groupBy(*keys).agg(F.percentile("db", 0.5).alias("half"))
    joined = rows.join(half, keys, "left")
    tone = F.when(F.col("voiced"), F.col("st"))
    small = F.when(F.col("jump") < 1.5, F.col("jump"))
    got = joined.groupBy(*keys).agg(
        F.sum((F.col("db") > F.col("speaking")).cast("int")).alias("speech"),
        F.count(tone).alias("voiced"),
        F.percentile(tone, 0.5).alias("lift"),
        F.when(F.count(small) > 100, F.avg(small) * 100).alias("movement"),
        (F.percentile(tone, 0.9) - F.percentile(tone, 0.1)).alias("spread"),
        F.percentile(F.when(F.col("voiced") & (F.col("db") >= F.col("half")), F.col("bright")), 0.5).alias("brightness"),
        (F.count("*") * F.max("step")).alias("seconds"),
    )
    whole = got.where("seconds >= 30") if per_minute else got
    enough = (F.col("speech") >= 500) & (F.col("voiced") >= 300)
    return whole.select(*keys, *(F.when(enough, F.col(c)).alias(c) for c in ("lift", "movement", "spread", "brightness")))


def standards(blocks: DataFrame, size: int) -> DataFrame:
    """(path, sr, minutes, rms_db, true_peak_db, noise_floor_db, head_s, tail_s, longest_pause_s, clicks_per_minute, tone):
    what the checks of a finished recording need. Pauses within 50 ms of an end are its head or tail."""
    whole = loudness(blocks, size)
    quiet = pauses(band_levels(blocks, size, 80, 12000, 0.005))
    edges = quiet.join(whole.select("path", "seconds"), "path")
    head, tail = F.col("start") < 0.05, F.col("end") > F.col("seconds") - 0.05
    ends = edges.groupBy("path").agg(F.max(F.when(head, F.col("end"))).alias("head"), F.max(F.when(tail, F.col("seconds") - F.col("start"))).alias("tail"), F.max(F.when(~head & ~tail, F.col("end") - F.col("start"))).alias("longest"))
    found = clicks(band_levels(blocks, size, 1000, 10000, 0.005), quiet, whole)
    out = whole.join(ends, "path", "left").join(noise_floor(blocks, size), "path").join(clicks_per_minute(found, whole), "path").join(octave_tone(blocks, size), "path", "left")
    seconds = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 2)
    return out.select("path", "sr", (F.col("seconds") / 60).alias("minutes"), "rms_db", "true_peak_db", "noise_floor_db", seconds("head").alias("head_s"), seconds("tail").alias("tail_s"), seconds("longest").alias("longest_pause_s"), F.round("clicks_per_minute", 1).alias("clicks_per_minute"), "tone")


def sample_mix(voice: DataFrame, wanted: DataFrame, other: DataFrame, share: Column) -> DataFrame:
    """Blocks of voice + share * (wanted - other), place by place, joined by path and block and cut to the shortest."""
    side = lambda df, name: df.select("path", "block", F.col("samples").alias(name))
    joined = side(voice, "v").join(side(wanted, "x"), ["path", "block"]).join(side(other, "e"), ["path", "block"])
    apart = F.zip_with("x", "e", lambda x, e: x - e)
    mixed = F.zip_with("v", apart, lambda v, d: (v + share * d).cast("float"))
    return joined.select("path", "block", F.filter(mixed, lambda y: y.isNotNull()).alias("samples"))
