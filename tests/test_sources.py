import wave

import numpy as np
from pyspark.sql import functions as F

from chronoweave.sources import recordings
from chronoweave.streaming import rollup


def _wav(path, x, channels=1, rate=8000):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def test_wav_blocks(spark, tmp_path):
    x = np.sin(np.arange(1050) / 9)
    _wav(tmp_path / "a.wav", x)
    _wav(tmp_path / "empty.wav", x[:0])
    _wav(tmp_path / "stereo.wav", np.repeat(x[:100], 2), channels=2)
    rows = [r for r in recordings.read_wav(spark, f"file://{tmp_path}", block=400, halo=10).orderBy("path", "block").collect()]
    a = [r for r in rows if r.path.endswith("/a.wav")]
    assert [(r.start_sample, r.lead, len(r.samples)) for r in a] == [(0, 0, 410), (400, 10, 420), (800, 10, 260)] and a[0].sr == 8000
    assert np.abs(np.concatenate([np.array(r.samples)[r.lead : r.lead + 400] for r in a]) - x).max() < 1e-4
    assert len(rows) == 4 and np.abs(np.array(rows[3].samples) - x[:100]).max() < 1e-4


def test_24_bit():
    assert np.allclose(recordings.pcm(bytes([0, 0, 0x40, 0, 0, 0xC0]), 3, 1), [0.5, -0.5])


def test_words_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("f", 2.0, 0, "one", 0.1, 0.4), ("f", 2.0, 1, "two", 0.5, 0.9), ("g", 1.0, 0, "x", 0.0, 1.0)], "file string, duration double, pos int, text string, start double, end double")
    recordings.write_transcripts(words, f"file://{tmp_path}/t")
    back = spark.read.schema(recordings.TRANSCRIPT).json(f"file://{tmp_path}/t")
    assert sorted((r.file, [w.text for w in r.words]) for r in back.collect()) == [("f", ["one", "two"]), ("g", ["x"])]


def test_read_through(spark):
    wanted, cached = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2, "old"), (3, "old")], "k int, v string")
    got = recordings.read_through(wanted, cached, ["k"], lambda miss: miss.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (2, "old")]


def test_stream_resumes(spark, sf_dir, tmp_path):
    """A stream read in two goes gives each row once; repeats of an id are dropped."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: rollup.once(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["event_id"], "ts", late="10000 days")
    rollup.append(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    events.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rollup.append(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("event_id").distinct().count() == events.count()


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    found = rollup.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["user_id"], "ts", "value", size="6 hours")
    run = found.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(60)
    whole = rollup.windowed(events, ["user_id"], "ts", "value", size="6 hours").select("user_id", "window_start", "n")
    assert whole.exceptAll(spark.table("windows").select("user_id", "window_start", "n")).isEmpty() and whole.count() == spark.table("windows").count()
