import csv
import datetime as dt
import glob
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import score
from chronoweave.plans import incremental as I
from chronoweave.sources import projects as P
from chronoweave.sources import sinks as K


def test_settings():
    s = P.settings('head = 2.0\nother = 1\n[master]\nrms_db = -19.5\nnoise_reduction = true\n')
    assert (s.head, s.tail, s.master.rms_db, s.master.noise_reduction, s.master.mp3_kbps) == (2.0, 3.0, -19.5, "on", 192)
    assert P.settings().master.noise_reduction == "auto"
    with pytest.raises(ValueError, match="unknown setting"):
        P.settings("[master]\nloud = 1")
    with pytest.raises(ValueError, match="auto"):
        P.settings('[master]\nnoise_reduction = "maybe"')
    assert (P.workers(3), P.workers(0, 4), P.workers(0, 64), P.workers(0, 1)) == (3, 3, 8, 1)


PROJECT = """
script = "book.md"
speaker = "s"
[[chapter]]
title = "One"
from = "Chapter 1"
audio = "raw/ch1*.wav"
[[chapter]]
name = "two"
script = "two.md"
audio = ["raw/a.wav", "raw/b.wav"]
[[chapter]]
name = "bare"
"""


def test_chapters(spark):
    got = P.chapters(spark, PROJECT, "/base")
    rows = {r.n: r for r in got.collect()}
    assert (rows[1].name, rows[1].title, rows[1].script, rows[2].script, rows[3].script) == ("chapter-01", "One", "/base/book.md", "/base/two.md", None)
    assert [r.n for r in P.chapters(spark, PROJECT, "/base", "tw").collect()] == [2]
    files = spark.createDataFrame([("/base/edited/two.wav", 5), ("/base/edited/two.mp3", 0), ("/base/edited/chapter-01.mp3", 3), ("/base/edited/chapter-01.wav", 3)], "path string, length long")
    done = {r.name: (r.finished, r.problem) for r in P.with_finished(got, files).collect()}
    assert done == {"chapter-01": ("/base/edited/chapter-01.mp3", None), "two": ("/base/edited/two.wav", None), "bare": (None, "needs a reference text")}
    raw = spark.createDataFrame([("/base/raw/ch1.x.wav",), ("/base/raw/a.wav",), ("/base/raw/b.wav",)], "path string")
    one = {r.name: (r.path, r.problem) for r in P.one_recording(got, raw).collect()}
    assert one == {"chapter-01": ("/base/raw/ch1.x.wav", None), "two": (None, "audio must name one recording; it matches 2"), "bare": (None, "audio must name one recording; it matches 0")}


def test_json_sources(spark, tmp_path):
    (tmp_path / "takes.json").write_text(json.dumps([{"n": 1, "rating": 3, "start": 0.5, "end": 1.0, "words": "Well, THAT was a very long and odd take!"}, {"n": 2, "rating": 1, "start": 2, "end": 1, "words": "?"}, {"n": 3, "start": 0, "end": 1, "words": "x"}]))
    got = P.takes(spark, str(tmp_path / "takes.json")).orderBy("n").collect()
    assert [r.problem for r in got] == [None, "start must come before end", "no rating"]
    assert got[0].name == "01 r3 - well that was a very long and" and got[1].name == "02 r1 - take"
    span = {"source": "a", "start": 0, "end": 1}
    plans = {
        "good": {"sample_rate": 100, "sources": {"a": "x.wav"}, "clips": [span, span | {"crossfade": 0.1, "match_level_to": span, "level_sample": span}]},
        "bad": {"sample_rate": 0, "sources": {"a": "x.wav"}, "clips": [span | {"crossfade": 1, "level_sample": span}, {"source": "b", "start": 2, "end": 1}]},
        "empty": {"sample_rate": 1, "sources": {}, "clips": []},
    }
    for name, plan in plans.items():
        (tmp_path / f"{name}.plan").write_text(json.dumps(plan))
    checked = P.plans(spark, str(tmp_path / "*.plan"))
    problems = {r.path.rsplit("/", 1)[1]: r.problems for r in checked.collect()}
    assert problems["good.plan"] == [] and problems["empty.plan"] == ["sources must be a nonempty object", "clips must be a nonempty array"]
    assert problems["bad.plan"] == ["sample_rate must be a positive integer", "clips[0]: crossfade must be nonnegative and zero on the first clip", "clips[0]: level_sample requires match_level_to and must use the clip's source", "clips[1]: source must name a source"]
    assert [(r.seq, r.crossfade) for r in P.plan_clips(checked).orderBy("seq").collect()] == [(1, None), (2, 0.1)]
    (tmp_path / "book.md").write_text("# T\n\nA b.\n")
    assert P.manuscripts(spark, str(tmp_path / "book.md")).first().text == "# T\n\nA b.\n"


def test_wavs_and_clips(spark, tmp_path):
    x = np.sin(np.arange(4000) / 5) * 0.25
    df = spark.createDataFrame([("a", 1000, [float(v) for v in x])], "name string, sr int, samples array<float>")
    out = K.write_wavs(df, f"file://{tmp_path}/out")
    assert out.first().bytes == 4000 * 3 + 44
    with wave.open(str(tmp_path / "out/a.wav")) as f:
        raw = np.frombuffer(f.readframes(4000), np.uint8).reshape(-1, 3).astype(np.int32)
    back = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / 2**23
    assert np.abs(back - x).max() < 1e-6
    with pytest.raises(Exception, match="not overwriting"):
        K.write_wavs(df, f"file://{tmp_path}/out").collect()
    assert (K.depth(["PCM_16"]), K.depth(["PCM_16", "FLOAT"]), K.depth(["FLOAT"], 16), K.depth([], 24)) == (16, 24, 16, 24)
    from chronoweave.sources.recordings import read_wav

    blocks = read_wav(spark, str(tmp_path / "out"), block=512, halo=64)
    path = blocks.first().path
    takes = spark.createDataFrame([(path, "t1", 0.4, 1.7), (path, "t2", 3.0, 9.0)], "path string, name string, start double, end double")
    got = {r.name: np.array(r.samples) for r in K.clips(blocks, takes, 512).collect()}
    assert len(got["t1"]) == 1300 and len(got["t2"]) == 1000
    own = x[400:1700] * 0.1 / np.sqrt((x[400:1700] ** 2).mean())
    assert np.abs(got["t1"][30:-30] - own[30:-30]).max() < 1e-4 and got["t1"][0] == 0


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 61.0, 40.0, 1.5, None), ("a", 30.0, 60.0, 1.0, 120.0)], "name string, minutes double, fire double, order double, pitch double")
    text = K.scorecard_markdown(rows).first().text
    lines = text.split("\n")
    assert lines[2] == "2 finished recordings, 1 h 31 min." and lines[4] == "| Recording | Min | Fire | Order | Pitch Hz |"
    assert lines[6] == "| a | 30.0 | 60 | 1.0 | 120 |" and lines[7] == "| b&#124;c | 61.0 | 40 | 1.5 | - |"
    assert "Fire" not in K.scorecard_markdown(rows.withColumn("fire", F.when(F.col("name") == "a", F.col("fire")))).first().text
    K.scorecard_csv(rows, str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv/*.csv"))[0]) as f:
        assert list(csv.reader(f))[1] == ["a", "30.0", "60.0", "1.0", "120.0"]
    cuts = spark.createDataFrame([("r", 3.0, 1.0, 2.0, "some <words>")], "rec string, raw double, clean double, seconds double, words string")
    pauses = spark.createDataFrame([("r", 9.0, 6.0, None, 0.5)], "rec string, raw double, clean double, was_s double, now_s double")
    total = spark.createDataFrame([("r", 1.0, 0.9, 10, 3, 0, 1, 0), ("q", 1.0, 1.0, 2, 0, 0, 0, 0)], "rec string, raw_minutes double, edited_minutes double, words_heard int, words_cut int, sounds_cut int, cuts int, pauses_changed int")
    report = {r.rec: r.text for r in K.edit_report(cuts, pauses, total).collect()}
    assert "| 0:03.0 | 0:01.0 | 2.00 | some &lt;words&gt; |" in report["r"] and "| 0:09.0 | - | 0.50 |" in report["r"] and "##" not in report["q"].replace("# q", "", 1)
    edl = spark.createDataFrame([("r", 2, 5.0, 6.0, 1.0, 2.0), ("r", 1, 0.0, 1.0, 0.0, 1.0)], "rec string, seq int, raw_in double, raw_out double, clean_in double, clean_out double")
    kept = spark.createDataFrame([("r", 0, "w", 0.0, 0.5, 0.0, 0.5)], "rec string, idx int, text string, at double, end double, raw double, raw_end double")
    saved = {r.rec: json.loads(r.json) for r in K.edit_json(edl, kept, total, 2).collect()}
    assert [e["raw_in"] for e in saved["r"]["edl"]] == [0.0, 5.0] and saved["r"]["summary"]["words_cut"] == 3 and saved["q"]["render_version"] == 2
    (tmp_path / "r.edit.json").write_text(json.dumps(saved["r"]))
    back = P.edit_list(P.edits(spark, str(tmp_path / "r.edit.json"))).orderBy("seq").collect()
    assert [(r.seq, r.clean_out) for r in back] == [(1, 1.0), (2, 2.0)]
    lines = K.lines_of(cuts, F.format_string("%.1f %s", "raw", "words"), "%d cut(s)", ["raw"], ["rec"]).first().text
    assert lines == "3.0 some <words>\n1 cut(s)"


def test_scores(spark):
    words = spark.createDataFrame([("a", w, -0.01 if k % 4 else -1.0) for k, w in enumerate(["the", "two"] * 40)] + [("b", "the", -0.01), ("b", "rare", 0.0)], "rec string, word string, logp double")
    everyday = score.document_frequency(words, "rec", "word", 0.6, leave_out=score.NUMBERS)
    assert [r.word for r in everyday.collect()] == ["the"]
    assert {r.rec: (r.doubted, r.n) for r in score.doubted(words, everyday, least=30).collect()} == {"a": (50.0, 40), "b": (None, 1)}
    tokens = spark.createDataFrame([("a", 0, "▁so", 0.0, -0.1), ("a", 1, "ft", 0.1, -0.2), ("a", 2, ",", 0.9, -0.3), ("a", 3, "▁x", 2.0, -0.4)], "rec string, pos int, token string, start double, logp double")
    got = [(r.text, r.start, round(r.end, 6), round(r.logp, 6)) for r in score.words_of_tokens(tokens).orderBy("word_no").collect()]
    assert got == [("soft,", 0.0, 0.7, -0.6), ("x", 2.0, 2.6, -0.4)]
    m = spark.createDataFrame([(f"r{k}", float(k), 2.0 * k, 1.0, 5.0 - k) for k in range(5)], "path string, lift double, movement double, spread double, brightness double")
    scale, where = score.resolved_scale(m, ["lift", "movement", "spread", "brightness"], None)
    minutes = m.crossJoin(spark.range(4).withColumnRenamed("id", "minute")).withColumn("lift", F.col("lift") + F.col("minute"))
    out = score.with_fire(m, scale, minutes).orderBy("path").collect()
    assert where == "these recordings" and abs(sum(r.fire for r in out) / 5 - 50) < 1e-9 and abs(sum(r.lift for r in out)) < 1e-9
    assert [h["at"] for h in out[0].hottest] == [180.0, 120.0, 60.0]
    file = "p string, rms_db double, true_peak_db double, noise_floor_db double, head_s double, tail_s double, longest_pause_s double, format string, kbps int, sample_rate int, minutes double, channels int"
    files = spark.createDataFrame([("a", -20.0, -3.5, -65.0, 1.0, 2.0, 1.0, "MP3", 192, 44100, 60.0, 1), ("b", -17.0, -1.0, -50.0, 0.0, 2.0, 6.0, "WAV", 700, 48000, 130.0, 2)], file)
    assert {r.p: len(r.x) for r in files.select("p", score.publisher_problems().alias("x")).collect()} == {"a": 0, "b": 7}
    assert score.set_notes(files).first().asDict() == {"total": 190.0, "spread": 3.0, "mixed_channels": True, "length": "in or past 120 to 180 minutes"}
    tones = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [3.0, 5.0])], "path string, tone array<double>")
    assert {r.path: round(r.tone_db, 6) for r in score.tone_distance(tones).collect()} == {"a": 0.0, "b": 0.0, "c": round(12.5**0.5, 6)}


def test_incremental(spark, tmp_path):
    chunks = spark.createDataFrame([(k,) for k in range(5)], "chunk int")
    path, seen = str(tmp_path / "done"), []

    def compute(part):
        seen.append(sorted(r.chunk for r in part.collect()))
        return part.withColumn("text", F.lit("t"))

    assert [I.resume(spark, chunks, path, ["chunk"], compute, most=2) for _ in range(3)] == [False, False, True]
    assert seen == [[0, 1], [2, 3], [4]] and I.results(spark, path, ["chunk"]).count() == 5
    there = spark.createDataFrame([("d/a.txt",), ("d/a.2.txt",), ("d/b.3.txt",)], "path string")
    wanted = spark.createDataFrame([("d/a.txt",), ("d/b.txt",), ("d/c.txt",)], "path string")
    assert {r.path: r.target for r in I.next_version(wanted, there).collect()} == {"d/a.txt": "d/a.3.txt", "d/b.txt": "d/b.txt", "d/c.txt": "d/c.txt"}
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    made = [(n, k, 1, at(9)) for n in "abc" for k in ("wav", "json")] + [("d", "wav", 1, at(9)), ("d", "json", 0, at(9))]
    outputs = spark.createDataFrame(made, "name string, kind string, length long, modificationTime timestamp")
    inputs = spark.createDataFrame([("a", at(5)), ("b", at(9)), ("c", at(1)), ("d", at(1)), ("e", at(1))], "name string, modificationTime timestamp")
    versions = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 2)], "name string, render_version int")
    fresh = I.up_to_date(outputs, inputs, versions, ["wav", "json"], 2)
    assert {r.name: r.fresh for r in fresh.collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    names = lambda s: spark.createDataFrame([(c,) for c in s], "name string")
    states = {r.name: r.state for r in I.batch_state(names("abe"), names("ab"), names("a"), fresh).collect()}
    assert states == {"a": "up to date", "b": "waiting", "e": "transcribe"}
    paths = lambda *p: spark.createDataFrame([("n", x) for x in p], "name string, path string")
    assert [r.path for r in I.overwrites(paths("/x/./a.wav", "/x/b.wav"), paths("/x/a.wav")).collect()] == ["/x/a.wav"]
