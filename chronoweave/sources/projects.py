"""Projects, settings, manuscripts, assembly plans, lists of takes, saved edits and scales.

Small files that a person writes are read on the driver and checked strictly; what grows with the recordings is read as tables with
explicit schemas, and what is wrong with a row is a column of it."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAKES = "path string, n int, rating int, profanity boolean, start double, end double, words string"
EDIT = "render_version int, summary map<string, double>, edl array<struct<raw_in double, raw_out double, clean_in double, clean_out double>>, kept array<struct<text string, at double, end double, raw double, raw_end double>>"
_SPAN = "struct<source string, start double, end double>"
PLAN = f"sample_rate int, sources map<string, string>, clips array<struct<source string, start double, end double, crossfade double, gain_db double, match_level_to {_SPAN}, level_sample {_SPAN}, note string>>, _corrupt string"


@dataclass
class Mastering:
    rms_db: float = -20.0
    limiter_ceiling_db: float = -3.5
    highpass_hz: float = 70.0
    mic_filter_hz: float = 0.0
    compressor_threshold_db: float = -26.0
    compressor_ratio: float = 2.0
    noise_reduction: str = "auto"
    noise_reduction_db: float = 12.0
    noise_sensitivity: float = 6.0
    noise_smoothing: int = 3
    denoise_above_db: float = -62.0
    mouth_clicks: bool = True
    wav_bits: int = 0
    mp3_kbps: int = 192
    mp3_sample_rate: int = 44100


@dataclass
class Settings:
    master: Mastering = field(default_factory=Mastering)
    head: float = 1.5
    tail: float = 3.0
    threads: int = 0


def settings(text: str = "") -> Settings:
    """Settings of a TOML text over the defaults; an unknown one under [master] is an error, others are ignored."""
    given = tomllib.loads(text)
    own = given.get("master") or {}
    if unknown := set(own) - {f.name for f in fields(Mastering)}:
        raise ValueError(f"unknown setting [master] {', '.join(sorted(unknown))}")
    reduction = own.get("noise_reduction", "auto")
    reduction = {True: "on", False: "off"}.get(reduction, reduction)
    if reduction not in ("auto", "on", "off"):
        raise ValueError('[master] noise_reduction must be "auto", "on", or "off"')
    return Settings(Mastering(**own | {"noise_reduction": reduction}), **{k: given[k] for k in ("head", "tail", "threads") if k in given})


def workers(asked: int = 0, cores: int | None = None) -> int:
    """The threads asked for, else all cores but one, eight at most."""
    cores = cores or os.cpu_count() or 2
    return asked if asked > 0 else max(1, min(8, cores - (cores > 2)))


CHAPTER = "n int, name string, title string, recorded string, heading string, audio array<string>, script string, from string, to string, lines string, written string, written_from string, written_to string, out string, said string, transcripts string, speaker string"


def chapters(spark: SparkSession, text: str, base: str = ".", only: str | None = None) -> DataFrame:
    """A row for each chapter of a project's TOML whose name holds `only`; paths are under base. A chapter with a section but no script has the project's."""
    project, rows = tomllib.loads(text), []
    under = lambda p: str(PurePosixPath(base) / p) if p else None
    for n, c in enumerate(project.get("chapter", []), 1):
        name = c.get("name") or f"chapter-{n:02d}"
        audio = c.get("audio", [])
        script = c.get("script") or (project.get("script") if any(c.get(k) for k in ("from", "to", "lines")) else None)
        rows.append((n, name, c.get("title") or name, c.get("recorded", ""), c.get("heading"), [audio] if isinstance(audio, str) else audio, under(script), *(c.get(k) for k in ("from", "to", "lines")), under(c.get("written")), c.get("written_from"), c.get("written_to"), *(under(project.get(k, d)) for k, d in (("out", "edited"), ("said", "said"), ("transcripts", "transcripts"))), project.get("speaker")))
    return spark.createDataFrame([r for r in rows if not only or only in r[1]], CHAPTER)


def with_finished(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries with finished (the MP3, else the WAV, of files (path, length) in their out folder) and problem (no reference text, or no finished file)."""
    there = files.where("length > 0").select("path")
    at = lambda kind: F.concat("out", F.lit("/"), "name", F.lit(f".{kind}"))
    out = entries.join(there.withColumnRenamed("path", "_mp3"), at("mp3") == F.col("_mp3"), "left").join(there.withColumnRenamed("path", "_wav"), at("wav") == F.col("_wav"), "left")
    problem = F.when(F.col("script").isNull(), "needs a reference text").when(F.coalesce("_mp3", "_wav").isNull(), F.concat(F.lit("no finished file in "), "out"))
    return out.withColumn("finished", F.coalesce("_mp3", "_wav")).withColumn("problem", problem).drop("_mp3", "_wav")


def one_recording(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(n, name, path, problem): the one file of files (path) that an entry's patterns name; a pattern's * and ? stand for characters of a name."""
    pattern = lambda p: F.concat(F.lit("(^|.*/)"), F.replace(F.replace(F.regexp_replace(p, r"[.+^${}()|\[\]\\]", r"\\$0"), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    each = entries.select("n", "name", F.explode_outer("audio").alias("_p")).withColumn("_p", pattern(F.col("_p")))
    hits = each.join(F.broadcast(files.select("path")), F.expr("path rlike _p"), "left").groupBy("n", "name").agg(F.collect_set("path").alias("hits"))  # the files of one project
    return hits.select("n", "name", F.when(F.size("hits") == 1, F.col("hits")[0]).alias("path"), F.when(F.size("hits") != 1, F.format_string("audio must name one recording; it matches %d", F.size("hits"))).alias("problem"))


def manuscripts(spark: SparkSession, path: str | Iterable[str]) -> DataFrame:
    """(path, text) of Markdown and text files, whole; see functions.documents for blocks, sections and line ranges."""
    return spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def takes(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, rating, profanity, start, end, words, problem, name) of JSON lists of takes; name is that of the clip to be written."""
    rows = spark.read.schema(TAKES).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("rating", "start", "end", "words"))))
    problem = F.when(F.size(lacking) > 0, F.concat(F.lit("no "), F.array_join(lacking, ", "))).when(~((F.col("start") >= 0) & (F.col("start") < F.col("end"))), "start must come before end")
    words = F.filter(F.split(F.regexp_replace(F.lower("words"), "[^a-z0-9' ]", " "), " +"), lambda w: w != "")
    first = F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 7), " "), F.lit("")), F.lit("take"))
    return rows.withColumn("problem", problem).withColumn("name", F.format_string("%02d r%d - %s", "n", "rating", first))


def edits(spark: SparkSession, path: str) -> DataFrame:
    """(path, render_version, summary, edl, kept) of saved edits; a file that cannot be read has nulls."""
    return spark.read.schema(EDIT).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def edit_list(saved: DataFrame) -> DataFrame:
    """(path, seq from 1, raw_in, raw_out, clean_in, clean_out)"""
    return saved.select("path", F.posexplode("edl").alias("seq", "e")).select("path", (F.col("seq") + 1).alias("seq"), "e.*")


def plans(spark: SparkSession, path: str) -> DataFrame:
    """Assembly plans with problems: an array of what is wrong with each, empty where nothing is."""
    rows = spark.read.schema(PLAN).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("path", F.input_file_name())

    def span(s: Column, where: Column, name: str) -> Column:
        wrong = F.when(s["source"].isNull() | ~F.coalesce(F.map_contains_key("sources", F.coalesce(s["source"], F.lit(""))), F.lit(False)), "source must name a source").when(~F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]), F.lit(False)), "requires 0 <= start < end")
        return F.when(wrong.isNotNull(), F.concat(where, F.lit(f"{name}: "), wrong))

    def clip(c: Column, i: Column) -> Column:
        where = F.format_string("clips[%d]", i)
        fade = F.coalesce(c["crossfade"], F.lit(0.0))
        sample = c["level_sample"].isNotNull() & (c["match_level_to"].isNull() | (c["level_sample"]["source"] != c["source"]))
        return F.array_compact(F.array(
            span(c, where, ""),
            F.when((fade < 0) | ((i == 0) & (fade != 0)), F.concat(where, F.lit(": crossfade must be nonnegative and zero on the first clip"))),
            F.when(c["match_level_to"].isNotNull(), span(c["match_level_to"], where, ".match_level_to")),
            F.when(c["level_sample"].isNotNull(), span(c["level_sample"], where, ".level_sample")),
            F.when(sample, F.concat(where, F.lit(": level_sample requires match_level_to and must use the clip's source"))),
        ))

    general = F.array_compact(F.array(
        F.when(F.col("_corrupt").isNotNull(), F.lit("cannot read the plan")),
        F.when(~F.coalesce(F.col("sample_rate") > 0, F.lit(False)), F.lit("sample_rate must be a positive integer")),
        F.when(F.coalesce(F.cardinality("sources"), F.lit(0)) <= 0, F.lit("sources must be a nonempty object")),
        F.when(F.coalesce(F.cardinality("clips"), F.lit(0)) <= 0, F.lit("clips must be a nonempty array")),
    ))
    own = F.flatten(F.transform(F.coalesce("clips", F.array().cast(rows.schema["clips"].dataType)), clip))
    return rows.withColumn("problems", F.concat(general, own)).drop("_corrupt")


def plan_clips(checked: DataFrame) -> DataFrame:
    """(path, sample_rate, seq from 1, source, start, end, crossfade, gain_db, match_level_to, level_sample, note) of the plans without problems."""
    return checked.where(F.size("problems") == 0).select("path", "sample_rate", F.posexplode("clips").alias("seq", "c")).select("path", "sample_rate", (F.col("seq") + 1).alias("seq"), "c.*")


def save_scale(scale: DataFrame, path: str) -> None:
    """A reference scale (one row) as JSON; fails where one is there."""
    scale.coalesce(1).write.mode("errorifexists").json(path)


def load_scale(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """A saved scale with the columns of these parts; one that it lacks is null, so it does not count in scores."""
    names = [f"{s}_{p}" for p in parts for s in ("mean", "sd")] + ["raw_mean", "raw_sd"]
    return spark.read.schema(", ".join(f"{c} double" for c in names)).json(path)
