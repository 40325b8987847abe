"""Sinks: WAV files, cut clips, Markdown and CSV reports. Files are written by the tasks that hold the rows; none is overwritten."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import cell, clock


def depth(kinds: list[str], bits: int = 0) -> int:
    """Bits of a master: those asked for, 16 or 24, else 24 where a source is deeper than 16."""
    return (16 if bits <= 16 else 24) if bits else 24 if {"PCM_24", "PCM_32", "FLOAT", "DOUBLE"} & set(kinds) else 16


def encode_wav(x: np.ndarray, sr: int, bits: int = 24, seed: int = 0) -> bytes:
    """A mono WAV file; 16 bits get triangular dither one step wide."""
    x = np.asarray(x, np.float64)
    if bits == 16:
        draw = np.random.default_rng(seed)
        x = x + (draw.random(len(x)) - draw.random(len(x))) / 32768
    scale = 1 << bits - 1
    whole = np.clip(np.rint(np.clip(x, -1, 1) * scale), -scale, scale - 1).astype("<i4")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(bits // 8)
        f.setframerate(sr)
        f.writeframes(whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    return out.getvalue()


def _write(folder: str, name: str, data: bytes) -> str:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    path = f"{base}/{name}"
    if system.get_file_info(path).type != fs.FileType.NotFound:
        raise FileExistsError(f"exists, not overwriting: {path}")
    partial = f"{path}.part"
    with system.open_output_stream(partial, compression=None) as f:
        f.write(data)
    system.move(partial, path)
    return path


def write_wavs(recordings: DataFrame, folder: str, *, bits: int = 24) -> DataFrame:
    """Files of recordings (name, sr, samples) in a folder (a URI that all tasks reach): (name, path, bytes), evaluated when an action runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sr, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = encode_wav(x.values.to_numpy(zero_copy_only=False), sr, bits)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_write(folder, f"{name}.wav", data)]), pa.array([len(data)])], ["name", "path", "bytes"])

    return recordings.select("name", "sr", "samples").mapInArrow(run, "name string, path string, bytes long")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def levelled(samples: pd.Series, sr: pd.Series) -> pd.Series:
    """A clip at -20 dB RMS, its peak at -1 dB at most, with 30 ms fades."""
    out = []
    for x, rate in zip(samples, sr):
        y = np.asarray(x, float)
        y = y * 10 ** (-20 / 20) / np.sqrt((y**2).mean() + 1e-12) if len(y) else y
        top = np.abs(y).max(initial=0.0)
        y = y * min(1.0, 10 ** (-1 / 20) / top) if top else y
        n = min(int(0.03 * rate), len(y) // 2)
        ramp = np.ones(len(y))
        if n:
            ramp[:n], ramp[-n:] = np.linspace(0, 1, n), np.linspace(1, 0, n)
        out.append((y * ramp).astype(np.float32))
    return pd.Series(out)


def clips(blocks: DataFrame, takes: DataFrame, size: int, rec: str = "path") -> DataFrame:
    """(rec, name, sr, samples) of the takes (rec, name, start, end) of recordings in blocks, levelled. Only blocks that a take touches are joined, by number."""
    spans = takes.join(blocks.select(rec, "sr").distinct(), rec).withColumns({"_a": F.floor(F.col("start") * F.col("sr")), "_b": F.floor(F.col("end") * F.col("sr"))})
    touched = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / size).cast("int"), F.floor((F.col("_b") - 1) / size).cast("int")))).drop("sr")
    own = F.slice("samples", F.col("lead") + 1, F.lit(size))
    begin = F.greatest(F.col("_a") - F.col("start_sample"), F.lit(0)).cast("int")
    part = F.slice("_own", begin + 1, F.greatest(F.col("_b") - F.col("start_sample") - begin, F.lit(0)).cast("int"))
    joined = blocks.withColumn("_own", own).join(touched, [rec, "block"]).withColumn("_part", part)
    whole = joined.groupBy(rec, "name", "sr").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "_part"))), lambda x: x["_part"])).alias("samples"))
    return whole.withColumn("samples", levelled("samples", "sr"))


# -- reports ---------------------------------------------------------------------------------------------------------


def markdown_table(df: DataFrame, columns: dict[str, Column], order: list[Column], group: list[str] | None = None, name: str = "text") -> DataFrame:
    """A Markdown table of each group's rows as one text: a heading for each column, cells escaped, null as -."""
    group = group or []
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(cell(c.cast("string")), F.lit("-")) for c in columns.values())), F.lit(" |"))
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)  # a report is for people: its rows are few
    lines = df.select(*group, cells.alias("_line"), F.row_number().over(w).alias("_n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
    return lines.groupBy(*group).agg(F.concat(F.lit(head + "\n"), rows, F.lit("\n")).alias(name))


def _minutes(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("int"))


_FIRE = {"Fire": ("fire", 0, 1), "Lift st": ("lift", 1, 2), "Movement st/s": ("movement", 1, 2), "Range st": ("spread", 1, 2), "Brightness Hz": ("brightness", 0, 1)}
_CLEAR = {"Composure": ("clarity", 0, 1), "Enunciation /100": ("enunciation", 1, 2), "Landing st": ("landing", 1, 2), "Reset st": ("reset", 1, 2)}
_PLAIN = {"Order": ("order", 1, 1), "Clicks/min": ("clicks", 1, 2), "Noise floor dB": ("noise_floor", 1, 1), "Tone dB": ("tone", 1, 2), "Pitch Hz": ("pitch", 0, 1), "Words/min": ("pace", 0, 1)}
_HEARD = {"Listener": ("pesq", 2, 3), "Lowest tenth": ("pesq_low", 2, 3)}


def scorecard(rows: DataFrame) -> tuple[dict[str, tuple[Column, int]], list[Column]]:
    """The columns of a scorecard, each with its digits after the point for the table, and the order of its rows: a group of columns is there if every
    row has it, the date if any has; best fire first where there is fire, else least order."""
    all_have = lambda c: F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(False)) if c in rows.columns else F.lit(False)
    has = rows.agg(all_have("fire").alias("fire"), all_have("clarity").alias("clear"), all_have("pesq").alias("heard"), (F.coalesce(F.bool_or(F.col("recorded") != ""), F.lit(False)) if "recorded" in rows.columns else F.lit(False)).alias("dated")).first()
    groups = [(_FIRE, has["fire"]), (_CLEAR, has["clear"]), (_PLAIN, True), (_HEARD, has["heard"])]
    columns: dict[str, tuple[Column, int]] = {"Recording": (F.col("name"), -1)}
    columns |= {"Recorded": (F.col("recorded"), -1)} if has["dated"] else {}
    columns |= {"Min": (F.col("minutes"), 1)}
    for group, there in groups:
        columns |= {k: (F.col(c), digits) for k, (c, digits, _) in group.items() if there and c in rows.columns}
        if group is _FIRE and there and "hottest" in rows.columns:
            columns["Hottest minutes"] = (F.array_join(F.transform("hottest", lambda h: F.concat(_minutes(h["at"]), F.format_string(" (%.0f)", h["fire"]))), ", "), -1)
    return columns, [F.desc("fire") if has["fire"] else F.asc("order"), F.asc("name")]


def scorecard_markdown(rows: DataFrame) -> DataFrame:
    """One row: the scorecard as Markdown, with its heading and totals."""
    columns, order = scorecard(rows)
    shown = {k: F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{d}f", c)) if d >= 0 else c for k, (c, d) in columns.items()}
    table = markdown_table(rows, shown, order)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("m"))
    head = F.format_string("# Recording scorecard\n\n%d finished recordings, %d h %.0f min.\n\n", "n", F.floor(F.col("m") / 60), F.pmod("m", F.lit(60.0)))
    return total.join(table, how="left").select(F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))  # one row each


def scorecard_csv(rows: DataFrame, path: str) -> None:
    """The same table as CSV with a header, numbers with one digit more."""
    columns, order = scorecard(rows)
    rows.orderBy(*order).select(*((F.round(c, d + 1) if d >= 0 else c).alias(k) for k, (c, d) in columns.items())).coalesce(1).write.csv(path, header=True)


def edit_report(cuts: DataFrame, pauses: DataFrame, summary: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, text): the Markdown report of a cut: its counts, what was cut and which pauses changed."""
    seconds = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))
    cut = markdown_table(cuts, {"recording": clock(F.col("raw")), "result": clock(F.col("clean")), "seconds": seconds("seconds"), "words": F.col("words")}, [F.asc("raw")], [rec], "_cuts")
    changed = markdown_table(pauses, {"recording": clock(F.col("raw")), "was": seconds("was_s"), "now": seconds("now_s")}, [F.asc("raw")], [rec], "_pauses")
    counts = F.format_string("%d cut(s): %d of %d words and %d sound(s) out, %d pause(s) changed. %.2f min recorded, %.2f left.", "cuts", "words_cut", "words_heard", "sounds_cut", "pauses_changed", "raw_minutes", "edited_minutes")
    section = lambda title, c: F.coalesce(F.concat(F.lit(f"\n## {title}\n\n"), F.col(c)), F.lit(""))
    out = summary.join(cut, rec, "left").join(changed, rec, "left")
    return out.select(rec, F.concat(F.lit("# "), F.col(rec).cast("string"), F.lit("\n\n"), counts, F.lit("\n"), section("Cut", "_cuts"), section("Pauses", "_pauses")).alias("text"))


def edit_json(edl: DataFrame, kept: DataFrame, summary: DataFrame, version: int, rec: str = "rec") -> DataFrame:
    """(rec, json): what a cut's other tools read, as projects.edits reads it."""
    rows = lambda df, by, columns: df.groupBy(rec).agg(F.transform(F.array_sort(F.collect_list(F.struct(by, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("v"))
    spans = rows(edl, "seq", ["raw_in", "raw_out", "clean_in", "clean_out"]).withColumnRenamed("v", "edl")
    words = rows(kept, "idx", ["text", "at", "end", "raw", "raw_end"]).withColumnRenamed("v", "kept")
    numbers = F.map_from_arrays(F.array(*(F.lit(c) for c in summary.columns if c != rec)), F.array(*(F.col(c).cast("double") for c in summary.columns if c != rec)))
    return summary.select(rec, numbers.alias("summary")).join(spans, rec, "left").join(words, rec, "left").select(rec, F.to_json(F.struct(F.lit(version).alias("render_version"), "summary", "edl", "kept")).alias("json"))


def lines_of(rows: DataFrame, line: Column, footer: str, order: list[str], group: list[str]) -> DataFrame:
    """(group, text): a line for each row in order, and a footer with the number of rows in place of %d."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return rows.groupBy(*group).agg(F.concat(listed, F.lit("\n"), F.format_string(footer, F.count("*"))).alias("text"))
