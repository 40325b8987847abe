"""Recordings and transcripts: WAV files as overlapping blocks of samples, transcripts as words, a cache read through."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "file string, duration double, segments array<array<double>>, words array<struct<text string, start double, end double>>"
_SCALE = {1: 128.0, 2: 32768.0, 3: 8388608.0, 4: 2147483648.0}


def pcm(data: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in -1 to 1 of little-endian PCM frames, channels averaged."""
    if width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float64)
    elif width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.float64) - 128
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float64)
    return (x / _SCALE[width]).reshape(-1, channels).mean(axis=1).astype(np.float32)


def read_wav(spark: SparkSession, path: str, *, block: int = 1 << 18, halo: int = 0, glob: str = "*.wav") -> DataFrame:
    """(path, sr, block, start_sample, lead, samples): a row for each `block` samples, with up to `halo` samples around them;
    lead is how many of the halo stand before the block. A file without samples gives no rows; its values are decoded block by block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "path string, sr int, block int, start_sample long, lead int, samples array<float>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with wave.open(io.BytesIO(content.as_py())) as f:
                    n = f.getnframes()
                    for k, at in enumerate(range(0, n, block)):
                        lo = max(0, at - halo)
                        f.setpos(lo)
                        x = pcm(f.readframes(min(n, at + block + halo) - lo), f.getsampwidth(), f.getnchannels())
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.getframerate()], pa.int32()), pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([at - lo], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names)

    return files.mapInArrow(run, schema)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(file, duration, pos, text, start, end) of JSON transcripts; one without words gives no rows."""
    docs = spark.read.schema(TRANSCRIPT).json(path, multiLine=True)
    return docs.select("file", "duration", F.posexplode("words").alias("pos", "w")).select("file", "duration", "pos", "w.*")


def write_transcripts(words: DataFrame, path: str, *, file: str = "file") -> None:
    """Words (file, duration, pos, text, start, end) as one JSON line for each file."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))))
    docs = words.groupBy(F.col(file).alias("file")).agg(F.max("duration").alias("duration"), rows.alias("w"))
    docs.select("file", "duration", F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("words")).write.json(path)


def read_through(wanted: DataFrame, cached: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cached rows of the wanted keys, and what compute gives for the others."""
    hits = cached.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return hits.unionByName(compute(wanted.join(cached.select(*keys).distinct(), keys, "left_anti")))
