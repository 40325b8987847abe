"""What makes a batch of recordings resumable: what is still to do, versions that are never overwritten, what is up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def measure(words: DataFrame, sounds: DataFrame, order: str = "start") -> DataFrame:
    """Recognised words and stray sounds as one ordered list: their union with pos, by start."""
    both = words.select("rec", "text", "start", "end").unionByName(sounds.select("rec", "text", "start", "end"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("rec").orderBy(order, "end")) - 1)


def remaining(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks that have no result yet."""
    return chunks.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(spark: SparkSession, chunks: DataFrame, path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame], *, most: int | None = None) -> bool:
    """Computes chunks that the table at path lacks, `most` at a time, and appends them; whether all are there. An interrupted run
    loses only what was not written, and a chunk appended twice counts once in results()."""
    done = _results(spark, path)
    todo = chunks if done is None else remaining(chunks, done, keys)
    part = todo.orderBy(*keys).limit(most) if most else todo
    compute(part).write.mode("append").parquet(path)
    return remaining(chunks, _results(spark, path), keys).isEmpty()


def _results(spark: SparkSession, path: str) -> DataFrame | None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.parquet(path) if system.exists(there) else None


def results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The appended results, each chunk's once."""
    return spark.read.parquet(path).dropDuplicates(keys)


def next_version(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """wanted (path) with target: the path itself where none of there (path) has it, else the first free of .2, .3, ... before its suffix."""
    parts = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 2)
    numbered = there.select(F.regexp_extract("path", r"^(.*?)(?:\.(\d+))?(\.[^./]*)?$", 1).alias("_stem"), F.regexp_extract("path", r"^(.*?)(?:\.(\d+))?(\.[^./]*)?$", 3).alias("_suffix"), F.regexp_extract("path", r"^(.*?)(?:\.(\d+))?(\.[^./]*)?$", 2).alias("_v"))
    taken = numbered.groupBy("_stem", "_suffix").agg(F.collect_set(F.when(F.col("_v") == "", 1).otherwise(F.try_to_number("_v", F.lit("999999999")).cast("int"))).alias("_taken"))
    out = wanted.withColumns({"_stem": parts[0], "_suffix": parts[1]}).join(taken, ["_stem", "_suffix"], "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(F.coalesce("_taken", F.array().cast("array<int>"))) + 1), F.coalesce("_taken", F.array().cast("array<int>"))))
    return out.select("path", F.when(free == 1, F.col("path")).otherwise(F.concat("_stem", F.lit("."), free.cast("string"), "_suffix")).alias("target"))


def newest(files: DataFrame, key: Column) -> DataFrame:
    """(key, path) of the file (path, modificationTime) of each key that was written last."""
    return files.groupBy(key.alias("key")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def up_to_date(outputs: DataFrame, inputs: DataFrame, versions: DataFrame, expected: list[str], version: int) -> DataFrame:
    """(name, fresh): all expected outputs (name, kind, length, modificationTime) are there and not empty, the saved edit
    (name, render_version) is of this version, and the oldest output is newer than the newest input (name, modificationTime)."""
    made = outputs.where(F.col("kind").isin(expected) & (F.col("length") > 0)).groupBy("name").agg(F.count_distinct("kind").alias("kinds"), F.min("modificationTime").alias("oldest"))
    given = inputs.groupBy("name").agg(F.max("modificationTime").alias("newest"))
    rows = given.join(made, "name", "left").join(versions.select("name", "render_version"), "name", "left")
    fresh = (F.col("kinds") == len(set(expected))) & (F.col("render_version") == version) & (F.col("oldest") > F.col("newest"))
    return rows.select("name", F.coalesce(fresh, F.lit(False)).alias("fresh"))


def overwrites(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(name, path) of the outputs (name, path) that are inputs too; nothing may run while there are any."""
    clean = lambda df: df.withColumn("path", F.regexp_replace("path", r"/(?:\./|(?=/))", "/"))
    return clean(outputs).join(clean(inputs).select("path").distinct(), "path", "left_semi").select("name", "path")


def batch_state(entries: DataFrame, transcripts: DataFrame, markups: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name, state) of a batch's entries: transcribe (no transcript yet), waiting (a transcript, no mark-up), cut (a mark-up, results missing or
    older), up to date."""
    flag = lambda df, c: df.select("name").distinct().withColumn(c, F.lit(True))
    rows = entries.select("name").join(flag(transcripts, "_t"), "name", "left").join(flag(markups, "_m"), "name", "left").join(fresh, "name", "left")
    state = F.when(F.coalesce("fresh", F.lit(False)) & F.col("_m").isNotNull(), "up to date").when(F.col("_m").isNotNull(), "cut").when(F.col("_t").isNotNull(), "waiting").otherwise("transcribe")
    return rows.select("name", state.alias("state"))
