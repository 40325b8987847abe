"""What the training-data operators share: table paths, the shared folder, and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Only where no checkpoint folder is set at all (local tests) is a temporary one made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='chronoweave-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files of the write are removed once it has ended."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes materialised tables that nothing reads any more."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def word_list(text: Column) -> Column:
    """Lower-case words of a text, split at runs of blanks, tabs, line ends and form feeds; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f]+"), lambda w: w != "")


def has_words(text: Column) -> Column:
    """Whether a text has a word of word_list; a null text has none."""
    return F.coalesce(text.rlike(r"[^ \t\n\r\f]"), F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 arrays; overflow wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
