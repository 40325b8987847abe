"""Alignment of two token sequences by recursive longest matching blocks, and what is read off it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """The steps that are not equal; no token counts as junk."""
    return [x for x in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]


_INT = T.IntegerType()
_OPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(c, _INT) for c in ("a0", "a1", "b0", "b1"))]))


@F.pandas_udf(_OPS)
def opcodes_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    names = ("tag", "a0", "a1", "b0", "b1")
    return pd.Series([[dict(zip(names, x)) for x in opcodes(list(p), list(q))] if p is not None and q is not None else None for p, q in zip(a, b)])


def differences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each difference of the token arrays a and b: tag, place, the tokens of both sides, three tokens before and
    after, and spelling (whether both sides have the same letters)."""
    out = pairs.withColumn("_op", F.explode(opcodes_udf(F.col(a), F.col(b))))
    own = F.slice(F.col(a), F.col("_op.a0") + 1, F.col("_op.a1") - F.col("_op.a0"))
    other = F.slice(F.col(b), F.col("_op.b0") + 1, F.col("_op.b1") - F.col("_op.b0"))
    low = F.greatest(F.lit(1), F.col("_op.a0") - 2)
    return out.select(
        *(c for c in pairs.columns if c not in (a, b)),
        F.col("_op.tag").alias("tag"),
        F.col("_op.a0").alias("at"),
        F.array_join(own, " ").alias("ours"),
        F.array_join(other, " ").alias("theirs"),
        F.array_join(F.slice(F.col(a), low, F.col("_op.a0") + 1 - low), " ").alias("before"),
        F.array_join(F.slice(F.col(a), F.col("_op.a1") + 1, 3), " ").alias("after"),
        (F.array_join(own, "") == F.array_join(other, "")).alias("spelling"),
    )


def lost(a: list[str], b: list[str], ahead: int = 80, behind: int = 3) -> list[tuple[int, list[str]]]:
    """Stretches of a that b has not, of which at least a third (one at least) do not come again in b from `behind` before to `ahead` after."""
    out = []
    for tag, a0, a1, b0, _ in opcodes(a, b):
        if tag in ("delete", "replace"):
            window = set(b[max(0, b0 - behind) : b0 + ahead])
            missing = [t for t in a[a0:a1] if t not in window]
            if missing and len(missing) >= max(1, (a1 - a0) // 3):
                out.append((a0, missing))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", _INT), T.StructField("missing", T.ArrayType(T.StringType()))])))
def lost_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"at": k, "missing": m} for k, m in lost(list(p), list(q))] if p is not None and q is not None else None for p, q in zip(a, b)])


def not_retained(removed: DataFrame, kept: DataFrame, word: str) -> DataFrame:
    """Rows of removed whose word stands nowhere in kept; repeated rows stay."""
    return removed.join(kept.select(word).distinct(), word, "left_anti")
