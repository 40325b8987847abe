"""Joins of points and intervals on a line, and greedy merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """points joined to the intervals [start, end] that hold them, by equal keys and blocks of `width`: an equi-join, not
    a join by inequality. how: inner, left_semi or left_anti. Choose width near the usual length of an interval."""
    i = intervals.withColumnsRenamed({k: f"_i_{k}" for k in keys}).withColumn("_i_block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_block", F.floor(F.col(at) / width))
    match = (p["_block"] == i["_i_block"]) & (p[at] >= i[start]) & (p[at] <= i[end])
    for k in keys:
        match = match & (F.col(k) == F.col(f"_i_{k}"))
    return p.join(i, match, how).drop("_block", "_i_block", *(f"_i_{k}" for k in keys))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows (keys, a_start, a_end, ...) and (keys, b_start, b_end, ...) whose intervals overlap; each pair once,
    in the block where the later one starts."""
    x = a.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a_start") / width), F.floor(F.col("a_end") / width))))
    y = b.withColumn("_block", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor(F.col("b_end") / width))))
    joined = x.join(y, [*keys, "_block"])
    hit = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    return joined.where(hit & (F.col("_block") == F.floor(F.greatest("a_start", "b_start") / width))).drop("_block")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str) -> DataFrame:
    """left with the distance to the nearest right row of its keys (null if none): one sort of both sides, two running values."""
    both = left.select("*", F.lit(None).cast("double").alias("_r")).unionByName(
        right.select(*keys, F.col(right_at).alias(at), F.col(right_at).cast("double").alias("_r")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at)
    before = F.last("_r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    # backwards as a running value too: a frame that ends with the partition is made anew for every row
    after = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_b", before).withColumn("_a", after).where("_r is null")
    return out.withColumn("distance", F.least(F.col(at) - F.col("_b"), F.col("_a") - F.col(at))).drop("_r", "_a", "_b")


def sessions(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Intervals merged where less than `gap` lies between them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) - reach < gap, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_s").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_s")


def bounded_merge(df: DataFrame, keys: list[str], start: str, end: str, gap: float, longest: float) -> DataFrame:
    """Greedy merge in order: an interval joins the open one if less than `gap` lies between and the open one is still
    shorter than `longest`.

    Where `gap` or more lies after an interval a stretch ends whatever was merged, so only each stretch is folded, with the
    open interval and those closed before it as the state."""
    w = Window.partitionBy(*keys).orderBy("a", "b")
    ordered = df.select(*keys, F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b"))
    cut = F.coalesce((F.col("a") - F.lag("b").over(w) >= gap).cast("int"), F.lit(1))
    parts = ordered.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(w)).groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_x"))
    state = F.struct(F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.expr("cast(array() as array<struct<a: double, b: double>>)").alias("done"))

    def step(s: Column, x: Column) -> Column:
        joins = F.coalesce((x["a"] - s["b"] < gap) & (s["b"] - s["a"] < longest), F.lit(False))
        closed = F.when(s["a"].isNull() | joins, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
        return F.struct(F.when(joins, s["a"]).otherwise(x["a"]).alias("a"), x["b"].alias("b"), closed.alias("done"))

    merged = F.aggregate("_x", state, step, lambda s: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
    return parts.select(*keys, F.explode(merged).alias("m")).select(*keys, F.col("m.a").alias("start"), F.col("m.b").alias("end"))
