"""Frames, runs and windows over ordered rows. Each helper costs one shuffle by its partition keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, partition: list[str], order: list[str], flag: Column, name: str = "island") -> DataFrame:
    """The rows where flag holds, numbered by maximal runs within a partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_all", F.row_number().over(w))
    return marked.where("_f").withColumn(name, F.col("_all") - F.row_number().over(w)).drop("_f", "_all")


def runs(df: DataFrame, partition: list[str], order: str, flag: Column, tie: str | None = None) -> DataFrame:
    """Partition keys, first and last value of order, and n rows of each maximal run of flag."""
    keys = [order] + ([tie] if tie else [])
    return islands(df, partition, keys, flag).groupBy(*partition, "island").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("n")).drop("island")


def median_of_three(value: str, partition: list[str], order: list[str]) -> Column:
    """Median of a row and its neighbours; what is missing at the ends counts as zero."""
    w = Window.partitionBy(*partition).orderBy(*order)
    a, b, c = F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.col(value), F.coalesce(F.lead(value).over(w), F.lit(0.0))
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def framed_median(value: str, partition: list[str], order: list[str], reach: int) -> Column:
    """Median of the values within `reach` rows on each side, the ends repeated."""
    w, back = Window.partitionBy(*partition).orderBy(*order), Window.partitionBy(*partition).orderBy(*(F.desc(c) for c in order))
    # the first and last values are running ones, each in its own direction: a frame that ends with the partition is made anew for every row
    taps = [F.coalesce(F.lag(value, k).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))) for k in range(reach, 0, -1)]
    taps += [F.col(value)] + [F.coalesce(F.lead(value, k).over(w), F.first(value).over(back.rowsBetween(Window.unboundedPreceding, 0))) for k in range(1, reach + 1)]
    return F.element_at(F.array_sort(F.array(*taps)), reach + 1)


def kth_largest(value: str, partition: list[str], order: list[str], reach: int, k: int) -> Column:
    """k-th largest of the values within `reach` rows on each side."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-reach, reach)
    return F.element_at(F.sort_array(F.collect_list(value).over(w), asc=False), k)


def moving_sum(value: str, partition: list[str], order: list[str], reach: int) -> Column:
    """Sum of the values within `reach` rows on each side, fewer at the ends."""
    return F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-reach, reach))


def places(df: DataFrame, key: Column, tie: list[str], name: str = "place", buckets: int = 256) -> DataFrame:
    """df with its place from 1 in the order of a key, ties by `tie`, without a window over all rows: a bounded sample of keys cuts the
    order into buckets, rows are numbered within them, and the counts of the buckets before are added."""
    keyed = df.withColumn("_key", key)
    sample = keyed.select("_key").where("_key is not null").distinct().orderBy(F.xxhash64("_key"), "_key").limit(buckets - 1)
    bounds = sorted(r["_key"] for r in sample.collect())  # at most buckets - 1 rows
    above = sum((F.when(F.col("_key") >= F.lit(b), 1).otherwise(0) for b in bounds[1:]), F.when(F.col("_key") >= F.lit(bounds[0]), 1).otherwise(0)) if bounds else F.lit(0)
    numbered = keyed.withColumn("_bucket", F.coalesce(above, F.lit(-1)))  # nulls first
    counts = numbered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # at most buckets + 1 rows
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", *tie))
    return numbered.withColumn("_own", own).join(F.broadcast(offsets), "_bucket").withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_key", "_bucket", "_own", "_before")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], buckets: int = 256) -> DataFrame:
    """(keys, a column for each share): exact percentiles, interpolated between neighbours, however many rows a key has.

    Equal values are counted first. A sketch's bounds cut the values into buckets; their counts tell which ones hold the two
    neighbours of a percentile, and only those are put in order. Keys must not be null; nulls of value don't count."""
    at = [F.lit(1).alias("_all")] if not keys else []
    by = keys or ["_all"]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")).select("*", *at)
    bounds = counted.agg(F.percentile_approx("_v", [k / buckets for k in range(1, buckets)], 1000)).first()[0] or []
    cut = F.size(F.filter(F.lit([float(b) for b in sorted(set(bounds))]), lambda b: b <= F.col("_v"))) if bounds else F.lit(0)
    cells = counted.withColumn("_b", cut)
    sums = cells.groupBy(*by, "_b").agg(F.sum("_c").alias("_m"))
    w = Window.partitionBy(*by)
    running = sums.withColumn("_end", F.sum("_m").over(w.orderBy("_b"))).withColumn("_n", F.sum("_m").over(w))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("_n") - 1)).alias("rank")) for name, share in shares.items())))
    ranks = running.withColumn("_q", asked).select(*by, "_b", "_q.name", "_q.rank", F.explode(F.array(F.floor("_q.rank"), F.ceil("_q.rank"))).alias("_r"), "_end", "_m").distinct()
    inside = ranks.where((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_m"))).withColumn("_before", F.col("_end") - F.col("_m"))
    wanted = cells.join(inside.select(*by, "_b").distinct(), [*by, "_b"], "left_semi")
    ordered = wanted.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v")))
    hits = ordered.join(inside, [*by, "_b"]).where((F.col("_r") - F.col("_before") < F.col("_to")) & (F.col("_r") - F.col("_before") >= F.col("_to") - F.col("_c")))
    ends = hits.groupBy(*by, "name", "rank").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("rank") - F.floor("rank"))
    return ends.withColumn("_p", between).groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("_p"))).alias(name) for name in shares)).drop("_all")


def level_db(mean_square: Column, floor: float = 1e-24) -> Column:
    """10 log10 of a mean square, with a floor so that silence has a value."""
    return 10 * F.log10(mean_square + F.lit(floor))


def tumbling(df: DataFrame, partition: list[str], seconds: Column, size: float) -> DataFrame:
    """df with the number of its window of `size` seconds."""
    return df.withColumn("window_no", F.floor(seconds / F.lit(size)).cast("long"))


def sliding_minimum(df: DataFrame, partition: list[str], second: Column, value: Column, size: int, step: int) -> DataFrame:
    """The least mean of value over windows of `size` seconds that start every `step` seconds, by partition."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((second - size) / step).cast("long") + 1)
    last = F.floor(second / step).cast("long")
    spread = df.select(*partition, value.alias("_v"), F.explode(F.sequence(first, last)).alias("_w"))
    return spread.groupBy(*partition, "_w").agg(F.avg("_v").alias("_m")).groupBy(*partition).agg(F.min("_m").alias("floor"))
