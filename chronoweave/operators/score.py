"""Reference scales, composite scores, ranks, document frequency and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.windows import percentiles


def scale(measures: DataFrame, parts: list[str], complete_only: bool = False) -> DataFrame:
    """One row: mean_ and sd_ (population; 0 counts as 1) of each part, and raw_mean and raw_sd of the mean z."""
    used = measures.where(F.expr(" and ".join(f"{p} is not null" for p in parts))) if complete_only else measures
    stats = used.agg(*(f(p).alias(f"{n}_{p}") for p in parts for n, f in (("mean", F.avg), ("sd", lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))))))
    raw = used.join(F.broadcast(stats)).select(mean_z(parts).alias("raw")).agg(F.avg("raw").alias("raw_mean"), F.coalesce(F.nullif(F.stddev_pop("raw"), F.lit(0.0)), F.lit(1.0)).alias("raw_sd"))
    return stats.join(F.broadcast(raw))


def mean_z(parts: list[str], signs: dict[str, int] | None = None, complete_only: bool = False) -> Column:
    """Mean of the parts' z scores; missing parts are left out, or make it null."""
    z = [(F.col(p) - F.col(f"mean_{p}")) / F.col(f"sd_{p}") * (signs or {}).get(p, 1) for p in parts]
    if complete_only:
        return sum(z[1:], z[0]) / len(z)
    n = sum((F.col(p).isNotNull().cast("int") for p in parts[1:]), F.col(parts[0]).isNotNull().cast("int"))
    return sum((F.coalesce(x, F.lit(0.0)) for x in z[1:]), F.coalesce(z[0], F.lit(0.0))) / F.nullif(n, F.lit(0))


def scored(measures: DataFrame, reference: DataFrame, parts: list[str]) -> DataFrame:
    """measures with score: 50 + 10 * (mean z - raw_mean) / raw_sd. reference is one row."""
    out = measures.join(F.broadcast(reference)).withColumn("score", 50 + 10 * (mean_z(parts) - F.col("raw_mean")) / F.col("raw_sd"))
    return out.select(*measures.columns, "score")


def top_k(df: DataFrame, partition: list[str], score: str, at: list[str], k: int) -> DataFrame:
    """The k highest of each partition; ties keep the order of `at`."""
    w = Window.partitionBy(*partition).orderBy(F.desc(score), *at)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def average_rank(df: DataFrame, keys: list[Column], tie: str, group: list[str]) -> DataFrame:
    """df with the mean of its places by each key, ties in order of `tie`."""
    places = [F.row_number().over(Window.partitionBy(*group).orderBy(k, tie)) for k in keys]
    return df.withColumn("order", sum(places[1:], places[0]) / F.lit(float(len(keys))))


#: Words for numbers, which no everyday list holds.
NUMBERS = tuple("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split())


def document_frequency(words: DataFrame, doc: str, word: str, share: float, documents: DataFrame | None = None, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Words that stand in at least ceil(share * documents) documents, one at least; words are counted once a document.

    documents: all of them, those without words too; by default those that have words."""
    distinct = words.where(~F.col(word).isin(list(leave_out))).select(doc, word).distinct() if leave_out else words.select(doc, word).distinct()
    n = (documents if documents is not None else words).agg(F.count_distinct(doc).alias("_n"))
    counted = distinct.groupBy(word).agg(F.count("*").alias("docs"))
    return counted.join(F.broadcast(n)).where(F.col("docs") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_n")


def doubted(words: DataFrame, everyday: DataFrame, rec: str = "rec", word: str = "word", *, doubt: float = 0.9, least: int = 50) -> DataFrame:
    """(rec, doubted, n): of each hundred everyday words, those whose probability (exp of logp) is under `doubt`; null with fewer than `least`."""
    used = words.join(everyday.where(~F.col(word).isin(list(NUMBERS))).select(word).distinct(), word, "left_semi")
    rate = used.groupBy(rec).agg((100 * F.avg((F.exp("logp") < doubt).cast("double"))).alias("rate"), F.count("*").alias("n"))
    every = words.select(rec).distinct().join(rate, rec, "left")
    return every.select(rec, F.when(F.col("n") >= least, F.col("rate")).alias("doubted"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def words_of_tokens(tokens: DataFrame, rec: str = "rec", *, mark: str = "▁", longest: float = 0.6) -> DataFrame:
    """(rec, word_no, text, start, end, logp) of sub-word tokens (rec, pos, token, start, logp): a token that begins with the mark begins a word; a word's
    log-probability is its tokens' sum; it ends where the next begins, after `longest` seconds at most. Punctuation alone does not make a word longer."""
    order = Window.partitionBy(rec).orderBy("pos")
    starts = (F.col("token").startswith(mark) | (F.row_number().over(order) == 1)).cast("int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: F.replace(x["token"], F.lit(mark), F.lit(""))), "")
    grouped = tokens.withColumn("word_no", F.sum(starts).over(order)).groupBy(rec, "word_no").agg(text.alias("text"), F.min("start").alias("start"), F.max(F.when(F.col("token").rlike(r"[\p{L}\p{N}]"), F.col("start"))).alias("last"), F.sum("logp").alias("logp"))
    following = F.lead("start").over(Window.partitionBy(rec).orderBy("word_no"))
    until = F.coalesce("last", "start") + longest
    return grouped.select(rec, "word_no", "text", "start", F.least(F.coalesce(following, until), until).alias("end"), "logp")


def with_fire(measures: DataFrame, reference: DataFrame, minutes: DataFrame | None = None, parts: tuple[str, ...] = ("lift", "movement", "spread", "brightness"), rec: str = "path") -> DataFrame:
    """measures with fire (the score), lift against the reference's, and, of minutes (rec, minute, parts), the three hottest as (at, fire)."""
    own = scored(measures, reference, list(parts)).withColumnRenamed("score", "fire")
    out = own.join(F.broadcast(reference.select(F.col("mean_lift").alias("_lift")).limit(1))).withColumn("lift", F.col("lift") - F.col("_lift")).drop("_lift")
    if minutes is None:
        return out
    hot = top_k(scored(minutes, reference, list(parts)).where("score is not null"), [rec], "score", ["minute"], 3)
    lists = hot.groupBy(rec).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", (F.col("minute") * 60.0).alias("at"), F.col("score").alias("fire")))), lambda x: F.struct(x["at"].alias("at"), x["fire"].alias("fire"))).alias("hottest"))
    return out.join(lists, rec, "left")


def resolved_scale(measures: DataFrame, parts: list[str], saved: DataFrame | None, *, calibrate: bool = False) -> tuple[DataFrame, str]:
    """The scale to score by and where it comes from: these recordings where it is to be set anew or none was saved, else the saved one."""
    if saved is not None and not calibrate:
        return saved, "saved"
    return scale(measures, parts), "calibrated" if calibrate else "these recordings"


def tone_distance(tones: DataFrame, rec: str = "path", tone: str = "tone") -> DataFrame:
    """(rec, tone_db): how far each tone is from the medians of the set, root mean square over its places."""
    each = tones.select(rec, F.posexplode(tone).alias("i", "v"))
    middle = percentiles(each, ["i"], "v", {"m": 0.5})  # a row for each place of a tone
    return each.join(middle, "i").groupBy(rec).agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("m"), 2))).alias("tone_db"))


def publisher_problems() -> Column:
    """What is outside a publisher's targets, of standards' columns and format, kbps, channels and sample_rate."""
    number = lambda f, *c: F.format_string(f, *(F.col(x) if isinstance(x, str) else x for x in c))
    ends = [(~F.col(f"{e}_s").between(1, 5), number(f"%s s of room tone at the {e} (1 to 5 s recommended)", F.col(f"{e}_s").cast("string"))) for e in ("head", "tail")]
    return violations([
        (~F.col("rms_db").between(-23, -18), number("RMS %.1f dB is outside -23 to -18", "rms_db")),
        (F.col("true_peak_db") > -3, number("peak %.2f dB is over -3", "true_peak_db")),
        (F.col("noise_floor_db") > -60, number("noise floor %.1f dB is over -60", "noise_floor_db")),
        *ends,
        (F.col("longest_pause_s") > 5, number("a pause of %s s (over 5 s)", F.col("longest_pause_s").cast("string"))),
        ((F.col("format") != "MP3") | (F.col("kbps") < 190) | (F.col("sample_rate") != 44100), number("%s at about %d kbps and %d Hz", "format", "kbps", "sample_rate")),
        (F.col("minutes") > 120, number("%.0f minutes long (120 at most)", "minutes")),
    ])


def set_notes(files: DataFrame, bands: tuple[int, int, int] = (30, 120, 180)) -> DataFrame:
    """One row of what holds for a set of files: mixed channels, spread of loudness, and how its total of minutes stands to the bands."""
    low, good, most = bands
    stats = files.agg(F.count_distinct("channels").alias("kinds"), (F.max("rms_db") - F.min("rms_db")).alias("spread"), F.sum("minutes").alias("total"))
    length = F.when(F.col("total") < low, F.lit(f"under the minimum of {low} minutes")).when(F.col("total") < good, F.lit(f"over the minimum; {good} to {most} minutes are best")).otherwise(F.lit(f"in or past {good} to {most} minutes"))
    return stats.select("total", "spread", (F.col("kinds") > 1).alias("mixed_channels"), length.alias("length"))


def violations(rules: list[tuple[Column, Column]]) -> Column:
    """The texts of the rules whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, t) for c, t in rules)))
