"""Marked-up transcripts: struck runs (`~~`), pauses and sounds in braces, stamped lines. All native; only mark_tokens shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"^\s*(?:\d+:)?\d{1,2}:\d{2}(?:\.\d+)?\s+"
TOKEN = r"~~|\{[^{}]*\}|[^\s~{}]+"


def without_comments(text: Column) -> Column:
    """The text without `<!-- -->`, whose line breaks stay so that line numbers hold; an unclosed one stays as it is."""

    def part(p: Column, i: Column) -> Column:
        end = F.instr(p, "-->")
        inside = F.regexp_replace(F.substring_index(p, "-->", 1), "[^\n]", "")
        return F.when(i == 0, p).when(end > 0, F.concat(inside, F.substr(p, end + 3))).otherwise(F.concat(F.lit("<!--"), p))

    return F.array_join(F.transform(F.split(text, "<!--"), part), "")


def is_spoken(line: Column) -> Column:
    """Neither blank, a heading nor a quotation."""
    return ~F.trim(line).rlike(r"^(?:[#>]|$)")


def _spoken(text: Column) -> Column:
    lines = F.filter(F.split(without_comments(text), "\n"), is_spoken)
    return F.array_join(F.transform(lines, lambda line: F.regexp_replace(line, STAMP, "")), "\n")


def kept_text(text: Column) -> Column:
    """What is left to be heard: outside strikes and braces, single spaces between. Null stays null."""
    parts = F.split(_spoken(text), "~~")
    heard = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(heard, r"\{[^{}]*\}", " "), r"\s+", " "))


def struck_text(text: Column) -> Column:
    """The words inside strikes, as kept_text gives the others."""
    parts = F.split(_spoken(text), "~~")
    cut = F.array_join(F.filter(parts, lambda _, i: i % 2 == 1), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"\{[^{}]*\}", " "), r"\s+", " "))


def is_unclosed(text: Column) -> Column:
    """A strike is opened and never closed."""
    return F.size(F.split(_spoken(text), "~~")) % 2 == 0


def mark_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, stamp or null, pos in the line, token, kind, seconds, struck) of words, sounds and pauses."""
    lines = df.select(id_col, F.posexplode(F.split(without_comments(F.col(text_col)), "\n")).alias("line_no", "line")).where(is_spoken(F.col("line")))
    stamp = F.trim(F.regexp_extract("line", STAMP, 0))
    tokens = lines.select(id_col, (F.col("line_no") + 1).alias("line_no"), F.nullif(stamp, F.lit("")).alias("stamp"), F.posexplode(F.regexp_extract_all(F.regexp_replace("line", STAMP, ""), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    w = Window.partitionBy(id_col).orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(F.col("token") == "~~", 1).otherwise(0)).over(w)
    pause = F.regexp_extract("token", r"^\{\s*(\d+(?:\.\d+)?)\s*\}$", 1)
    sound = F.regexp_extract("token", r"^\{\s*sound\s+(\d+(?:\.\d+)?)", 1)
    kind = F.when(pause != "", "pause").when(F.col("token").rlike(r"^\{\s*sound\b"), "sound").when(F.col("token").startswith("{"), "unknown").otherwise("word")
    seconds = F.when(pause != "", pause.cast("double")).when(sound != "", sound.cast("double"))
    return tokens.withColumn("struck", opened % 2 == 1).where("token != '~~'").withColumn("kind", kind).withColumn("seconds", seconds)


def check_pauses(tokens: DataFrame, id_col: str, *, least: float = 0.12, most: float = 1.6) -> DataFrame:
    """Gaps between kept words of mark_tokens' rows that deserve a look: id, after (the word before), seconds, problem.

    `inside`: a pause of `least` or more within a sentence, without a sound; `long`: more than `most` seconds."""
    order = Window.partitionBy(id_col).orderBy("line_no", "pos")
    kept = tokens.where("not struck").withColumn("word_no", F.sum((F.col("kind") == "word").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = kept.groupBy(id_col, "word_no").agg(F.max(F.when(F.col("kind") == "word", F.col("token"))).alias("after"), F.sum(F.when(F.col("kind") != "word", F.col("seconds"))).alias("seconds"), F.coalesce(F.bool_or(F.col("kind") == "sound"), F.lit(False)).alias("sound")).where("word_no > 0 and seconds is not null")
    inside = (F.col("seconds") >= least) & ~F.col("after").rlike("[.?!,;:]$") & ~F.col("sound")
    return gaps.withColumn("problem", F.when(F.col("seconds") > most, "long").when(inside, "inside")).where("problem is not null").select(id_col, "after", "seconds", "problem")


def transcript_lines(pieces: DataFrame, partition: list[str], *, start: str = "a", end: str = "b", text: str = "text", tie: str | None = None, gap: float = 0.5, gap_after_sentence: float = 0.25) -> DataFrame:
    """Timed words as lines: partition, line_no from 1, start, end, n_words, line. A line ends before a gap, sooner after . ? or !"""
    order = [start] + ([tie] if tie else [])
    w = Window.partitionBy(*partition).orderBy(*order)
    since = F.col(start) - F.lag(end).over(w)
    ends = F.coalesce(F.lag(text).over(w).rlike("[.?!]$"), F.lit(False))
    breaks = F.coalesce((since >= gap) | (ends & (since >= gap_after_sentence)), F.lit(True)).cast("int")
    numbered = pieces.withColumn("_break", breaks).withColumn("line_no", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ")
    return numbered.groupBy(*partition, "line_no").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_words"), words.alias("line"))
