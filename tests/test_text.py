from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.operators import align, intervals


def test_tokens():
    assert X.tokens("In 1984, $3.1 trillion; 5% of Straße VII") == "in nineteen eighty four three point one trillion dollars five per cent of strasse seven".split()
    assert X.tokens("at 6:05 the 21st, 1990s") == "at six oh five the twenty first nineteen nineties".split()
    assert X.tokens("café — don't 'quote'") == ["cafe", "don't", "quote"]


def test_sentences():
    assert X.split_sentences("Dr. Smith came at 9 a.m. sharp. He left. J. R. stayed!") == ["Dr. Smith came at 9 a.m. sharp.", "He left.", "J. R. stayed!"]


def test_native_text(spark):
    r = spark.range(1).select(
        X.letters(F.lit("Ab-c 1!")).alias("letters"), X.clean_inline(F.lit("a **b** [c](d) ![e](f) g[^1]")).alias("inline"), X.clock(F.lit(3725.26)).alias("clock"), X.seconds_of(F.lit("1:02:05.5")).alias("s"),
        X.near(F.lit("colour"), F.lit("colours")).alias("near"), X.near(F.lit("cat"), F.lit("cut")).alias("far"), X.ends_sentence(F.lit("end.”")).alias("ends"), X.cell(F.lit("a|b<c>")).alias("cell"),
    ).first()
    assert (r.letters, r.inline, r.clock, r.s, r.near, r.far, r.ends, r.cell) == ("abc1", "a b c g", "1:02:05.3", 3725.5, True, False, True, "a&#124;b&lt;c&gt;")


def test_alignment():
    assert align.opcodes("a b c".split(), "a c d".split()) == [("delete", 1, 2, 1, 1), ("insert", 3, 3, 2, 3)]
    assert align.lost("one two three".split(), "one three".split()) == [(1, ["two"])]
    assert align.lost("one two one two".split(), "one two".split()) == []  # a retake


def test_bounded_merge(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.5, 3.0), (1, 3.5, 9.0), (1, 20.0, 21.0)], "k int, a double, b double")
    got = sorted((r.start, r.end) for r in intervals.bounded_merge(df, ["k"], "a", "b", 1.0, 3.0).collect())
    assert got == [(0.0, 3.0), (3.5, 9.0), (20.0, 21.0)]
