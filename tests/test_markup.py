from pyspark.sql import functions as F

from chronoweave.operators import markup

TEXT = """# Name
<!-- two
lines {9} ~~ -->
0:01  One two ~~three {0.40} {sound 0.02 -29}~~ four, {0.30} five
> quoted ~~
1:02:03.5  six {2.00} ~~seven
0:09  eight~~ nine. {0.5} ten {pause}
"""


def test_kept(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "a ~~b"), (5, "<!-- open")], "id int, t string")
    got = {r.id: r for r in rows.select("id", markup.kept_text(F.col("t")).alias("kept"), markup.struck_text(F.col("t")).alias("struck"), markup.is_unclosed(F.col("t")).alias("open")).collect()}
    assert (got[1].kept, got[1].struck, got[1].open) == ("One two four, five six nine. ten", "three seven eight", False)
    assert got[2].kept is None and got[3].kept == "" and got[4].open and got[5].kept == "<!-- open"


def test_tokens_agree(spark):
    rows = spark.createDataFrame([(1, TEXT)], "id int, t string")
    tokens = markup.mark_tokens(rows, "id", "t")
    got = tokens.orderBy("line_no", "pos").collect()
    assert " ".join(r.token for r in got if r.kind == "word" and not r.struck) == "One two four, five six nine. ten"
    assert {r.stamp for r in got} == {"0:01", "1:02:03.5", "0:09"} and got[0].line_no == 4
    assert [(r.kind, r.seconds, r.struck) for r in got if r.kind != "word"] == [("pause", 0.4, True), ("sound", 0.02, True), ("pause", 0.3, False), ("pause", 2.0, False), ("pause", 0.5, False), ("unknown", None, False)]
    assert sorted((r.after, r.problem) for r in markup.check_pauses(tokens, "id").collect()) == [("six", "long")]


def test_lines(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.3, "One."), (1, 0.6, 0.9, "Two"), (1, 1.2, 1.4, "three"), (1, 2.0, 2.2, "four")], "k int, a double, b double, text string")
    assert [(r.line_no, r.line) for r in markup.transcript_lines(rows, ["k"]).orderBy("line_no").collect()] == [(1, "One."), (2, "Two three"), (3, "four")]
