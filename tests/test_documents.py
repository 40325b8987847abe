from pyspark.sql import functions as F

from chronoweave.functions import documents as D
from chronoweave.functions import text as X

PAGE = """---
title: t
---
# Part One {#p1}

A word.[^1] And a [link](http://a.b) with *stress*,
on two lines.

| x | y |
|---|---|

~~~
not read
~~~

[^1]: A note.
    Its second line.

<!-- kept
out -->
## Second
- First item.
- Next item
  goes on.
> Quoted.
"""


def test_forms_of_numbers():
    for text, want in [
        ("In 1811, wages fell 31%.", "in eighteen eleven wages fell thirty one per cent"),
        ("$52,000 a year", "fifty two thousand dollars a year"),
        ("the 1760s and the 20th century", "the seventeen sixties and the twentieth century"),
        ("in the '90s", "in the nineties"),
        ("At 8:00 a.m. and 6:05 p.m.", "at eight a m and six oh five p m"),
        ("They vote at 4:45.", "they vote at four forty five"),
        ("is$450 a week, $1", "is four hundred and fifty dollars a week one dollars"),
        ("Þingvellir, Søren, abcжdef", "thingvellir soren abcdef"),
        ("C<unk> in—a “Ned”", "c in a ned"),
        ("I saw Henry VIII, X and II", "i saw henry eight x and two"),
        ("four percent 3.10", "four per cent three point one"),
    ]:
        assert X.tokens(text) == want.split(), text
    assert X.cardinal(10**21) == "one sextillion"
    assert X.split_sentences("Gen. Lee came. Rev. Smith met the U.S. Navy at 6 a.m. Monday. Did he? Yes.") == ["Gen. Lee came.", "Rev. Smith met the U.S. Navy at 6 a.m. Monday.", "Did he?", "Yes."]


def test_blocks():
    assert D.markdown_blocks(PAGE) == [("heading", "Part One"), ("body", "A word. And a link with stress, on two lines."), ("heading", "Second"), ("body", "First item."), ("body", "Next item goes on. Quoted.")]
    assert D.markdown_blocks("<!-- a\nb -->\n# T\n\n<!-- c -->\nBody.\n") == [("heading", "T"), ("body", "Body.")]
    assert D.markdown_blocks("") == []


def test_sections_and_lines(spark):
    docs = spark.createDataFrame([(1, "# Chapter 1\n\nOne. Two.\n\n# Chapter 2\n\nThree."), (2, "# Other\n\nText."), (3, None)], "id int, t string")
    parsed = D.blocks(docs, "id", "t")
    part = D.section(parsed, "id", "chapter 1", "CHAPTER 2")
    got = D.lines(part, "id").orderBy("line_no").collect()
    assert [(r.id, r.line_no, r.text, r.is_title) for r in got] == [(1, 1, "Chapter 1.", True), (1, 2, "One.", False), (1, 3, "Two.", False)]
    assert got[0].tokens == ["chapter", "one"]
    assert [(r.id, r.headings) for r in D.missing_sections(parsed, "id", "Chapter 1").collect()] == [(2, "Other")]
    assert docs.where("id = 1").select(D.line_range(F.col("t"), 2, 3).alias("x")).first().x == "\nOne. Two."


def test_plain_and_wrap(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(D.plain(F.lit("it came — The end; so: he (she) said. (a whole one.) at 8:00"))) == "It came. The end. So, he, she, said. A whole one. At 8:00"
    wrapped = D.wrap("~~")(F.array(*map(F.lit, ["a", "“b", "c,”", "d"])), F.array(*map(F.lit, [False, True, True, False])))
    assert one(wrapped) == "a “~~b c~~,” d"
    rows = spark.createDataFrame([("x1234567890123456789012345",), ("x1234567890123456789012344",), ("x2",), ("x010",)], "n string")
    assert [r.n for r in rows.orderBy(X.natural_key(F.col("n"))).collect()] == ["x2", "x010", "x1234567890123456789012344", "x1234567890123456789012345"]


def test_queries_against_their_definitions(spark, sf_dir):
    """Queries that SQL cannot express, row by row against the plain functions over whole tables."""
    from difflib import SequenceMatcher

    from chronoweave.operators import align, compare
    from chronoweave.plans import catalog

    run = lambda name: catalog.queries()[name](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted((r.doc_id, r.block_no, r.kind, r.text) for r in run("markdown_blocks")) == sorted((i, k, *b) for i, t in docs.items() for k, b in enumerate(D.markdown_blocks(t)))
    assert sorted((r.doc_id, r.pos, r.sentence) for r in run("sentence_split")) == sorted((i, k, s) for i, t in docs.items() for k, s in enumerate(X.split_sentences(t)))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = [(i, s, " ".join(X.tokens(s))) for i, t in items.items() for _, b in D.markdown_blocks(t) for s in X.split_sentences(b) if X.tokens(s)]
    assert sorted((r.item_id, r.text, r.tokens) for r in run("manuscript_lines")) == sorted(want)
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    pairs = [(f"{c}:{b[0]}", a[1], b[1]) for c, ts in turns.items() for a, b in zip(ts, ts[1:])]
    said = sorted((k, d["n"], d["written"], d["said"]) for k, a, b in pairs for d in compare.said_against([a], b.split())[1])
    assert sorted((r.doc, r.n, r.written, r.said) for r in run("said_differences")) == said
    own = [(k, d["tag"], d["book"], d["read"]) for k, a, b in pairs for d in compare.compared([x for x in map(X.tokens, X.split_sentences(a.strip())) if x], [X.tokens(w) for w in b.split()])]
    assert sorted((r.doc, r.tag, r.book, r.read) for r in run("turn_compare")) == sorted(own)
    # what alignment rests on: the longest common blocks, junk not being left out
    for _, a, b in pairs[:50]:
        x, y = a.split(), b.split()
        assert align.opcodes(x, y) == [o for o in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]


def test_percentiles_and_places(spark):
    import numpy as np

    from chronoweave.operators import windows as W

    draw = np.random.default_rng(8)
    rows = [(k, float(v)) for k, n in (("a", 999), ("b", 1), ("c", 500)) for v in np.round(draw.normal(0, 3, n), 1)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.lo, r.mid, r.hi) for r in W.percentiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.93}, buckets=16).collect()}
    for k in "abc":
        own = [v for q, v in rows if q == k and v is not None]
        assert np.allclose(got[k], np.percentile(own, [10, 50, 93]))
    whole = W.percentiles(df, [], "v", {"mid": 0.5}).first()
    assert whole.asDict() == {"mid": float(np.percentile([v for _, v in rows if v is not None], 50))}
    assert W.percentiles(df.limit(0), ["k"], "v", {"mid": 0.5}).count() == 0
    names = spark.createDataFrame([(k, f"x{(k * 7919) % 1000}") for k in range(1000)], "i int, n string")
    placed = W.places(names, X.natural_key(F.col("n")), ["i"], buckets=7).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 1001)) and [r.n for r in placed] == [f"x{k}" for k in range(1000)]
